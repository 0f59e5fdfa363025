"""Main text of web pages by consensus of a host's pages on where it stands.

Each page scores its containers and votes for the generalised path of the best one.  Votes are counted
per host, and a second reading of the pages extracts the text below the winning paths.  Markup moves in
neither pass: only votes are shuffled, a row per host and path and task.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygauge.llm.frames import byte_arrays, chunks, stage, utf8

# A path is accepted for a host if it has at least this share of the votes of the first one.
ACCEPTED = 1 / 3
# Words of a text outside of paragraphs that count like a paragraph.
PARAGRAPH_WORDS = 10

# Elements by what they do to text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head script style noscript template iframe noembed noframes object svg canvas audio video map "
    "nav footer aside form button select textarea title menu dialog datalist".split()
)
HEAD = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre "
    "search section summary table tbody tfoot thead title tr ul".split()
)
SPACES = frozenset("br td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre li dd dt blockquote figcaption td th".split()) | HEADINGS
CONTAINERS = frozenset("html body main article section div center td blockquote fieldset form".split())
# Elements that an opening tag closes where they are still open, up to the nearest of a set of others.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset()),
}
# Where an open paragraph is out of reach of a block that would close it.
P_SCOPE = frozenset({"td", "th", "caption", "button", "object", "table"})
# Words of classes, ids and roles that mark what is not the article.
OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox banner banners sponsor sponsored "
    "promo promos promotion promoted cookie cookies consent gdpr notice notices notification notifications alert "
    "alertdialog popup modal newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations sidebar sidebars widget widgets menu menus menubar nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer contentinfo complementary copyright "
    "disclaimer search comment comments commentlist reply replies respond disqus outbrain taboola".split()
)
# Those that are never the frame around an article.
NEVER = frozenset("comment comments commentlist reply replies respond disqus ad ads advert advertisement cookie".split())
GOOD = frozenset("article content post entry story text maincontent articlebody".split())
HEADER = frozenset({"header"})

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*+(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_]+")
# Numbers that differ from page to page; those of columns and grids have fewer digits.
_NUMBER = re.compile(r"\d{3,}|\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?:[^/?#@]*@)?([^/?#:]+)"

_NORMAL, _DROPPED, _HEADINGS_ONLY = 0, 1, 2


class Page:
    """The elements of a page in order, each with its parent, and the runs of text between tags."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.names = ["html"]
        self.parents = [0]
        self.marks = [_NORMAL]
        # Dropped by its words only, so that it stays where it frames the article.
        self.soft = [False]
        # Paths are numbers; an element that is no container has the path of the one around it.
        self.paths = [0]
        self.steps: dict[tuple[int, str], int] = {}
        self.path_steps: list[tuple[int, str]] = [(0, "")]
        self.path_depth = [0]
        self.path_gain = [1.0]
        # (element, start, end) of text; (element, -1, 0) ends a block; (element, -2, 0) is a space.
        self.events: list[tuple[int, int, int]] = []
        self._open_now: Counter[str] = Counter()
        self._parse()

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        described = "=" in attributes or "hidden" in attributes.lower()
        classes, words, hidden, body = _describe(attributes) if described else ("", frozenset(), False, False)
        frame = name in ("html", "body", "main")
        mark, soft = _NORMAL, False
        if hidden or name in DROPPED:
            mark, soft = _DROPPED, name == "form" and not hidden
        elif not frame and words & OTHER:
            mark, soft = _DROPPED, not words & NEVER
        elif name == "header" or (words & HEADER and not frame and name != "article"):
            mark = _HEADINGS_ONLY
        path = self.paths[stack[-1]]
        if name in CONTAINERS:
            step = (path, name + classes)
            if step not in self.steps:
                self.steps[step] = len(self.path_steps)
                self.path_steps.append(step)
                self.path_depth.append(self.path_depth[path] + 1)
                called = name in ("article", "main") or body
                self.path_gain.append(1.3 if called else 1.15 if words & GOOD else 1.0)
            path = self.steps[step]
        self.parents.append(stack[-1])
        stack.append(len(self.names))
        self.names.append(name)
        self._open_now[name] += 1
        self.paths.append(path)
        self.marks.append(mark)
        self.soft.append(soft)

    def _parse(self) -> None:
        source, events, stack, at = self.source, self.events, [0], 0
        while True:
            found = _TAG.search(source, at)
            start = found.start() if found else len(source)
            if start > at:
                events.append((stack[-1], at, start))
            if found is None:
                return
            at = found.end()
            if found[2] is None:
                continue
            name = found[2].lower()
            if found[1]:
                self._close(stack, name)
                continue
            if name == "html" or (name == "body" and self._open_now["body"]):
                continue
            if name not in HEAD and len(stack) > 1 and self.names[stack[1]] == "head":
                self._cut(stack, 1)
            if name in BLOCKS:
                self._imply(stack, frozenset({"p"}), P_SCOPE)
            if name in CLOSES:
                self._imply(stack, *CLOSES[name])
            if name in BLOCKS:
                events.append((stack[-1], -1, 0))
            elif name in SPACES:
                events.append((stack[-1], -2, 0))
            if name in VOID:
                continue
            self._open(stack, name, found[3].removesuffix(">"))
            if name in RAW:
                end = _raw_end(name).search(source, at)
                stop = end.start() if end else len(source)
                if stop > at:
                    events.append((stack[-1], at, stop))
                at = stop

    def _cut(self, stack: list[int], depth: int) -> None:
        self._open_now.subtract(self.names[i] for i in stack[depth:])
        del stack[depth:]

    def _imply(self, stack: list[int], closed: frozenset, scope: frozenset) -> None:
        if not any(self._open_now[name] for name in closed):
            return
        for depth in range(len(stack) - 1, 0, -1):
            name = self.names[stack[depth]]
            if name in closed:
                self.events.append((stack[depth], -1 if name in BLOCKS else -2, 0))
                self._cut(stack, depth)
                return
            if name in scope or (name in BLOCKS and "p" in closed):
                return

    def _close(self, stack: list[int], name: str) -> None:
        if not self._open_now[name]:
            return
        inline = name not in BLOCKS and name not in SPACES
        for depth in range(len(stack) - 1, 0, -1):
            open_name = self.names[stack[depth]]
            if open_name == name:
                if not inline:
                    self.events.append((stack[depth], -1 if name in BLOCKS else -2, 0))
                self._cut(stack, depth)
                return
            if inline and open_name in BLOCKS:
                return

    def _within(self, names: frozenset) -> list[bool]:
        """For each element whether it or one around it is one of ``names``."""
        out = [False] * len(self.names)
        for i in range(1, len(out)):
            out[i] = out[self.parents[i]] or self.names[i] in names
        return out

    def _summed(self, own: dict[int, list[int]]) -> list[list[int]]:
        """Two counts per element, each with those of all elements in it."""
        sums = [list(own.get(i, (0, 0))) for i in range(len(self.names))]
        for i in range(len(sums) - 1, 0, -1):
            above = sums[self.parents[i]]
            above[0] += sums[i][0]
            above[1] += sums[i][1]
        return sums

    def kinds(self) -> list[int]:
        """For each element whether its text is taken, dropped, or taken in headings only."""
        frames = self._summed({i: [1, 0] for i, n in enumerate(self.names) if n in ("article", "main", "h1")})
        inside, headings = self._within(frozenset({"article", "main"})), self._within(HEADINGS)
        out = [_NORMAL] * len(self.names)
        for i in range(1, len(out)):
            above, mark = out[self.parents[i]], self.marks[i]
            if self.soft[i] and frames[i][0]:
                mark = _NORMAL  # a frame around the article, not one of its neighbours
            if mark == _HEADINGS_ONLY and not inside[i]:
                mark = _DROPPED
            out[i] = above if above == _DROPPED or mark == _NORMAL else mark
            if out[i] == _HEADINGS_ONLY and headings[i]:
                out[i] = _NORMAL
        return out

    def scores(self, kinds: list[int]) -> dict[int, float]:
        """The score of each path: how well the elements under it part paragraphs from other text.

        That is the harmonic mean of the share of their text that is in paragraphs, and of the
        share of all paragraphs that they hold, a little more for elements called an article.
        """
        paragraph, linked = self._within(PARAGRAPHS), self._within(frozenset({"a"}))
        own: dict[int, list[int]] = {}
        for tight in (True, False):
            own = {}
            for i, start, end in self.events:
                if start < 0 or kinds[i] != _NORMAL:
                    continue
                words = self.source[start:end].split()
                if words:
                    good = not linked[i] and (paragraph[i] or not tight or len(words) >= PARAGRAPH_WORDS)
                    own.setdefault(i, [0, 0])[0 if good else 1] += end - start
            if any(much for much, _ in own.values()):
                break
        sums: dict[int, list[int]] = {}
        for i, (much, other) in enumerate(self._summed(own)):
            if self.names[i] in CONTAINERS and much:
                into = sums.setdefault(self.paths[i], [0, 0])
                into[0] += much
                into[1] += other
        total = sums[0][0] if sums else 0
        return {p: self.path_gain[p] * 2 * much / (much + other + total) for p, (much, other) in sums.items()}

    def best(self, kinds: list[int]) -> int | None:
        """The path with the highest score, the deepest of equals; None where there is no text."""
        scores = self.scores(kinds)
        return max(scores, key=lambda p: (round(scores[p], 9), self.path_depth[p], -p)) if scores else None

    def path(self, number: int) -> str:
        steps = []
        while number:
            number, step = self.path_steps[number]
            steps.append(step)
        return ">".join(reversed(steps))

    def number(self, path: str) -> int | None:
        """The number of a path, None if the page has no such element."""
        at: int | None = 0
        for step in path.split(">") if path else ():
            at = self.steps.get((at, step))
            if at is None:
                return None
        return at

    def text(self, path: int, kinds: list[int]) -> str:
        """Blocks below the elements of a path, in page order, one to a line."""
        taken = [False] * len(self.names)
        for i in range(len(taken)):
            holds = self.names[i] in CONTAINERS and self.paths[i] == path
            taken[i] = holds or (i > 0 and taken[self.parents[i]])
        menus = self._menus(kinds)
        blocks, parts = [], []
        for i, start, end in self.events:
            if start == -1:
                blocks.append("".join(parts))
                parts = []
            elif not taken[i] or kinds[i] != _NORMAL or menus[i]:
                continue
            elif start == -2:
                parts.append(" ")
            else:
                parts.append(html.unescape(self.source[start:end]))
        blocks.append("".join(parts))
        tidy = (" ".join(b.split()) for b in blocks)
        return "\n".join(b for b in tidy if b)

    def _menus(self, kinds: list[int]) -> list[bool]:
        """For each element whether it is in a list that holds nothing but three links or more."""
        linked = self._within(frozenset({"a"}))
        own: dict[int, list[int]] = {}
        for i, start, end in self.events:
            if start >= 0 and kinds[i] == _NORMAL and not self.source[start:end].isspace():
                own.setdefault(i, [0, 0])[0 if linked[i] else 1] += 1
        out = [False] * len(self.names)
        for i, (links, other) in enumerate(self._summed(own)):
            menu = self.names[i] in ("ul", "ol") and links >= 3 and not other
            out[i] = menu or (i > 0 and out[self.parents[i]])
        return out


_RAW_ENDS: dict[str, re.Pattern] = {}


def _raw_end(name: str) -> re.Pattern:
    if name not in _RAW_ENDS:
        _RAW_ENDS[name] = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I)
    return _RAW_ENDS[name]


def _describe(attributes: str) -> tuple[str, frozenset, bool, bool]:
    """The generalised classes and id of a tag, their words, whether it is hidden, whether it is the body of an article."""
    classes, words, hidden, good = [], set(), False, False
    for found in _ATTRIBUTE.finditer(attributes):
        name, value = found[1].lower(), (found[2] or "").strip("\"'")
        if name == "hidden":
            hidden = hidden or value.lower() != "until-found"
        elif name == "aria-hidden":
            hidden = hidden or value.lower() == "true"
        elif name == "style":
            plain = value.replace(" ", "").lower()
            hidden = hidden or "display:none" in plain or "visibility:hidden" in plain
        elif name == "itemprop":
            good = good or value.lower() == "articlebody"
        else:
            for one in html.unescape(value).split():
                parts = [w.lower() for w in _WORD.findall(one)]
                # has-sidebar or with-comments tell of the frame, not of the part.
                if not parts or parts[0] in ("has", "no", "with", "without", "is"):
                    continue
                words.update(parts)
                if name == "class":
                    classes.append("." + _NUMBER.sub("#", one.lower()).replace(">", "_"))
                elif name == "id":
                    classes.append("#" + _NUMBER.sub("#", one.lower()).replace(">", "_"))
    return "".join(sorted(set(classes))), frozenset(words), hidden, good


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    _, offsets = byte_arrays(batch.column("_html"))
    for i, j in chunks(offsets):
        part = batch.slice(i, j - i)
        yield part, [b.as_py().decode("utf-8", "replace") for b in part.column("_html")]


def _best(page: Page) -> str | None:
    number = page.best(page.kinds())
    return None if number is None else page.path(number)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in _texts(batch):
            best = [_best(Page(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("_host"), pa.array(best, pa.string())], ["_host", "path"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in _texts(batch):
            rows = []
            for text, accepted in zip(texts, part.column("_paths").to_pylist()):
                page, accepted = Page(text), accepted or []
                path = _best(page)
                if path not in accepted:
                    path = next((p for p in accepted if page.number(p) is not None), path)
                found = "" if path is None else page.text(page.number(path), page.kinds())
                rows.append((found, path, path in accepted))
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c) for c in part.schema.names if c not in ("_html", "_host", "_paths")],
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.bool_()),
                ],
                [*[c for c in part.schema.names if c not in ("_html", "_host", "_paths")], "_text", "_path", "_agreed"],
            )


def host_of(url: str) -> Column:
    """The host of an address, lower-cased; null where it names none."""
    found = F.regexp_extract(F.col(url), _HOST, 1)
    return F.when(found != "", F.lower(found))


def host_paths(pages: DataFrame, page_html: str = "html", url: str = "url") -> DataFrame:
    """(host, paths): the paths that a host's pages agree on, most votes first.

    A path is accepted with ACCEPTED of the votes of the first one, so a second layout of a host stays,
    and a page that takes an advert for its article does not count.  Votes are counted where pages lie
    and again per host, so a hot host is a row per path and task.
    """
    given = pages.select(host_of(url).alias("_host"), utf8(page_html).alias("_html")).where("_host IS NOT NULL")
    votes = given.mapInArrow(_votes, "_host string, path string").where("path IS NOT NULL")
    counted = votes.groupBy("_host", "path").agg(F.count(F.lit(1)).alias("votes"))
    # Paths of a host: as many as its layouts.
    listed = counted.groupBy("_host").agg(
        F.max("votes").alias("most"), F.collect_list(F.struct((-F.col("votes")).alias("less"), "path")).alias("all")
    )
    accepted = F.filter("all", lambda v: -v["less"] >= ACCEPTED * F.col("most"))
    return listed.select(F.col("_host").alias("host"), F.transform(F.array_sort(accepted), lambda v: v["path"]).alias("paths"))


def main_text(pages: DataFrame, page_html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """(``key``, ``url``, text, path, agreed) for each row of ``pages``.

    ``text`` holds the blocks of the article in page order, a line each: references decoded, white space
    turned to one blank, without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
    and comments.  ``path`` is where it stood; ``agreed`` tells whether the page's host agrees on that.
    A page takes its own best path where its host accepts it, else the first accepted one that it has,
    else its own, as do pages whose address is null or names no host.  Null, empty or text-free markup gives an empty text, and
    a null path where it has no text at all.  Repeated rows and null keys each give their row; an empty table
    gives no rows; columns other than these three are not read.
    """
    paths = stage(host_paths(pages, page_html, url), "host-paths")
    given = pages.select(
        F.col(key).alias("_key"), F.col(url).alias("_url"), host_of(url).alias("_host"), utf8(page_html).alias("_html")
    )
    # Spark sees the size of the stored paths: few hosts are broadcast, many are joined by host.
    met = given.join(paths.select(F.col("host").alias("_host"), F.col("paths").alias("_paths")), "_host", "left")
    met = met.select("_key", "_url", "_host", "_html", "_paths")
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    schema = f"_key {kinds['_key']}, _url {kinds['_url']}, _text string, _path string, _agreed boolean"
    out = met.mapInArrow(_extracted, schema)
    return out.select(
        F.col("_key").alias(key),
        F.col("_url").alias(url),
        F.col("_text").alias("text"),
        F.col("_path").alias("path"),
        F.col("_agreed").alias("agreed"),
    )
