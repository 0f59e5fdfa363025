"""The text queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    lowered = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    return rf"list_filter(regexp_split_to_array({lowered}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


# Texts as hexadecimal digits, cut into pieces so that a string is not looked for from a long text's start.
REPEATS = """WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h
  FROM documents),
pieces AS (SELECT r, k, c, substr(h, 2 * c + 1, 1122) AS piece FROM (SELECT *, unnest(range(0, length(h) // 2 - 49, 512)) AS c FROM d)),
strings AS (
  SELECT r, k, c + i AS p, substr(piece, 2 * i + 1, 100) AS s
  FROM (SELECT *, unnest(range(0, least(512, length(piece) // 2 - 49))) AS i FROM pieces)),
firsts AS (SELECT s, min(k) AS first FROM strings GROUP BY s HAVING min(k) < max(k)),
hits AS (SELECT r, p FROM strings JOIN firsts USING (s) WHERE first < k),
runs AS (
  SELECT r, min(p) AS a, max(p) + 50 AS b
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run
        FROM (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 1 ELSE 0 END AS fresh FROM hits))
  GROUP BY r, run),
gone AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS upto FROM runs GROUP BY r),
rest AS (
  SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS t FROM runs
  UNION ALL SELECT r, 9223372036854775807, coalesce(upto, 0), length(h) // 2 FROM d LEFT JOIN gone USING (r)),
kept AS (SELECT r, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY a) AS left_over FROM rest JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(left_over)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)"""

CONTAMINATION = f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS m
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM d CROSS JOIN (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hits AS (SELECT p.doc_id, p.i, p.m, win.item FROM places p JOIN win ON p.win = win.win AND p.m = win.m),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sets AS (SELECT doc_id, md5(string_agg(s, '|' ORDER BY s)) AS digest, count(*) AS n FROM sh GROUP BY doc_id),
cls AS (SELECT digest, min(doc_id) AS r, count(*) AS copies, min(n) AS n FROM sets GROUP BY digest),
own AS (SELECT r, s FROM sh JOIN cls ON sh.doc_id = cls.r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM own a JOIN own b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (
  SELECT a, b, y.copies FROM pairs JOIN cls x ON x.r = a JOIN cls y ON y.r = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reached(node, label) AS (SELECT r, r FROM cls UNION SELECT l.b, reached.label FROM reached JOIN links l ON l.a = reached.node),
labels AS (SELECT node AS r, min(label) AS class_id FROM reached GROUP BY node),
near AS (SELECT a AS r, count(*) AS texts, sum(copies) AS docs FROM links GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(cls.r, d.doc_id) AS text_class,
  CAST(coalesce(copies - 1, 0) + coalesce(docs, 0) AS BIGINT) AS n_links, coalesce(texts, 0) AS n_link_texts
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN cls USING (digest) LEFT JOIN labels ON labels.r = cls.r
LEFT JOIN near ON near.r = cls.r"""

# Rule: (value, smallest spread), as in the quality rules; the last one has a lower limit as well.
_RULES = {
    "symbols": ("1000 * n_symbols / greatest(word_chars, 1)", 25),
    "dup_lines": ("1000 * n_dup_lines / greatest(n_lines, 1)", 120),
    "repeats": ("1000 * n_repeat_words / greatest(n_words, 1)", 75),
    "word_length": ("100 * word_chars / greatest(n_words, 1)", 50),
}
_POWER = "(length(bin(v)) - 5)"
_FLOOR = "(CASE WHEN {q} < 32 THEN {q} ELSE ({q} - ({q} // 16 - 1) * 16) * CAST(pow(2, {q} // 16 - 1) AS BIGINT) END)"


def _limits(name: str, groups: str) -> str:
    keys = f"{groups}, " if groups else ""
    by = f"PARTITION BY {keys}rule"

    def quantile(q: float) -> str:
        return _FLOOR.format(q=f"min(step) FILTER (WHERE upto >= {q} * whole)")

    return f"""{name} AS (
  SELECT {keys}rule, n, q90 + 4 * greatest(q90 - q50, spread) AS high,
    CASE WHEN rule = 'word_length' THEN q10 - 4 * greatest(q50 - q10, spread) END AS low
  FROM (
    SELECT {keys}rule, spread, sum(n) AS n, {quantile(0.1)} AS q10, {quantile(0.5)} AS q50, {quantile(0.9)} AS q90
    FROM (SELECT *, sum(n) OVER ({by} ORDER BY step) AS upto, sum(n) OVER ({by}) AS whole
          FROM (SELECT {keys}rule, spread, step, count(*) AS n FROM steps GROUP BY ALL))
    GROUP BY {keys}rule, spread))"""


QUALITY = rf"""WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS k
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1)
  GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM d LEFT JOIN again USING (doc_id)),
vals AS ({' UNION ALL '.join(f"SELECT doc_id, lang, source, '{name}' AS rule, {spread} AS spread, CAST(floor({value}) AS BIGINT) AS v FROM m WHERE n_words > 0" for name, (value, spread) in _RULES.items())}),
steps AS (SELECT *, CASE WHEN v < 16 THEN v ELSE {_POWER} * 16 + (v // CAST(pow(2, {_POWER}) AS BIGINT)) END AS step FROM vals),
{_limits('fine', 'lang, source')}, {_limits('coarse', 'lang')}, {_limits('everything', '')},
judged AS (
  SELECT v.doc_id, v.rule,
    v > CASE WHEN f.n >= 100 THEN f.high WHEN c.n >= 100 THEN c.high ELSE e.high END
      OR coalesce(v < CASE WHEN f.n >= 100 THEN f.low WHEN c.n >= 100 THEN c.low ELSE e.low END, false) AS fails
  FROM vals v JOIN fine f ON f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source AND f.rule = v.rule
  JOIN coarse c ON c.lang IS NOT DISTINCT FROM v.lang AND c.rule = v.rule JOIN everything e ON e.rule = v.rule),
failed AS (
  SELECT doc_id, string_agg(rule, ',' ORDER BY list_position({list(_RULES)}, rule)) AS failed_rules
  FROM judged WHERE fails GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND failed_rules IS NULL AS kept,
  coalesce(failed_rules, '') AS failed_rules
FROM m LEFT JOIN failed USING (doc_id)"""

# What the article of each of the given pages holds, which mark it as such, by plain replacements; they have
# the references named here only.
_REFERENCES = {"&quot;": '"', "&lt;": "<", "&gt;": ">", "&#x27;": "''", "&#39;": "''", "&amp;": "&", "&amp": "&"}
_ARTICLE = r"regexp_extract(html, '<article>(.*)</article>', 1, 's')"
_BLOCKS = rf"regexp_replace(regexp_replace({_ARTICLE}, '</?(p|h1)>', chr(30), 'g'), '<[^>]*>', ' ', 'g')"
_DECODED = "block"
for _reference, _letter in _REFERENCES.items():
    _DECODED = f"replace({_DECODED}, '{_reference}', '{_letter}')"

MAIN_TEXT = rf"""WITH b AS (
  SELECT page_id, url, list_transform(string_split({_BLOCKS}, chr(30)),
    lambda block: trim(regexp_replace({_DECODED}, '\s+', ' ', 'g'))) AS blocks FROM pages)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars
FROM (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)"""


def _rounds(last: int) -> str:
    """Centroids after each round and the nearest ones of each vector: c0, a0, c1 ... a<last>."""
    out = []
    for i in range(last + 1):
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT * FROM (SELECT x.rid, c.c, sum((x.val - c.val) * (x.val - c.val)) AS d FROM x JOIN c{i} c USING (dim) GROUP BY x.rid, c.c)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)""")
        if i < last:
            out.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, dim, coalesce((s - ((s % n) + n) % n) // n, val) AS val
  FROM c{i} LEFT JOIN (SELECT c, dim, sum(val) AS s, count(*) AS n FROM a{i} JOIN x USING (rid) GROUP BY c, dim) USING (c, dim))""")
    return ",\n".join(out)


CLUSTERS = f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT rid, unnest(vec) AS val, generate_subscripts(vec, 1) AS dim FROM v),
c0 AS MATERIALIZED (
  SELECT c, unnest(vec) AS val, generate_subscripts(vec, 1) AS dim
  FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), vec) - 1 AS c, vec FROM v) WHERE c < 8),
{_rounds(10)},
prints AS (SELECT c, sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c10 GROUP BY c),
inertia AS (SELECT c, sum(d) AS total FROM a10 GROUP BY c)
SELECT vec_id, CAST(a10.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(total AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(d) FROM a10) AS BIGINT) AS inertia, centroid_sha256
FROM a10 JOIN v USING (rid) JOIN prints ON prints.c = a10.c JOIN inertia ON inertia.c = a10.c"""

DIVERGENCE = rf"""WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
tok AS MATERIALIZED (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
found AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, sum(c) AS n FROM found GROUP BY lang, source),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
    1 + CAST(1000000000 * (coalesce(c, 0) + 1) AS BIGINT) // CAST(coalesce(n, 0) + v AS BIGINT) AS p
  FROM grp g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source)
  LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
whole AS (
  SELECT lang, term, 1 + CAST(1000000000 * (sum(c) + 1) AS BIGINT) // CAST(total + v AS BIGINT) AS q
  FROM found JOIN v USING (lang) JOIN (SELECT lang, sum(c) AS total FROM found GROUP BY lang) USING (lang) GROUP BY lang, term, total, v),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
  FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200"""

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": REPEATS,
    "op6_jaccard_join": NEAR_DUPLICATES,
    "op7_quality_rules": QUALITY,
    "op8_decontamination": CONTAMINATION,
    "op11_html_extraction": MAIN_TEXT,
    "op12_centroid_clusters": CLUSTERS,
    "op13_source_divergence": DIVERGENCE,
}
