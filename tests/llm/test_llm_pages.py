"""Main text of pages: the parser on odd markup, the vote of a host, odd rows."""

import time

import pytest

from relaygauge.llm.html_extraction import Page, host_paths, main_text

SENTENCE = "This is a sentence of the article that has quite some words in it."


def extracted(source):
    page = Page(source)
    kinds = page.kinds()
    best = page.best(kinds)
    return "" if best is None else page.text(best, kinds)


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        ("plain text only", "plain text only"),
        ("<p>a<p>b", "a\nb"),
        ("<!-- a", ""),
        ("<!-- > <p>x</p> --><p>y", "y"),
        ("<a href='x", ""),
        ("<article><p>a &lt;b&gt; &amp;amp; &eacute;&#x41;&#66; &copy 1 &nosuch;", "a <b> &amp; éAB © 1 &nosuch;"),
        ("<article><p>one\n \t two&nbsp;three<br>four</p>five<div>six</div>seven", "one two three four\nfive\nsix\nseven"),
        ("<article><h1>T</h1><p><b>bold.<br><p>next</article><footer>f", "T\nbold.\nnext"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><pre>x\n  y</pre>", "one\ntwo\na b\nc\nx y"),
        ('<script>var t="</p><p>no</p>";</script><style>p{}</style><article><p>yes', "yes"),
        ("<title>T</title><noscript><p>no</p></noscript><article><p>yes</p><textarea>no</textarea><svg><text>no</text></svg>", "yes"),
        ("<p title='a > b'>quoted</p>", "quoted"),
        ("<article></article><p class=ad>x</p>", ""),
        ("<article><p>yes<p hidden>no<p style='display: none'>no<p aria-hidden=true>no", "yes"),
    ],
)
def test_markup(source, text):
    assert extracted(source) == text


@pytest.mark.parametrize(
    "part",
    [
        "<nav><p>{}</p></nav>",
        "<header><h1>Site</h1><p>{}</p></header>",
        "<footer><p>{}</p></footer>",
        "<aside><p>{}</p></aside>",
        "<form><p>{}</p></form>",
        '<div class="sidebar"><p>{}</p></div>',
        '<div class="cookie-notice"><p>{}</p></div>',
        '<div id="top_banner"><p>{}</p></div>',
        '<div role="alert"><p>{}</p></div>',
        '<div class="adBox"><p>{}</p></div>',
        '<section id="comments"><h2>Comments</h2><article class="comment"><p>{}</p></article></section>',
        '<div class="related-posts"><p>{}</p></div>',
    ],
)
@pytest.mark.parametrize(
    "frame",
    [
        "<body>{other}<article>{text}</article></body>",
        '<body class="has-sidebar no-comments"><div id="page">{other}<div class="content">{text}</div></div></body>',
        "<body><form action=x><div>{other}</div><main>{text}</main></form></body>",
        "<body><div class='post-body'>{text}{other}</div></body>",
    ],
)
def test_what_is_not_the_article(part, frame):
    body = f"<h1>Head line</h1><p>{SENTENCE}</p><p>Short one.</p>"
    page = frame.format(other=part.format("words that are around it and not in it, some more of them than one needs"), text=body)
    assert extracted(page) == f"Head line\n{SENTENCE}\nShort one."


def test_heading_in_the_header_of_an_article_stays():
    page = f"<body><article class='post-12'><header class='entry-header'><h1>Title</h1><p>by me</p></header><p>{SENTENCE}</p></article>"
    assert extracted(page) == f"Title\n{SENTENCE}"


def test_numbers_in_classes_are_generalised():
    paths = set()
    for n in (107, 12345):
        page = Page(f"<body><div id=p{n} class='b post-{n}'><p>{SENTENCE}</p></div>")
        paths.add(page.path(page.best(page.kinds())))
    assert paths == {"body>div#p#.b.post-#"}


@pytest.mark.parametrize(
    "source",
    ["<div>" * 60_000 + "<p>deep</p>" + "</section>" * 60_000, "<" * 50_000, '<p "' * 50_000, "<b>" * 50_000 + "</i>" * 50_000 + "<p>x" * 9, "<!-" * 50_000],
)
def test_hostile_markup_takes_linear_time(source):
    started = time.monotonic()
    extracted(source)
    assert time.monotonic() - started < 10


def page(body, advert=""):
    return f"<html><body><div class='x1'>{advert}</div><div class='text x2'>{body}</div></body></html>"


def test_the_host_outvotes_a_page(spark):
    advert = "<p>Buy all of our things, they are cheap today and you will like them a lot, dear reader.</p>"
    long = f"<p>{SENTENCE}</p>" * 5
    rows = [(i, "https://H.example.com:80/a?b", page(long, advert)) for i in range(6)]
    # This article is shorter than the advert, and a page of no host has nobody to ask.
    rows += [(6, "http://u:p@h.example.com", page("<p>Ok.</p>", advert)), (7, None, page("<p>Ok.</p>", advert)), (8, "nowhere", page(long))]
    # A second layout of the host, as frequent as it takes.
    rows += [(10 + i, "http://h.example.com/b", f"<body><main>{long}</main></body>") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    paths = {r.host: r.paths for r in host_paths(pages).collect()}
    assert paths == {"h.example.com": ["body>div.text.x2", "body>main"]}
    texts = {r.page_id: (r.text, r.agreed) for r in main_text(pages).collect()}
    body = "\n".join([SENTENCE] * 5)
    assert texts[10] == texts[11] == (body, True)
    assert texts[8] == (body, False)
    assert all(texts[i] == (body, True) for i in range(6))
    assert texts[6] == ("Ok.", True) and texts[7][0].startswith("Buy")


def test_a_short_article_is_found_where_its_host_has_it(spark):
    advert = "<section><p>Buy all of our things, they are cheap today and you will like them a lot, dear reader.</p></section>"
    long = f"<p>{SENTENCE}</p>" * 5
    rows = [(i, "http://h.example.com/a", f"<body>{advert}<div class=story>{long}</div></body>") for i in range(6)]
    rows += [(6, "http://h.example.com/b", f"<body>{advert}<div class=story><p>Ok.</p></div></body>"), (7, None, f"<body>{advert}<div class=story><p>Ok.</p></div></body>")]
    rows += [(8, "http://h.example.com/c", f"<body>{advert}<div class=story></div></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in main_text(pages).collect()}
    assert texts[6] == "Ok." and texts[8] == "" and texts[7].startswith("Buy")


def test_odd_rows(spark):
    long = f"<article><p>{'word ' * 50_000}</p></article>"
    rows = [
        (None, None, None),
        (1, None, "<p>x</p>"),
        (1, None, "<p>x</p>"),
        (2, "http://a.example.com", ""),
        (3, "http://a.example.com", None),
        (4, "http://a.example.com", long),
        (5, "not an address", "<p>\x00 \U0001f600 y</p>"),
        (6, "http://[::1]/", "   "),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text", "'c' AS path", "'c' AS _host", "'c' AS host")
    found = main_text(pages)
    assert found.columns == ["page_id", "url", "text", "path", "agreed"]
    texts = sorted(((r.page_id or 0), r.text) for r in found.collect())
    assert texts == [(0, ""), (1, "x"), (1, "x"), (2, ""), (3, ""), (4, " ".join(["word"] * 50_000)), (5, "\x00 \U0001f600 y"), (6, "")]
    assert main_text(pages.limit(0)).collect() == []
