import duckdb
import pytest

from umbrascan.llm import main_text, queries
from umbrascan.llm.main_text import main_text as text_of

LONG = "Plain words that run on for a while, as an article's do, with commas and more words. "
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
ASIDE = '<aside><p>Sidebar text</p></aside><div class="cookie-notice">We use cookies</div><form><p>Your name</p><input></form>'
COMMENTS = '<section id="comments"><article class="comment"><p>' + "A reader says a lot of words here. " * 30 + "</p></article></section>"
FOOT = "<footer>&copy; Someone</footer></body></html>"


def page(inside, before=NAV, after=ASIDE + COMMENTS):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{before}{inside}{after}{FOOT}"


PARTS = ["A title", LONG * 3, "Short.", LONG * 2, "one two three", "x < y & z > w"]
BODY = (
    f"<h1>A title</h1><p>{LONG * 3}</p><p><b>Short.<br><p>{LONG * 2}<div class=ad>Buy</div><p>one\n two&nbsp;<i>three</i></p>"
    "<p>x &lt; y &amp; z &gt; w</p><!-- hidden <p>no</p> --><noscript>no</noscript>"
)
WANTED = "\n".join(" ".join(p.split()) for p in PARTS)


@pytest.mark.parametrize(
    "inside",
    [
        f"<article>{BODY}</article>",
        f"<main><article class='post has-sidebar'>{BODY}</article></main>",
        f"<main>{BODY}</main>",
        f"<div class='page'><div class='entry'>{BODY}</div></div>",
        f"<div>{BODY}</div>",
        f"<ARTICLE><DIV><SECTION>{BODY}</SECTION></DIV></ARTICLE>",
        f"<form action='/whole'><article>{BODY}</article></form>",
        f"<article><h1>A title</h1><div>{BODY[16:]}</div></article>",
    ],
)
def test_layouts(inside):
    assert text_of(page(inside)) == WANTED


def test_unclosed_menu_and_page():
    assert text_of(page(f"<article>{BODY}</article>", before="<nav><ul><li><a href=/a>Home", after="")) == WANTED
    assert text_of(f"<nav><a href=/>x</a></nav><article>{BODY}") == WANTED


def test_odd_pages():
    assert text_of("") == text_of("<html></html>") == text_of("<p> </p>") == text_of("<!-- only") == text_of("<script>x") == ""
    assert text_of("just text &amp; no tags") == "just text & no tags"
    assert text_of("a < b <3 <p>c</p>") == "a < b <3\nc"
    assert text_of('<p title="a>b">c</p><p title="never closed>d</p>').startswith("c")
    assert text_of("<article><p>&amp;lt; &#65;&#x42; &ampx &unknown; &am</p></article>") == "&lt; AB &x &unknown; &am"
    assert text_of("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul><dl><dt>f<dd>g</dl></article>") == "a\nb\nc\nd\ne\nf\ng"
    deep = "<div>" * 30_000 + "deep" + "</b></div>" * 30_000
    assert text_of(deep) == "deep"
    assert text_of("<article>" + "<p>word " * 50_000) == "\n".join(["word"] * 50_000)
    assert text_of("<b><i>" * 20_000 + "x" + '<a "' * 2000) == "x"


def test_links_lower_the_density():
    links = "".join(f'<p><a href="/{i}">{LONG}</a></p>' for i in range(30))
    words = "".join(f"<p>{LONG}<a href=/x>more</a></p>" for _ in range(5))
    assert text_of(f"<div>{links}</div><div>{words}</div>") == "\n".join([LONG + "more"] * 5)


def test_frames(spark, sf):
    rows = [(1, "u", page(f"<article>{BODY}</article>"), "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, main_text.extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", WANTED, len(WANTED)), (2, None, "", 0), (3, "v", "", 0), (None, "w", "a", 1), (1, "u", "a", 1)], key=repr)
    assert main_text.extract(df.limit(0)).collect() == []
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    want = con.sql(queries.oracles()["op13_main_text"])
    assert sorted(map(tuple, queries.op13_main_text(spark, sf).select(*want.columns).collect())) == sorted(want.fetchall())
