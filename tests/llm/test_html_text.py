import time

import pytest

from inkstone.llm import html_text
from tests.llm.conftest import rows

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head>
<body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad-box">Buy</div><div id="cookie-notice">Accept</div>
<article><header><h1>Title{n}</h1></header><p><b>First&nbsp;part &lt;{n}&gt;<br>second <i>w</i>ord.<p>Third &eacute;&#233;&amp;</p>
<form><input name=q>search</form><aside>related</aside><ul><li>one</li><li class=share>share me<li>two</ul>
<section class="comments"><article><p>reader says</p></article></section>tail</article>
<div class='sidebar widget'>side</div><footer>&copy; foot</footer></body></html>"""


def text_of(page):
    t, blocks, _ = html_text.settle(html_text.parse(page))
    return t if t is not None else " ".join(blocks)


def test_an_article_without_what_surrounds_it():
    assert text_of(PAGE.format(n=1)) == "Title1 First part <1> second word. Third éé& one two tail"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain text  only", "plain text only"),
        ("<p>a</p><p>b", "a b"),
        ("<div>open<nav>menu</div>", "open"),  # never closed
        ("<nav>menu<article>text</article>", "text"),
        ("<main><p>x<script>if(a<b){}</script>y</main><p>z", "x y"),
        ("<p>1 < 2 & 3</p>", "1 < 2 & 3"),
        ("<p class=ad>no<p>yes", "yes"),
        ("<article>a<div style='display:none'>hid</div>b</article>", "a b"),
        ("<article><p>one</p></article><p>x</p><article>two</article>", "one two"),
        ("<article>w<b>or</b>d</article>", "word"),
        ("<ARTICLE>Caps<BR/>line</ARTICLE>", "Caps line"),
        ("<article>x</article", "x"),
    ],
)
def test_odd_markup(page, text):
    assert text_of(page) == text


def test_repeated_runs_are_those_of_brute_force():
    import random

    r = random.Random(4)
    streams = [" ".join(r.choice("abc") for _ in range(r.randrange(0, 40))) for _ in range(30)]
    h, several = html_text.repeated_runs(streams, 5)
    seen = {}
    for i, s in enumerate(streams):
        w = s.split()
        for j in range(len(w) - 4):
            seen.setdefault(tuple(w[j : j + 5]), set()).add(i)
    assert len(h) == len(set(h.tolist())) == len(seen)
    assert int(several.sum()) == sum(len(v) > 1 for v in seen.values())


def test_open_pages_lose_what_their_host_repeats(spark, prose):
    menu, own = "Home News Sports Weather Contact About Imprint Privacy Terms", [prose(i, 40) for i in range(4)]
    pages = [(i, f"http://h.example.com/{i}", f"<div>{menu}</div><div>{own[i]}</div>") for i in range(3)]
    pages += [(3, "http://other.example.com/", f"<div>{menu}</div><div>{own[3]}</div>"), (4, None, None), (None, "http://x/", ""), (5, "x", PAGE.format(n=5)), (5, "x", PAGE.format(n=5))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'t' as text", "0 as row", "'h' as host")
    for shard in (400_000, 1):  # whole hosts, and hosts dealt into pieces
        html_text.SHARD_TOKENS = shard
        out = html_text.extract_pages(df)
        got = rows(out, "page_id", "text", "n_chars")
        want = [(i, own[i]) for i in range(3)] + [(3, f"{menu} {own[3]}"), (4, ""), (None, ""), (5, text_of(PAGE.format(n=5))), (5, text_of(PAGE.format(n=5)))]
        assert got == sorted(((i, t, len(t)) for i, t in want), key=lambda t: (t[0] is None, t))
    html_text.SHARD_TOKENS = 400_000
    assert html_text.extract_pages(df.limit(0)).collect() == []


def test_copies_and_quoted_sentences_keep_their_text(spark, prose):
    menu, quote = "Home News Sports Weather Contact About Imprint Privacy Terms", prose(90, 15)
    own = [prose(i, 40) for i in range(12)]
    body = [f"{own[i]} {quote}" if i < 2 else own[i] for i in range(12)]
    pages = [(i, f"http://h.example.com/{i}", f"<div>{menu}</div><div>{body[i]}</div>") for i in range(12)]
    pages += [(100 + i, "http://h.example.com/copy", f"<div>{menu}</div><div>{body[5]}</div>") for i in range(6)]
    pages += [(200 + i, "http://copies.example.com/", f"<div>{body[7]}</div>") for i in range(4)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = [(i, body[i]) for i in range(12)] + [(100 + i, body[5]) for i in range(6)] + [(200 + i, body[7]) for i in range(4)]
    for shard in (400_000, 1):
        html_text.SHARD_TOKENS = shard
        assert rows(html_text.extract_pages(df), "page_id", "text") == want
    html_text.SHARD_TOKENS = 400_000


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="content-sidebar-wrap"><div>x</div><article>a<p class=ad>no</p></article></div>', "a"),
        ('<div class="page has-widget"><main>a</main></div><div class="widget-area">w</div>', "a"),
        ('<div class="has-widget">text</div><div class="widget-area">w</div><div id=top-bar>t</div>', "text"),
        ('<div class="sidebar"><article>the whole page</article></div><div>x</div>', "the whole page"),
        ("<form><div><article>the whole page</article></div></form>", "the whole page"),
        ('<div>the body of this page</div><section class="comments"><article>a reader</article></section>', "the body of this page"),
    ],
)
def test_names_within_names_and_wrappers_keep_the_article(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize("part", ['<a x="', "<b ", "<head>", "<a \"'", "</script ", "<script ", "<!x ", "<article></main>", "<a x=\"'>"])
@pytest.mark.parametrize("end", ["", '">', "-->"])
def test_a_broken_page_takes_time_linear_in_its_length(part, end):
    start = time.perf_counter()
    html_text.parse(part * (1_000_000 // len(part)) + end)
    assert time.perf_counter() - start < 10  # an hour, if every tag were tried to the page's end
