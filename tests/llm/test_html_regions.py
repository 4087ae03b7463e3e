"""Main text of pages: regions by brute force, pages made by hand, and the tables' own marked articles."""

import html
import random
import re

import pytest

from concordat.llm import html_regions as H
from concordat.llm.catalog import read

SF = "/root/testdata/sf0.01"
PLAIN = H.Weights(H.PRIOR, {})


def text(page, weights=PLAIN):
    return H.extract(page, H.Contexts(weights, known_only=True))


def test_best_region_by_brute_force():
    r = random.Random(3)
    for _ in range(400):
        s = [r.randrange(-4, 5) for _ in range(r.randrange(0, 14))]
        runs = [(sum(s[i:j]), -j, i) for j in range(1, len(s) + 1) for i in range(j)]
        best = max(runs, default=(0, 0, 0))
        assert H.best_region(s) == ((best[2], -best[1]) if best[0] > 0 else (0, 0))


PROSE = ["The harbour was quiet when the first boats came in before sunrise.", "Nobody on the pier had slept, and the coffee was cold by then.", "It took until noon to unload all of it & count the crates."]
BODY = "".join(f"<p>{html.escape(p)}</p>" for p in PROSE)
WHOLE = "\n".join(PROSE)
AROUND = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">News of the day</a></li></ul></nav>'
CASES = {
    "article": (f"<html><head><title>T</title></head><body>{AROUND}<article><h1>Boats</h1>{BODY}</article><footer>&copy; us</footer></body></html>", "Boats\n" + WHOLE),
    "no marks but a div": (f'<body><div id="top-menu">Home News Sport Weather</div><div><h1>Boats</h1>{BODY}</div><div class="site-footer">All rights reserved by us and them</div></body>', "Boats\n" + WHOLE),
    "sidebar, comments, form": (
        f'<body><main><div class="col">{BODY}</div><aside><p>Ten things that you should read today, by our own staff, and more</p></aside><div id="comments"><p>First! I was there and it was not like that at all, believe me.</p></div>'
        "<form><label>Mail</label><input name=q><button>Subscribe to all of our letters</button></form></main></body>", WHOLE),
    "advert and cookie notice inside": (f'<article>{BODY[: BODY.index("</p>") + 4]}<div class="ad-slot"><p>Buy two, get three, only this week</p></div><div class="cookie-notice">We use cookies</div>{BODY[BODY.index("</p>") + 4 :]}</article>', WHOLE),
    "references and white space": ("<article><p>A&nbsp;b &lt;c&gt; &#233;&eacute; &amp;amp;\n\n\t d</p></article>", "A b <c> éé &amp; d"),
    "inline and br": ("<article><p>bo<b>ld</b>ly <i>go</i><br>there<!-- not > here --> now</p>tail<div>end</div></article>", "boldly go there now\ntail\nend"),
    "lists and tables": ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></article>", "one\ntwo\na\nb\nc"),
    "scripts": ('<article><p>before</p><script>var t="<p>no</p>"; if (a<b) x();</script><style>p{}</style><p>after it</p></article>', "before\nafter it"),
    "broken": ("<article><p><b>one two<br><p>three < four a<5 </b>five<p class='x", "one two\nthree < four a<5 five"),
    "attributes with signs": ('<article><p title="a > b" data-x=\'>\' alt=it\'s>text here</p></article>', "text here"),
    "unclosed script": ("<article><p>some words here</p><script>never ends <p>x", "some words here"),
    "unclosed comment": ("<article><p>some words here</p><!-- never ends <p>x", "some words here"),
    "header of the page and of the article": (f"<body><header><p>The Daily Paper of the Town and its Harbour</p></header><article><header><h1>Boats</h1></header>{BODY}<footer>Filed under: sea</footer></article></body>", "Boats\n" + WHOLE),
    "a comment that is an article": (f'<body><article>{BODY}<section><article class="comment"><p>I liked it very much, thank you for writing</p></article></section></article></body>', WHOLE),
    "class that speaks of something else": (f'<body class="has-sidebar"><article class="post no-comments ad-free">{BODY}</article></body>', WHOLE),
    "hidden": (f'<article>{BODY}<div hidden>secret words</div><p style="display: none">more of them</p></article>', WHOLE),
    "nothing": ("<html><body><nav>Home</nav></body></html>", ""), "empty": ("", ""), "only text": ("just  some text", "just some text"),
}


@pytest.mark.parametrize("name", CASES)
def test_pages_by_hand(name):
    page, want = CASES[name]
    assert text(page) == want


def test_linear_in_size():
    import time

    for part in ("<b>", "<div>", "<i><div><b></i>", "</p>", '<a "', "<a ='", "<!", "<p>x<li>", "<", "x <y "):
        began = time.time()
        text("<article><p>some words</p>" + part * 60_000)
        assert time.time() - began < 20, part


def marked(page):
    """The article of the tables' pages, which have h1 and p in it and nothing nested."""
    inside = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = re.split(r"</?(?:p|h1)>", inside)
    parts = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in blocks)
    return "\n".join(p for p in parts if p)


def test_articles_of_the_table(spark):
    pages = read(spark, SF, "pages")
    rows = {r.page_id: r for r in pages.collect()}
    for r in H.main_text(pages).collect():
        assert r.text == marked(rows[r.page_id].html) and r.n_chars == len(r.text) and r.url == rows[r.page_id].url


def test_unmarked_pages_by_what_marked_ones_teach(spark):
    """Weights from half of the pages; the other half without its marks."""
    pages = read(spark, SF, "pages")
    w = H.fit(pages.where("page_id % 2 = 0"))
    assert w.odds["ad"] < -3 and w.odds["<nav"] < -3 and w.outside["p"] < 0.1
    for r in pages.where("page_id % 2 = 1").collect():
        page = re.sub(r"</?article>", lambda m: m[0].replace("article", "div"), r.html)
        assert text(page, w) == marked(r.html)


def test_words_of_unknown_classes_are_learned(spark):
    """A class that no list names, always outside of what pages mark, is left out of pages that mark nothing."""
    junk = '<div class="zzfiller"><p>Call now and get all of it for free, today and every day until the end of it</p></div>'
    rows = [(k, f"http://h/{k}", f"<body>{junk}<article>{BODY}</article>{junk}</body>") for k in range(40)]
    w = H.fit(spark.createDataFrame(rows, "page_id long, url string, html string"))
    page = f"<body><div>{BODY}{junk}{BODY}</div></body>"
    assert "Call now" in text(page) and text(page, w) == WHOLE + "\n" + WHOLE


def test_odd_tables(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", f"<article>{BODY}</article>"), (3, "w", "<p>" + "word " * 200_000), (3, "w", "<p>" + "word " * 200_000), (4, "x", "<article>" * 3)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    for extra in ((), ("text", "kind", "what", "h", "n_chars")):
        for name in extra:
            d = d.withColumn(name, d["url"])
        got = sorted(((r.page_id, r.url, r.n_chars) for r in H.main_text(d).collect()), key=str)
        assert got == sorted([(1, "u", 0), (2, None, 0), (None, "v", len(WHOLE)), (3, "w", 999_999), (3, "w", 999_999), (4, "x", 0)], key=str)
    assert H.main_text(d.limit(0)).collect() == []
