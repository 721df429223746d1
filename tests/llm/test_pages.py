import hashlib
import time
from collections import Counter

import numpy as np

from docsleuth.llm import html_extract, warc

PAGE = (
    '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="</p>";</script></head><body><header>Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First  paragraph\nwith &lt;b&gt; words.<p>Second<br>one.</p><div class="ad">buy this now</div><ul><li>item</li></ul></article>'
    '<section id="comments"><p>A reader says very many words that are not of the article at all</p></section><aside>Side</aside><footer>&copy; me</footer></body></html>'
)
TEXT = "Head & line\nFirst paragraph with <b> words.\nSecond one.\nitem"


def test_extract():
    assert html_extract.extract(PAGE, html_extract.DEFAULT) == TEXT
    assert html_extract.extract(PAGE[: PAGE.index("<section")], html_extract.DEFAULT) == TEXT
    plain = PAGE.replace("<article>", '<div id="content">').replace("</article>", "</div>")
    assert html_extract.extract(plain, html_extract.DEFAULT) == TEXT
    for odd in ("", "<", "<p", "</div>", "<!--", "<script>", "<nav>menu"):
        html_extract.extract(odd, html_extract.DEFAULT)
    assert html_extract.extract("just text &amp; more", html_extract.DEFAULT) == "just text & more"


def test_region_against_all_pairs():
    """The linear scan finds the largest sum of any contiguous part; it alone decides where the text is, also without content elements or noise left out."""
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 40):
        for _ in range(20):
            scores = rng.integers(-5, 6, n).tolist()
            start, stop = html_extract.best_region(scores)
            assert sum(scores[start:stop]) == max([0, *(sum(scores[i:j]) for i in range(n) for j in range(i, n + 1))])
    for page in (PAGE, PAGE.replace("article>", "div>")):
        found = html_extract.scored_events(page.replace('<div class="ad">buy this now</div>', ""), html_extract.DEFAULT, {})
        start, stop = html_extract.best_region([x[0] for x in found])
        assert html_extract.joined([(*x[:3], False) for x in found[start:stop]]) == TEXT != html_extract.joined([(*x[:3], False) for x in found])


def test_names_and_unclosed_elements():
    extract = lambda page: html_extract.extract(page, html_extract.DEFAULT)
    assert extract('<div class="article-header"><h1>Title</h1></div><p>text one two three') == "Title\ntext one two three"
    assert extract('<article><section id="search-algorithms"><p>alpha beta</p></section><p class="related work">gamma</p></article>') == "alpha beta\ngamma"
    assert extract('<article><ul><li class="nav-item">a<li>b</ul><p>rest') == "a\nb\nrest"
    assert extract('<article><p class="ad">buy this<p>real text here</article>') == "real text here"
    assert extract("<body><article><p>one two</article><article><p>three four</article>") == "one two\nthree four"
    assert extract("<article><p>Press <label>Enter</label> and <button>OK</button> now</p></article>") == "Press Enter and OK now"
    assert extract("<nav>menu one two<article><p>content words here</p></article>") == "content words here"
    assert extract('<div><p>many good words of prose stand here</p><p><a href="x">one two three</a></p></div>') == "many good words of prose stand here"


def test_learned_names():
    """Names that stand beside content on labelled pages are noise on pages without a content element; those of wrappers are not."""
    total = Counter()
    for i in range(50):
        total.update(html_extract.count(f'<div class="wrap"><div class="zork"><p>some words of no use {i}</p></div><article><h1>Head</h1><p>{"good word " * 20}</p></article></div>'))
    w = html_extract.weights(total)
    assert w[".zork"] == -3 and w[".wrap"] > 0 and w["w p"] > 0.5
    page = '<div class="wrap"><p>one two three four and more words</p><div class="zork"><p>some words of no use</p></div><p>five six seven eight and more words</p></div>'
    assert html_extract.extract(page, w) == "one two three four and more words\nfive six seven eight and more words"
    assert "of no use" in html_extract.extract(page, html_extract.DEFAULT)


def test_broken_pages_take_linear_time():
    for odd in ("<a " * 200_000, '<a "' * 200_000, "<" * 100_000, "<!" * 100_000, "</" * 100_000, "<div>" * 50_000, '<a b="' * 100_000, "<head>" * 50_000, "<script>" + "</script" * 50_000, "<p>" + "<b>x" * 30_000 + "</p>" * 30_000, "<li>" * 30_000):
        began = time.perf_counter()
        html_extract.extract(odd, html_extract.DEFAULT)
        assert time.perf_counter() - began < 5


def pages(spark):
    big = "x" * 1500
    rows = [(1, "http://a/1", PAGE), (2, "http://a/2", big), (3, "http://a/3", big), (4, "u", big), (5, None, None), (6, "http://a/6", "small"), (7, "http://a/7", "small"), (8, "a\r\nb", "WARC/1.1\r\n\r\n\n" * 200), (9, "u", "é" * 700), (9, "u", "é" * 700), (None, "n", "no id")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string"), rows


def test_main_text(spark):
    df, rows = pages(spark)
    found = {r["page_id"]: r for r in html_extract.main_text(df).collect()}
    assert found[1]["text"] == TEXT and found[1]["n_chars"] == len(TEXT) and found[5]["text"] == ""
    assert html_extract.main_text(df.limit(0)).count() == 0 and html_extract.main_text(df).count() == len(rows)


def test_round_trip(spark):
    df, rows = pages(spark)
    found = sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = max((k for k, _, x in rows if x == h and k is not None), default=None) if len(b) >= 1000 else i
        want.append((i or -1, len(b), hashlib.sha1(b).hexdigest(), "response" if same == i else "revisit", None if same == i else same))
    assert found == sorted(want, key=str) or sorted(found, key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_parse(spark, tmp_path):
    df, rows = pages(spark)
    warc.write(df, str(tmp_path / "w"), records_per_file=6)
    found = warc.records(spark, str(tmp_path / "w")).collect()
    assert len(found) == 3 * len(rows)
    bodies = {bytes(r["payload"]).decode() for r in found if r["record_type"] == "response"}
    assert {h or "" for _, _, h in rows} == bodies
    nested = warc.captures(warc.records(spark, str(tmp_path / "w"))).where("fields['pageId'] = '1'").first()
    assert nested["request"]["concurrent_to"] == nested["response"]["record_id"] == nested["metadata"]["concurrent_to"]


def test_text_ids(spark):
    """Null ids and ids with line breaks, percent signs and colons come back as they were."""
    ids = [None, "null", "a\r\nb", "100%0A", "x: y", ""]
    df = spark.createDataFrame([(i, "http://u\r\nX: y", f"<p>{k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    assert sorted(map(str, (r["page_id"] for r in warc.round_trip(df).collect()))) == sorted(map(str, ids))
    big = spark.createDataFrame([(i, "u", "x" * 2000) for i in ids], "page_id string, url string, html string")
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(big).collect()}
    assert found == {i: ("response", None) if i == "x: y" else ("revisit", "x: y") for i in ids}
