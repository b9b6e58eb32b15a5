"""Main text of pages: hosts whose template no name gives away, pages that name their parts, and awkward markup."""

from __future__ import annotations

import random
import time

from marketlens.llm import _dom, html_extract, queries

SCHEMA = "page_id long, url string, html string"


def texts(page: _dom.Page) -> list[str]:
    return [t for t, ok in zip(page.texts, page.allowed, strict=True) if ok]


def site(host: str, n: int, seed: int, opaque: bool = True) -> tuple[list[tuple], dict[int, str]]:
    """Pages of a host with a menu, a banner of three texts, an article of some blocks and a foot; and the articles."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    menu, foot, banners = [text(2) for _ in range(5)], text(9), [text(6) for _ in range(3)]
    rows, want = [], {}
    for i in range(n):
        title, body = text(5), [text(rng.randint(8, 40)) for _ in range(rng.randint(1, 9))]
        page = "".join(f"<li><a href=/{x}>{x}</a></li>" for x in menu)
        parts = "".join(f"<p>{x}</p>" for x in body)
        names = ("x1", "x2", "x3", "x4") if opaque else ("nav", "ad", "content", "footer")
        html = f"<html><body><div class={names[0]}><ul>{page}</ul></div><div class={names[1]}>{rng.choice(banners)}</div><div class={names[2]}><h1>{title}</h1>{parts}</div><div class={names[3]}>{foot} {i}</div></body></html>"
        key = seed * 1000 + i
        rows.append((key, f"https://{host}/{i}", html))
        want[key] = " ".join([title, *body])
    return rows, want


def test_template_without_names(spark):
    rows, want = [], {}
    for k in range(3):
        r, w = site(f"h{k}.example", 12 + 9 * k, k + 1)
        rows, want = rows + r, want | w
    for parts in (1, 5):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want


def test_wrappers_of_many_tasks_merge(spark, monkeypatch):
    rows, want = site("h.example", 40, 1)
    monkeypatch.setattr(html_extract, "FAN_IN", 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(20)
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", -1)
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want


def test_copies_are_no_template(spark):
    """Copies of an article under several addresses don't make it part of the template."""
    rows, want = site("h.example", 8, 1)
    rows += [(900 + i, f"https://h.example/c{i}", rows[0][2]) for i in range(30)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want | {900 + i: want[1000] for i in range(30)}


def test_page_with_names():
    html = """<!DOCTYPE html><html><head><title>T &amp; T</title><style>p > a {}</style></head><body class="has-sidebar comments-on">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <main><article><header><h1>The <em>title</em>&nbsp;here</h1><span class="byline">By A</span></header><p>One&lt;two &#233;&eacute;<br>three
      four<p>Fi<b>v</b>e<div class="share-box">Share this</div><script>var x = "</p><p>no";</script><ul><li>six<li>seven</ul><pre>a
      b</pre></article><section id="comments"><h3>Comments</h3><article><p>Nice!</p></article></section></main>
    <aside>More</aside><form>Name <button>Send</button></form><div class="sideBar">Side</div><footer>&copy; A</footer></body></html>"""
    assert texts(_dom.Page(html)) == ["The title here", "One<two éé three four", "Five", "six", "seven", "a b"]


def test_markup_that_is_not_well_formed():
    assert texts(_dom.Page("plain text only")) == ["plain text only"]
    assert texts(_dom.Page("a < b and c > d")) == ["a < b and c > d"]
    assert texts(_dom.Page("<p>one<p>two</div></p>three<!-- <p>no</p> --><p hidden>no</p>")) == ["one", "two", "three"]
    assert texts(_dom.Page("<p title='a > b' data-x=\"</p>\">x</p><script>never closed <p>y")) == ["x"]
    assert texts(_dom.Page("<table><tr><td>a<td>b<tr><td>c</table>")) == ["a", "b", "c"]
    assert texts(_dom.Page("<p>x <!-- open <p>y</p>")) == ["x y"]
    assert texts(_dom.Page("<p>&#xD800; &bogus; &amp</p>")) == ["� &bogus; &"]
    assert texts(_dom.Page("")) == []


def test_long_and_deep_pages_take_no_time():
    for html in ("<div>" * 50_000 + "x", "<p>word</p>" * 50_000, '<a ="' * 100_000 + '>', "<a " * 100_000, "</b>" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<!--" * 50_000, "<x <y " * 50_000 + ">", "&amp" * 100_000, "<script>" * 50_000, "<div><p>a</p></div>" * 20_000):
        began = time.process_time()
        page = _dom.Page(html)
        _dom.merge(_dom.Node("#root"), page.root, iter(range(10**6)).__next__)
        assert time.process_time() - began < 10, html[:20]


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, None), (None, "", ""), (2, "not an address", "<p>x</p>"), (2, "not an address", "<p>x</p>"), (3, "HTTP://User@A.Example:80/x", "<p>" + "long " * 200_000 + "</p>")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = sorted(((r.page_id or 0, r.text, r.n_chars, r.host) for r in html_extract.extract(df.withColumns({c: F.lit(1) for c in ("wrapper", "host", "slots", "text", "texts", "tree", "lead", "into", "x")})).collect()))
    assert [x[0] for x in out] == [0, 1, 2, 2, 3] and [x[1][:4] for x in out] == ["", "", "x", "x", "long"]
    assert out[4][2] == 999_999 and out[4][3] == "a.example" and out[0][3] == ""
    assert html_extract.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    """Every page of the supplied table marks its article, so a plain search gives its text."""
    import html as h
    import re

    sf = "/root/testdata/sf0.001"
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op11_html_extract(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        words = [" ".join(h.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks]
        want = " ".join(w for w in words if w)
        assert got[r.page_id] == (want, len(want))
