"""Pages in layouts that training does not name, broken pages, and edges of the extractor."""

import html
import time

import duckdb

from vectrail.llm import html_blocks

SF = "/root/testdata/sf0.001"


def test_scanning_takes_linear_time():
    pages = ['<p "' + "<p x " * 200_000, '<a "' + "<b '>' " * 150_000, "<div>x" * 50_000, "<script>" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<p " * 300_000, "<!--" * 200_000, '<p class="' * 100_000, "&lt;" * 200_000]
    for page in pages:
        began = time.process_time()
        html_blocks.blocks(page)
        assert time.process_time() - began < 5, page[:20]


def texts(page):
    return [b.text for b in html_blocks.blocks(page)]


def test_broken_pages():
    assert texts('<p title="a > b">one</p><p>two') == ["one", "two"]
    assert texts('<p title="never closed>one</p><p>two</p>') == ["one", "two"]
    assert texts("a < b and c <= d<p>x &amp; y") == ["a < b and c <= d", "x & y"]
    assert texts("<p>one<script>if (a < b) '</p>'</script> more</p><style>p {}</style><!-- <p>no --><p>last") == ["one more", "last"]
    assert texts("<script>never closed <p>x</p>") == [] == texts(None) == texts("") == texts(" \n ")
    assert texts("</div></p>x<li>a<li>b</ul>y") == ["x", "a", "b", "y"]
    assert texts("tail <p") == ["tail <p"]
    assert texts("<P>One<BR>two <B>three</B></P>") == ["One two three"]


def test_layouts_without_names(spark):
    rows = duckdb.connect().execute(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()
    long = [b.text for (h,) in rows for b in html_blocks.blocks(h) if len(b.text) > 120 and b.text[-1] == "."]
    main = long[5:9]
    p = "".join(f"<p>{html.escape(x)}</p>" for x in main)
    nav = "<a href=/a>Home</a> <a href=/b>About us</a> <a href=/c>Contact</a>"
    pages = {
        -1: f"<html><body><div>{nav}</div><div class=text>{p}</div><div>Copyright 2024</div></body></html>",
        -2: f"<html><body>{p}</body></html>",
        -3: f"<html><body><table><tr><td><a href=/a>Home</a></td><td><a href=/b>News</a></td></tr><tr><td>{p}</td></tr></table></body></html>",
        -4: f"<html><body><nav>{nav}</nav><div class='cookie-notice'>{html.escape(long[1])}</div><main>{p}</main><footer>{html.escape(long[2])}</footer></body></html>",
    }
    d = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").union(spark.createDataFrame([(k, None, v) for k, v in pages.items()], "page_id bigint, url string, html string"))
    got = {r["page_id"]: r["text"].split("\n") for r in html_blocks.extract(d).where("page_id < 0").collect()}
    kept = {k: sum(x in got[k] for x in main) for k in pages}
    other = {k: len(got[k]) - kept[k] for k in pages}
    assert sum(kept.values()) >= 14 and min(kept.values()) >= 3 and sum(other.values()) <= 1, (kept, other)


def test_every_word_counts():
    one, two = (html_blocks.vectors(html_blocks.blocks("<p>" + " ".join(["same"] * 30 + [w] * 30) + "</p>")) for w in ("left", "right"))
    assert (one != two).any()


def test_extract_edges(spark):
    schema = "page_id bigint, url string, html string, text string, `a.b` int, n_chars long"
    page = "<body><nav><a href=x>menu</a></nav><article>" + "<p>Some words of the text that go on.</p>" * 3 + "</article></body>"
    rows = [(1, "u", page, "x", 1, 2), (1, "u", page, "x", 1, 2), (None, None, page, None, None, None), (2, "v", "<article>" + "<p>word and word.</p>" * 20_000 + "</article>", None, None, None), (3, "w", "", None, None, None)]
    got = html_blocks.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and {r["n_chars"] == len(r["text"]) for r in got} == {True}
    same = "\n".join(["Some words of the text that go on."] * 3)
    assert sorted(r["text"] == same for r in got) == [False, False, True, True, True]
    assert next(r["text"] for r in got if r["page_id"] == 2).count("\n") == 19_999
    assert html_blocks.extract(spark.createDataFrame([], schema)).count() == 0
