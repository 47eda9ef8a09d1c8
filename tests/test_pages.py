"""Pages of all shapes: nesting, broken ends, metadata in order, links, patterns, encodings."""

import random
import re
from urllib.parse import urlsplit

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import pages as P

BODY = "A sentence that is long enough to count as the body of a page."


def read(html, url="https://x.org/a/b"):
    return P._read_page(html, url, None)


@pytest.mark.parametrize("html, text", [
    (f"<body><nav>menu</nav><article><p>{BODY}</p><script>var x='</p>'</script><aside>ad</aside></article><p>after</p></body>", BODY),
    (f"<body><main><div><p>{BODY}<div>more</main>after</body>", f"{BODY}\nmore"),  # unclosed tags end with main
    (f"<body><header>top</header>{BODY}</div></span><footer>end", BODY),  # stray ends close nothing
    (f"<article>{BODY}</article><article>second</article>", BODY),
    (f"<article>{BODY}<article>inner</article>tail</article>", f"{BODY}\ninner\ntail"),
    (f"<body><form><p>{BODY}</form>shown", "shown"),
    ("<body>one<br>one<br/>two  \n three<p>three</p></body>", "one\ntwo\nthree"),
    ("no tags &amp; an entity", "no tags & an entity"),
    ("<body><nav><div>x</nav>y", "y"), ("", ""), ("<!-- comment --><p>t</p><![CDATA[x]]>", "t"), ("<title>t</title><body>b</body>", "b"), ("<nav>a<nav>b</nav>c</nav>d", "d"),
])
def test_bodies(html, text):
    assert read(html)["text"] == text


def test_metadata_in_order():
    meta = lambda k, n, v: f'<meta {k}="{n}" content="{v}">'
    og, tw = meta("property", "og:title", "Og  title"), meta("name", "twitter:title", "Tw")
    assert read(tw + og)["title"] == "Og title" and read(tw)["title"] == "Tw" and read("<title>T</title><header><h1>H <b>one</b></h1></header><h1>two</h1>")["title"] == "H one" and read("<title> T\n t</title>")["title"] == "T t"
    assert read(meta("property", "og:title", "") + "<title>T</title>")["title"] == "T"
    assert read(meta("name", "author", "A") + meta("name", "publisher", "P"))["publisher"] == "P"
    assert read(meta("name", "date", "2026/1/5") + "<time datetime='2025-01-01'>x</time>")["published_date"] == "2026-01-05"
    assert read("<time>2026年2月3日</time>")["published_date"] == "2026-02-03" and read("<p>on 2026.3.4 and 2026-05-06</p>")["published_date"] == "2026-03-04"
    assert read("<time datetime='2026-13-45'>x</time><p>2026-01-02</p>")["published_date"] == "2026-01-02" and read("<p>2026-02-30</p>")["published_date"] == ""
    link = lambda h: read(f'<link rel="x canonical" href="{h}">')["canonical_url"]
    assert (link("/c?d=1"), link("mailto:a@b.c"), link("http://[bad")) == ("https://x.org/c?d=1", "", "")


def test_extracted_rows_and_notes(spark):
    rows = [(1, "https://x.org", f"<article>{BODY}</article>", "x"), (2, None, None, "x"), (3, "u", "<script>1</script>", "x"), (None, "u", f"<body>{BODY * 2000}", "x")]
    got = {r.page_id: r for r in P.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), longest=1000).collect()}
    assert got[1].ok and got[1].notes == "no_title,no_published_date,no_publisher" and got[2].notes.endswith("no_body") and got[3].notes.endswith("needs_script")
    assert got[None].truncated and len(got[None].text) <= 1000


def test_discovered_links(spark):
    html = '<a href="/n/1">One <b>b</b></a><a href="/n/1#x">again</a><a href="n/2?q=1">two</a><a href="HTTP://Y.org:80//n//3">three</a><a href="mailto:a@b">m</a><a>none</a><a href="http://[bad">bad</a><a href="/o/4"><a href="/n/5">five</a>'
    pages = spark.createDataFrame([(1, "https://x.org/a/", html), (2, "https://x.org", None)], "page_id long, url string, html string")
    get = lambda **o: [(r.position, r.url, r.title) for r in P.discovered(pages, **o).orderBy("position").collect()]
    assert get() == [(0, "https://x.org/n/1", "One b"), (1, "https://x.org/a/n/2?q=1", "two"), (2, "http://y.org/n/3", "three"), (3, "https://x.org/o/4", ""), (4, "https://x.org/n/5", "five")]
    assert [u for _, u, _ in get(prefix="/n/", pattern=r"x\.org")] == ["https://x.org/n/1", "https://x.org/n/5"]


def test_patterns_equal_a_loop(spark):
    rng = random.Random(4)
    hosts = {f"h{k}.org": ["/".join(rng.choice(["news", "a-b", "2026", "x.y"]) for _ in range(rng.randrange(4))) for _ in range(rng.choice([1, 1, 2, 3, 6]))] for k in range(60)}
    hosts["same.org"], hosts["deep.org"] = ["news/2026/1", "news/2026/2"] * 3, ["news/2026/a/1", "news/2026/a/2"]
    links = [(f"https://{h}/{p}{rng.choice(['', '/', '?q=/z'])}",) for h, ps in hosts.items() for p in ps] + [(None,), ("no url",)]
    got = {r.host: r for r in P.url_patterns(spark.createDataFrame(links, "url string")).collect()}
    for h, ps in hosts.items():
        parts = [p.split("/") for p in ps]
        n = 0
        while all(len(x) > n and x[n] == parts[0][n] for x in parts):
            n += 1
        prefix = "/" + "".join(f"{s}/" for s in parts[0][: max(0, n - 1)])
        assert (got[h].prefix, got[h].n) == (prefix, len(ps))
        assert all(re.search(got[h].pattern, u) for (u,) in links if u and urlsplit(u).hostname == h and len(urlsplit(u).path.rstrip("/")) > len(prefix))
    assert len(got) == len(hosts) and got["deep.org"].prefix == "/news/2026/" and got["same.org"].prefix == "/news/" and got["deep.org"].pattern == r"^https?://deep\.org/news/2026/.+"
    trie = {(r.host, r.prefix): r.n for r in P.path_trie(spark.createDataFrame(links, "url string")).collect()}
    assert trie["same.org", "/news/2026"] == 6 and trie["same.org", "/news/2026/1"] == 3


def test_bytes_of_mixed_encodings_in_one_folder(spark, tmp_path):
    text = "港口作业通知 é"
    files = {"a": text.encode(), "b": text.encode("gb18030"), "c": b"<meta charset='gb2312'>" + "港口".encode("gb2312"), "d": b"\xef\xbb\xbf" + text.encode(), "e": b"\xff\xfe\xff", "g": b"charset=no-such-one " + text.encode(), "h": b"charset=utf-8 " + text.encode("gb18030")}
    for n, raw in files.items():
        (tmp_path / n).write_bytes(raw)
    got = {r.path[-1]: (r.text, r.encoding) for r in P.decoded(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"a": (text, "utf-8"), "b": (text, "gb18030"), "c": ("<meta charset='gb2312'>港口", "gb2312"), "d": (text, "utf-8-sig"), "e": ("���", "replaced"), "g": ("charset=no-such-one " + text, "utf-8"), "h": ("charset=utf-8 " + text, "gb18030")}
    declared = spark.createDataFrame([(1, text.encode("utf-16"), "text/html; charset=utf-16"), (2, None, None)], "k long, raw binary, kind string")
    assert {r.k: r.text for r in P.decoded(declared, "k", "raw", "kind").collect()} == {1: text, 2: ""}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert P.extracted(pages).collect() == P.discovered(pages).collect() == P.url_patterns(pages.select(F.col("url"))).collect() == []


def test_a_batch_of_pages_is_read_in_slices(spark):
    """Before, all pages of one of Spark's batches were held at once with what was made of them."""
    pages = spark.range(0, 1000, 1, 1).select(F.col("id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.format_string("<p>page %d</p>", "id").alias("html"))
    assert {r.page_id: r.text for r in P.extracted(pages).collect()} == {i: f"page {i}" for i in range(1000)}
    batch = pa.record_batch([pa.array(range(1000))], ["page_id"])
    cut = list(P._slices(iter([batch])))
    assert max(map(len, cut)) <= P.SLICE and pa.Table.from_batches(cut).column(0).to_pylist() == list(range(1000)) and list(P._slices(iter([batch.slice(0, 0)]))) == []
