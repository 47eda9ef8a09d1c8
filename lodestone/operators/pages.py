"""Pages: bytes to text, metadata and body, links, and the URL pattern that the links of a host share."""

from __future__ import annotations

import codecs
import datetime
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Tags whose text isn't body, tags without an end, and the metadata that are asked in order.
NOISE = ("script", "style", "nav", "footer", "header", "aside", "noscript", "svg", "form")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
TITLE = (("property", "og:title"), ("name", "twitter:title"))
DESCRIPTION = (("name", "description"), ("property", "og:description"))
PUBLISHER = (("property", "og:site_name"), ("name", "publisher"), ("name", "author"))
PUBLISHED = (("property", "article:published_time"), ("name", "publishdate"), ("name", "pubdate"), ("name", "date"))
DATES = (r"(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})", r"(20\d{2})年(\d{1,2})月(\d{1,2})日")
CHARSET = r"charset\s*=\s*['\"]?([a-zA-Z0-9._-]+)"
FALLBACKS = ("utf-8", "gb18030")


class Page(HTMLParser):
    """One pass over a page: an end tag closes up to its start, or nothing if there is none; what is never closed ends with the page.

    Pieces of text are kept with the container that they stand in: the first article, the first main, body, or the page.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.noise = 0
        self.seen: set[str] = set()
        self.inside: dict[str, int] = {}  # depth at which the first article, main and body are open
        self.pieces: dict[str, list[str]] = {"article": [], "main": [], "body": [], "page": []}
        self.of: dict[str, list[str]] = {"h1": [], "title": [], "time": []}  # texts of the first of each
        self.meta: list[dict[str, str]] = []
        self.canonical = self.when = None
        self.scripts = 0
        self.links: list[tuple[str, list[str]]] = []
        self.link_at: list[tuple[int, int]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        held = {k: v or "" for k, v in attrs}
        self.scripts += tag == "script"
        if tag == "meta":
            self.meta.append(held)
        if tag == "link" and self.canonical is None and "canonical" in held.get("rel", "") and held.get("href"):
            self.canonical = held["href"].strip()
        if tag == "time" and self.when is None:
            self.when = held.get("datetime", "")
        if tag in VOID:
            return
        first = tag not in self.seen
        self.seen.add(tag)
        if first and (tag in self.pieces or tag in self.of):
            self.inside[tag] = len(self.open)
        if tag == "a" and held.get("href"):
            self.links.append((held["href"], []))
            self.link_at.append((len(self.open), len(self.links) - 1))
        self.noise += tag in NOISE
        self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while True:
            last = self.open.pop()
            self.noise -= last in NOISE
            if self.inside.get(last) == len(self.open):
                del self.inside[last]
            while self.link_at and self.link_at[-1][0] >= len(self.open):
                self.link_at.pop()
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if not text:
            return
        for name in self.inside:
            if name in self.of:
                self.of[name].append(text)
        for _, at in self.link_at[-1:]:
            self.links[at][1].append(text)
        if not self.noise:
            self.pieces["page"].append(text)
            for name in self.inside:
                if name in self.pieces:
                    self.pieces[name].append(text)

    def named(self, keys: tuple) -> str:
        for attr, value in keys:
            found = next((m.get("content", "").strip() for m in self.meta if m.get(attr) == value), "")
            if found:
                return found
        return ""

    def body(self) -> str:
        """The text of the first article, else main, body or page: a line for each piece, white space squeezed, a line like the one before left out."""
        container = next((n for n in ("article", "main", "body") if n in self.seen), "page")
        out: list[str] = []
        for piece in "\n".join(self.pieces[container]).splitlines():
            line = " ".join(piece.split())
            if line and line != (out[-1] if out else ""):
                out.append(line)
        return "\n".join(out)


def iso_date(text: str) -> str:
    """The first date of the first form that occurs, as yyyy-MM-dd; '' if there is none or it isn't in the calendar."""
    for pattern in DATES:
        if m := re.search(pattern, text):
            try:
                return datetime.date(*map(int, m.groups())).isoformat()
            except ValueError:
                return ""
    return ""


_FIELDS = ("title", "publisher", "description", "published_date", "canonical_url", "text")


def _read_page(html: str, url: str, longest: int | None) -> dict:
    page = Page(html)
    whole = page.body()
    text = whole if longest is None or len(whole) <= longest else whole[:longest].rstrip()
    title = page.named(TITLE) or " ".join(page.of["h1"]) or " ".join(page.of["title"])
    date = iso_date(page.named(PUBLISHED) or page.when or " ".join(page.of["time"])) or iso_date(text[:1000])
    canonical = ""
    if page.canonical:
        try:
            target = urljoin(url, page.canonical)
            canonical = target if urlsplit(target).scheme in ("http", "https") and urlsplit(target).netloc else ""
        except ValueError:
            canonical = ""
    out = dict(zip(_FIELDS, (" ".join(title.split()), page.named(PUBLISHER), page.named(DESCRIPTION), date, canonical, text), strict=True))
    thin = len("".join(text.split())) < 40
    notes = ["truncated"] * (text != whole) + [f"no_{n}" for n in ("title", "published_date", "publisher") if not out[n]] + ["needs_script" if page.scripts else "no_body"] * thin
    return {"ok": not thin, **out, "truncated": text != whole, "notes": ",".join(notes)}


#: How many pages are read at once; Spark's batches hold thousands, and what is made of a page is many times its size.
SLICE = 64


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, SLICE) for batch in batches for i in range(0, len(batch), SLICE))


def extracted(pages: DataFrame, longest: int | None = None) -> DataFrame:
    """(page_id, ok, title, publisher, description, published_date, canonical_url, text, truncated, notes) of pages (page_id, url, html).

    title: og:title, twitter:title, the first h1, else title. published_date: its metadata, the first time element, else the first 1,000 characters of the body.
    text: see Page.body(), without scripts, navigation, headers, footers, asides and forms; cut at `longest` characters if given. ok: 40 characters without white space. notes:
    what is missing, by commas. Null urls and pages count as empty; page_id is a long.
    """
    kinds = [pa.field("page_id", pa.int64()), pa.field("ok", pa.bool_()), *[pa.field(n, pa.string()) for n in _FIELDS], pa.field("truncated", pa.bool_()), pa.field("notes", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = [{"page_id": i, **_read_page(h or "", u or "", longest)} for i, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, f"page_id long, ok boolean, {', '.join(f'{n} string' for n in _FIELDS)}, truncated boolean, notes string")


def discovered(pages: DataFrame, prefix: str = "", pattern: str = "") -> DataFrame:
    """(page_id, position, url, title): the distinct targets of a page's links, absolute and normalised, in order of the page; those whose path begins with `prefix` and that the pattern, if
    given, is found in. Targets that aren't http or https are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = []
            for i, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, (href, texts) in enumerate(Page(html or "").links):
                    try:
                        out.append((i, k, urljoin(url or "", href.strip()), " ".join(" ".join(texts).split())))
                    except ValueError:
                        continue
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], ["page_id", "at", "target", "title"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, at int, target string, title string")
    rows = rows.where(F.lower("target").rlike("^https?://")).withColumn("url", T.normalize_url(F.col("target"))).where("url <> ''")
    first = rows.groupBy("page_id", "url").agg(F.min(F.struct("at", "title")).alias("x")).select("page_id", "url", "x.at", "x.title")
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1)
    fits = F.startswith(path, F.lit(prefix)) & (F.col("url").rlike(pattern) if pattern else F.lit(True))
    listed = first.where(fits).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", "url", "title"))).alias("xs"))  # the links of one page
    return listed.select("page_id", F.posexplode("xs").alias("position", "x")).select("page_id", "position", "x.url", "x.title")


def _segments(url: str):
    return F.split(F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", ""), "/")


def url_patterns(links: DataFrame, url: str = "url") -> DataFrame:
    """(host, n, prefix, pattern): the path that all links of a host have in common, by whole segments and without the last of these, and the pattern of URLs below it.

    What all paths share is what the least and the greatest of them share, in the order of their segments; so a host is one aggregate, formed before rows move.
    Links without a host are left out; repeated links count.
    """
    host = F.lower(F.regexp_extract(url, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    ends = links.select(host.alias("host"), _segments(url).alias("s")).where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
    same = F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False)))
    until = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")
    prefix = F.concat(F.lit("/"), F.array_join(F.slice("low", F.lit(1), F.greatest(F.lit(0), until - 1)), "/"))
    prefix = F.when(prefix == "/", "/").otherwise(F.concat(prefix, F.lit("/")))
    escaped = lambda c: F.regexp_replace(c, r"([^\w/])", r"\\$1")
    pattern = F.concat(F.lit("^https?://"), escaped(F.col("host")), escaped(F.regexp_replace(prefix, "/$", "")), F.lit("/.+"))
    return ends.select("host", "n", prefix.alias("prefix"), pattern.alias("pattern"))


def path_trie(links: DataFrame, depth: int = 8, url: str = "url") -> DataFrame:
    """(host, depth, prefix, n): how many links of a host lie below each path of up to `depth` segments."""
    host = F.lower(F.regexp_extract(url, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = links.select(host.alias("host"), _segments(url).alias("s")).where("host <> '' AND s[0] <> ''")
    each = rows.select("host", "s", F.explode(F.sequence(F.lit(1), F.least(F.size("s"), F.lit(depth)))).alias("depth"))
    return each.groupBy("host", "depth", F.concat(F.lit("/"), F.array_join(F.slice("s", F.lit(1), F.col("depth")), "/")).alias("prefix")).agg(F.count("*").alias("n"))


def _decode(raw: bytes, kind: str) -> tuple[str, str]:
    header = re.search(CHARSET, kind, re.I)
    meta = re.search(CHARSET.encode(), raw[:8192], re.I)
    for name in dict.fromkeys([header[1] if header else "", meta[1].decode() if meta else "", "utf-8-sig" if raw.startswith(codecs.BOM_UTF8) else "", *FALLBACKS]):
        try:
            if name:
                return raw.decode(name), codecs.lookup(name).name
        except (LookupError, UnicodeDecodeError, ValueError):
            continue
    return raw.decode("utf-8", "replace"), "replaced"


def decoded(files: DataFrame, key: str = "path", content: str = "content", content_type: str | None = None) -> DataFrame:
    """(key, text, encoding) of bytes, as spark.read.format("binaryFile") gives them: the first of the declared charset (in a column content_type, if named), that of a meta tag in the first 8,192
    bytes, UTF-8 and GB18030 that takes all bytes; else UTF-8 with replacement characters (`replaced`). Names that no codec has are passed over. Null bytes are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [_decode(raw or b"", kind or "") for raw, kind in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], [key, "text", "encoding"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content, F.col(content_type) if content_type else F.lit("")).mapInArrow(run, f"`{key}` {kind}, text string, encoding string")
