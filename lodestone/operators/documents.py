"""Documents: exact duplicates, versions, quality gate, scans, chunks, page metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """(content_hash, first_doc_id, n) of contents that occur more than once."""
    keyed = documents.select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return keyed.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n")).where("n > 1")


def versions(captures: DataFrame, url: str, order: str) -> DataFrame:
    """The version chain of each URL: a capture with a content the URL has had is a duplicate, any other a new version."""
    by_url = Window.partitionBy("url_key").orderBy(order)
    keyed = captures.withColumn("url_key", T.normalize_url(F.col(url)))
    seen = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("url_key", "content_hash").orderBy(order)))
    fresh = F.col("nth") == 1
    out = seen.withColumn("document_version", F.sum(fresh.cast("int")).over(by_url.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    last = F.max("document_version").over(Window.partitionBy("url_key"))
    return out.withColumn("disposition", F.when(~fresh, "duplicate_content").when(F.col("document_version") == 1, "new").otherwise("updated")).withColumn("is_current", fresh & (F.col("document_version") == last)).drop("nth")


def quality_gate(documents: DataFrame, navigation: tuple[str, ...] = ("cookie", "subscribe", "menu", "login", "share")) -> DataFrame:
    """Metrics, issues and status of each text: blocked on any issue, ok without."""
    text, body = F.coalesce("text", F.lit("")), F.col("compact")
    paragraphs = F.filter(F.split(text, "\n"), lambda p: F.length(F.trim(p)) >= 20)
    hits = sum((T.occurrences(F.lower(text), t) for t in navigation), F.lit(0))
    m = documents.select("doc_id", F.length(text).alias("n"), T.compact(F.col("text")).alias("compact"), F.size(paragraphs).alias("effective_paragraphs"), hits.alias("navigation_hits"), F.contains(text, F.lit("�")).alias("broken"))
    m = m.withColumn("text_characters", F.length(body)).withColumn("information_density", F.bround(F.regexp_count(body, F.lit(r"[\p{L}\p{N}]")) / F.greatest(F.length(body), F.lit(1)), 4))
    thin = (F.col("text_characters") < 30) | ((F.col("effective_paragraphs") < 2) & (F.col("text_characters") < 70))
    issues = F.array_compact(F.array(F.when(F.col("broken"), F.lit("encoding_anomaly")), F.when(thin, F.lit("thin_body")), F.when(F.col("navigation_hits") >= 6, F.lit("navigation_noise")), F.when((F.col("text_characters") >= 80) & (F.col("information_density") < 0.55), F.lit("low_density"))))
    return m.select("doc_id", "text_characters", "effective_paragraphs", "navigation_hits", "information_density", F.array_join(issues, ",").alias("issues"), F.when(F.size(issues) > 0, "blocked").otherwise("ok").alias("status"))


def secret_scan(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, value) of what looks like a secret or personal datum."""
    kinds = (("secret", T.SECRET), ("email", T.EMAIL))

    def named(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(*[named(k, p) for k, p in kinds])
    return documents.where("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(found)).alias("x")).select("doc_id", "x.kind", "x.value")


def _units(text, size: int):
    """The sentences of a text, each with one space after it where white space followed; those longer than size by clauses, and clauses by size."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[ \t\u3000\r]+", " "), r" ?\n\s*", "\n")
    marked = F.split(clean, r"(?<=[。！？!?；;])(?=\S)|(?<=[.。！？!?；;]\s)(?=\S)|(?<=\n)")
    sentences = F.filter(F.transform(marked, lambda s: F.regexp_replace(s, "\n", " ")), lambda s: F.trim(s) != "")
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.length(c) - 1) / size).cast("int")), lambda i: F.substr(c, i * size + 1, F.lit(size)))
    clauses = lambda s: F.flatten(F.transform(F.filter(F.split(s, "(?<=[，,:：、])"), lambda c: c != ""), lambda c: F.when(F.length(c) <= size, F.array(c)).otherwise(cut(c))))
    return F.flatten(F.transform(sentences, lambda s: F.when(F.length(F.rtrim(s)) <= size, F.array(s)).otherwise(clauses(s))))


def chunks(documents: DataFrame, size: int = 650, overlap: int = 100, least: int = 120) -> DataFrame:
    """(doc_id, chunk_index, chunk_text): sentences packed up to `size` characters, each chunk starting with the sentences that end the last
    within `overlap`, one at least, unless size + overlap would be exceeded: no chunk is longer than that.

    A fold over the units of one text. Sentences end after their mark, with or without white space, and at line breaks; longer ones
    than `size` are packed by clauses, and these cut at `size`. A last chunk under `least` characters joins the one before where it fits.
    """
    strings = F.array().cast("array<string>")
    whole = lambda units: F.array_join(units, "")
    size_of = lambda text: F.length(F.rtrim(text))

    def back(acc, u):
        out = acc["stop"] | ((F.size(acc["kept"]) > 0) & (acc["used"] + F.length(u) > overlap))
        used = F.when(out, acc["used"]).otherwise(acc["used"] + F.length(u))
        return F.struct(F.when(out, acc["kept"]).otherwise(F.concat(F.array(u), acc["kept"])).alias("kept"), used.alias("used"), (out | (used >= overlap)).alias("stop"))

    def step(acc, u):
        full = (F.size(acc["open"]) > 0) & (size_of(F.concat(whole(acc["open"]), u)) > size)
        tail = F.aggregate(F.reverse(acc["open"]), F.struct(strings.alias("kept"), F.lit(0).alias("used"), F.lit(overlap <= 0).alias("stop")), back, lambda x: x["kept"])
        lead = F.when(size_of(F.concat(whole(tail), u)) > size + overlap, F.array(u)).otherwise(F.concat(tail, F.array(u)))
        done = F.when(full, F.concat(acc["done"], F.array(whole(acc["open"])))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, lead).otherwise(F.concat(acc["open"], F.array(u))).alias("open"))

    def end(acc):
        last, before = whole(acc["open"]), F.try_element_at(acc["done"], F.lit(-1))
        joins = (F.size(acc["done"]) > 0) & (size_of(last) < least) & (size_of(F.concat(before, last)) <= size + overlap)
        joined = F.concat(F.slice(acc["done"], 1, F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(F.concat(before, last)))
        return F.when(F.size(acc["open"]) == 0, acc["done"]).when(joins, joined).otherwise(F.concat(acc["done"], F.array(last)))

    packed = F.aggregate(_units(F.coalesce("text", F.lit("")), size), F.struct(strings.alias("done"), strings.alias("open")), step, end)
    return documents.select("doc_id", F.posexplode(F.transform(packed, lambda c: F.trim(c))).alias("chunk_index", "chunk_text"))


def page_metadata(pages: DataFrame) -> DataFrame:
    """(page_id, url_key, host, title, lang, n_links) by patterns, one scan of the HTML."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id", T.normalize_url(F.col("url")).alias("url_key"), F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)).alias("host"),
        F.trim(F.regexp_extract(html, r"<title>([^<]*)</title>", 1)).alias("title"), F.regexp_extract(html, r"<html lang=\"([a-z]+)\"", 1).alias("lang"), F.regexp_count(html, F.lit(r"<a href=")).alias("n_links"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href): distinct anchors of a page, at their first position."""
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"<a href=\"([^\"#]+)\""), F.lit(1))
    return pages.select("page_id", F.posexplode(F.array_distinct(hrefs)).alias("position", "href"))
