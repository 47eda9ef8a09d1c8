"""Reading and writing tables: all-string CSV with fixed columns, guarded exports, JSON and feed listings, joined lines, public subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_url, strip


def typed_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV table with a header as strings: the given columns in that order, missing ones and nulls as '', cells stripped."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return read.select(*[(strip(F.col(c)) if c in read.columns else F.lit("")).alias(c) for c in columns])


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The given columns as CSV files with a header."""
    rows.select(*columns).write.option("header", True).option("escape", '"').csv(path)


def loaded_events(rows: DataFrame, key: str, title: str, body: list[str]) -> DataFrame:
    """(document_id, event_id, text, record_state): events with a title as documents, with ids that follow from the content."""
    text = F.concat_ws("\n", title, *body)
    name = lambda prefix: F.concat(F.lit(f"{prefix}-"), F.upper(F.substr(F.sha2(F.concat_ws("|", F.lit(prefix), F.col(key).cast("string"), text), 256), F.lit(1), F.lit(16))))
    return rows.where(strip(F.col(title)) != "").select(name("DOC").alias("document_id"), name("EVT").alias("event_id"), text.alias("text"), F.lit("quarantined").alias("record_state"))


def guarded_export(rows: DataFrame, sources: DataFrame, source: str, allowed: str, mode: str, hidden: list[str], inactive: bool = False) -> DataFrame:
    """rows for export: active ones unless asked; without the hidden columns in metadata mode; in any other mode only if
    every source of a row allows it, else an error."""
    if mode != "metadata":
        barred = rows.select(source).distinct().join(sources.where(~F.coalesce(F.col(allowed), F.lit(False))), source)
        if not barred.isEmpty():
            raise PermissionError(f"a source forbids the export of {mode}")
    rows = rows if inactive else rows.where("record_state = 'active'")
    return rows.drop(*hidden) if mode == "metadata" else rows


def json_items(rows: DataFrame, key: str, text: str, fields: dict[str, str], most: int) -> DataFrame:
    """(key, position, fields): the items of a JSON listing, an object {"items": [...]}, under the names that the source uses; at most so many a listing."""
    schema = "struct<items:array<map<string,string>>>"
    items = F.slice(F.coalesce(F.from_json(text, schema)["items"], F.array().cast("array<map<string,string>>")), 1, most)
    return rows.select(key, F.posexplode(items).alias("position", "item")).select(key, "position", *[F.col("item")[name].alias(out) for out, name in fields.items()])


def feed_items(rows: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, position, link, title, day): the items of RSS or the entries of Atom in a text; at most so many a feed."""
    blocks = F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)<(?:item|entry)[ >].*?</(?:item|entry)>"), F.lit(0)), 1, most)
    out = rows.select(key, F.posexplode(blocks).alias("position", "block"))
    part = lambda p: F.trim(F.regexp_extract("block", p, 1))
    link = F.coalesce(F.nullif(part(r"<link>([^<]*)</link>"), F.lit("")), part(r"<link[^>]*href=\"([^\"]*)\""))
    return out.select(key, "position", normalize_url(link).alias("link"), part(r"<title[^>]*>([^<]*)</title>").alias("title"), F.substr(part(r"<(?:pubDate|updated|published)>([^<]*)<"), F.lit(1), F.lit(10)).alias("day"))


def joined_lines(text: Column, short: int = 28) -> Column:
    """Wrapped lines as one: a line starts anew after the end of a sentence or when it looks like a heading (short and
    without a mark at its end), a hyphen before a letter vanishes, anything else is appended. Blank lines are dropped."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")

    def step(acc: Column, line: Column) -> Column:
        heading = (F.length(line) <= short) & ~line.rlike("[。！？!?；;，,：:]$")
        fresh = F.substr(acc, F.lit(-1)).isin(*"。！？!?；;") | heading
        hyphen = F.endswith(acc, F.lit("-")) & line.rlike("^[A-Za-z]")
        return F.when(acc == "", line).when(fresh, F.concat(acc, F.lit("\n"), line)).when(hyphen, F.concat(F.substr(acc, F.lit(1), F.length(acc) - 1), line)).otherwise(F.concat(acc, line))

    return F.aggregate(lines, F.lit(""), step)


def public_subset(rows: DataFrame, order: list[Column], key: str, quotes: DataFrame, most: int, each: int = 3, length: int = 240) -> DataFrame:
    """(public_id, key, quotes): the first rows under new numbers from 1, with their first few quotes, cut."""
    from ..operators.selection import best

    top = best(rows, order, most).select(F.col("rank").alias("public_id"), key)
    some = quotes.join(F.broadcast(top.select(key)), key, "left_semi").groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("quote_no", F.substr("quote", F.lit(1), F.lit(length)).alias("quote")))), 1, each).alias("qs"))
    return top.join(some, key, "left").select("public_id", key, F.coalesce(F.array_join(F.transform("qs", lambda q: q["quote"]), "|"), F.lit("")).alias("quotes"))
