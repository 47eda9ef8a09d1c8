"""Gates over events: reasons, counts of reasons, completeness, snapshots, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gate(rows: DataFrame, key: str, reasons: dict[str, Column]) -> DataFrame:
    """(key, reasons, passed): the names of the reasons that hold, in order and joined by commas; without any the row passes. A condition that is null doesn't hold."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in reasons.items()]))
    return rows.select(key, F.array_join(found, ",").alias("reasons"), (F.size(found) == 0).alias("passed"))


def reason_counts(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """(reason, n) of the reasons that hold somewhere; one scan for all."""
    one = rows.agg(*[F.count_if(c).alias(name) for name, c in reasons.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("reason"), F.col(name).alias("n")) for name in reasons])
    return one.select(F.explode(pairs).alias("x")).select("x.*").where("n > 0")


def completeness(rows: DataFrame, required: list[str]) -> DataFrame:
    """One row: how many rows, how many of their required cells are filled, and that as a percentage, half to even; of nothing it is null."""
    filled = sum((F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", 1).otherwise(0) for c in required), F.lit(0))
    out = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(filled), F.lit(0)).alias("filled"))
    return out.withColumn("percent", F.bround(F.try_divide(100.0 * F.col("filled"), F.col("n") * len(required)), 1))


def snapshot(rows: DataFrame, part: str, key: str, columns: list[str], blocks: int = 1024) -> DataFrame:
    """(part, n, digest): a digest of each part's rows that doesn't depend on their order or on how they are spread.

    Rows are hashed as canonical JSON; the hashes of a part are sorted in blocks by their first digits and the
    digests of the blocks are hashed in turn, so no part meets in one place.
    """
    line = F.sha2(F.to_json(F.struct(key, *columns)), 256)
    block = F.substr(F.col("line"), F.lit(1), F.lit(len(f"{blocks - 1:x}")))
    inner = rows.select(part, line.alias("line")).groupBy(part, block.alias("block")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("line")), ""), 256).alias("digest"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "digest"))), lambda x: x.digest), "")
    return inner.groupBy(part).agg(F.sum("n").alias("n"), F.sha2(whole, 256).alias("digest"))


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, changed): the fields that differ, joined by commas, of rows in both tables; equal rows don't appear. Null equals null."""
    both = before.select(key, *[F.col(f).alias(f"__{f}") for f in fields]).join(after.select(key, *fields), key)
    names = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in fields])), ",")
    return both.select(key, names.alias("changed")).where("changed <> ''")


def context_pack(ranked: DataFrame, length: str, budget: int) -> DataFrame:
    """Rows of each query in rank order up to the first that would exceed the budget of characters, with the total so far."""
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("total", F.sum(length).over(so_far)).where(F.col("total") <= budget)


def fuse(keyword: DataFrame, semantic: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): two ranked lists as one; a keyword hit counts 0.25 + 0.55 / (rank + 1), a semantic one 0.45 / (rank + 1), with ranks from 0."""
    a = keyword.select("query_id", "doc_id", (0.25 + 0.55 / F.col("rank")).alias("a"))
    b = semantic.select("query_id", "doc_id", (0.45 / F.col("rank")).alias("b"))
    both = a.join(b, ["query_id", "doc_id"], "full").select("query_id", "doc_id", F.bround(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def route(queries: DataFrame, text: str, intents: dict[str, tuple[str, ...]], default: str) -> DataFrame:
    """queries with an intent: the first, in order, one of whose terms stands in the lower-cased text."""
    t, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(default)
    for name, terms in reversed(intents.items()):
        hit = F.lit(False)
        for term in terms:
            hit = hit | F.contains(t, F.lit(term))
        out = F.when(hit, name).otherwise(out)
    return queries.withColumn("intent", out)
