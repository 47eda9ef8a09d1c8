"""Selecting events, runs and sources: filters, ordered lists, disjoint report groups. Ties are ordered by the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import Rules


def matching(rows: DataFrame, equal: dict[str, object] | None = None, start: str | None = None, end: str | None = None, day: str = "event_date", flags: tuple[str, ...] = ()) -> DataFrame:
    """Rows within [start, end] whose columns have the given value, or one of the values of a list, and whose flags stand."""
    keep = F.lit(True)
    for column, value in (equal or {}).items():
        keep = keep & (F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    if start:
        keep = keep & (F.col(day) >= F.lit(start).cast("date"))
    if end:
        keep = keep & (F.col(day) <= F.lit(end).cast("date"))
    for flag in flags:
        keep = keep & F.col(flag)
    return rows.where(keep)


def best(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows with their rank; each task keeps its own first ones."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def report_rows(scored: DataFrame, start: str, end: str, categories: list[str] | None = None, medium_high: bool = True, opportunities: bool = True) -> DataFrame:
    """Events of the period for a report: not excluded by hand, of the client's categories, of medium or high risk (or opportunity)."""
    if start > end:
        raise ValueError("start is after end")
    rows = matching(scored, {"category": categories} if categories else None, start, end).where("coalesce(report_included, '') <> '否'")
    weighty = F.col("risk_level") != "低"
    if opportunities:
        weighty = weighty | (F.col("opportunity_level") != "低")
    return rows.where(weighty) if medium_high else rows


def core_events(rows: DataFrame) -> DataFrame:
    """Events fit for the core of a report: verified evidence, no low confidence without a human check, and, if any event is
    assessed, none assessed below medium."""
    rows = rows.where(F.col("evidence_verified") & ((F.coalesce("confidence", F.lit(0)) >= 60) | F.col("human_verified")))
    any_assessed = rows.agg(F.coalesce(F.bool_or(F.col("business_value").isNotNull()), F.lit(False)).alias("any_assessed"))
    return rows.join(F.broadcast(any_assessed), F.lit(True)).where("NOT any_assessed OR business_value IS NULL OR business_value IN ('高', '中')").drop("any_assessed")


ORDER = ["priority_score", "opportunity_score", "event_date"]


def core_groups(rows: DataFrame, rules: Rules, most: int = 5) -> DataFrame:
    """The best core events, each in the first group it fits: risks, resolved, opportunities, watchlist."""
    active = ~F.col("status").isin(*rules.resolved)
    group = F.when(active & (F.col("risk_level") != "低"), "risks").when(~active, "resolved").when(F.col("opportunity_level") != "低", "opportunities").otherwise("watchlist")
    return best(core_events(rows), [*[F.desc(c) for c in ORDER], F.asc("event_id")], most).withColumn("report_group", group)


def pending(rows: DataFrame, limit: int = 100) -> DataFrame:
    """What needs attention: unverified, of low confidence, possibly a duplicate or of medium or high risk; the most urgent first."""
    needs = ~F.col("human_verified") | (F.col("confidence") < 60) | (F.coalesce("duplicate_level", F.lit("")) != "") | (F.col("risk_level") != "低")
    return best(rows.where(needs), [F.desc("priority_score"), F.asc("event_id")], limit)


def browse(rows: DataFrame, columns: list[str], word: str, equal: dict[str, object], order: list[Column], limit: int = 200) -> DataFrame:
    """Rows with the word in any of the columns, ignoring case, and the given values."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word.lower()))
    return best(matching(rows.where(hit), equal), order, min(limit, 200))


def unchecked(sources: DataFrame, last: DataFrame, today: str, priority: str = "high") -> DataFrame:
    """Enabled sources of high priority that have no run today."""
    ran = last.where(F.to_date("ts") == F.lit(today).cast("date")).select("source_id").distinct()
    return sources.where(F.col("enabled") & (F.col("priority") == priority)).join(ran, "source_id", "left_anti")


def per_key(rows: DataFrame, key: str, order: list[Column], most: int, salt: Column, salts: int = 16) -> DataFrame:
    """The first rows of each key with their rank; each of several parts of a key keeps its own first ones, so no key meets whole in one task."""
    part = Window.partitionBy(key, F.pmod(F.xxhash64(salt), F.lit(salts))).orderBy(*order)
    some = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)


def concat_new(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The rows of first, then those of second whose key isn't there; part says which."""
    fresh = second.join(first.select(key).distinct(), key, "left_anti")
    return first.withColumn("part", F.lit(1)).unionByName(fresh.withColumn("part", F.lit(2)), allowMissingColumns=True)


def refused(requested: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """The distinct requested keys that weren't accepted."""
    return requested.select(key).distinct().join(accepted.select(key).distinct(), key, "left_anti")
