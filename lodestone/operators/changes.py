"""Changes of stored tables, as new tables: keyed edits, replaced evidence, retention, obsolete reports, resets, late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edited(table: DataFrame, changes: DataFrame, key: str, at: str) -> DataFrame:
    """table after keyed changes (key, op, the table's other columns): update and delete must name exactly one row, insert none;
    others are refused and leave it as it is. Changed rows get `at`. One change a key."""
    rest = [c for c in table.columns if c not in (key, at)]
    n = table.groupBy(key).agg(F.count("*").alias("n"))
    known = changes.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    valid = known.where("(op = 'insert' AND n = 0) OR (op <> 'insert' AND n = 1)")
    kept = table.join(valid.where("op <> 'insert'").select(key), key, "left_anti")
    return kept.unionByName(valid.where("op <> 'delete'").select(key, *rest, F.col("changed_at").alias(at)).select(*table.columns))


def refused_changes(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """(key, op, n) of the changes that edited() refuses, with how many rows they name."""
    n = table.groupBy(key).agg(F.count("*").alias("n"))
    known = changes.join(n, key, "left").select(key, "op", F.coalesce("n", F.lit(0)).alias("n"))
    return known.where("NOT ((op = 'insert' AND n = 0) OR (op <> 'insert' AND n = 1))")


def replaced(evidence: DataFrame, fresh: DataFrame, event: str) -> DataFrame:
    """evidence with all rows of the events in `fresh` replaced by those there."""
    return evidence.join(fresh.select(event).distinct(), event, "left_anti").unionByName(fresh)


def evidence_flags(events: DataFrame, evidence: DataFrame, event: str) -> DataFrame:
    """(event, quotes, evidence_verified): verified with one quote at least and all of them located."""
    flags = evidence.groupBy(event).agg(F.count("*").alias("quotes"), F.bool_and("verified").alias("all_"))
    return events.select(event).join(flags, event, "left").select(event, F.coalesce("quotes", F.lit(0)).alias("quotes"), F.coalesce("all_", F.lit(False)).alias("evidence_verified"))


def unexpired(rows: DataFrame, expires: Column, now: str) -> DataFrame:
    """Rows that don't expire before `now`; those without a time stay."""
    return rows.where(expires.isNull() | (expires >= F.lit(now).cast("timestamp")))


def obsolete_reports(reports: DataFrame, events: DataFrame, report: str, ids: str, event: str) -> DataFrame:
    """(report, n, active, obsolete): reports whose list is empty or has no active event."""
    listed = reports.select(report, F.explode(ids).alias(event))
    active = listed.join(events.where("record_state = 'active'").select(event).distinct(), event, "left_semi").groupBy(report).agg(F.count("*").alias("active"))
    out = reports.select(report, F.size(ids).alias("n")).join(active, report, "left").withColumn("active", F.coalesce("active", F.lit(0)))
    return out.withColumn("obsolete", F.col("active") == 0)


def reset(rows: DataFrame, chosen: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """rows in which the given columns have new values where the key is chosen."""
    mark = rows.join(chosen.select(key).distinct().withColumn("chosen_", F.lit(True)), key, "left")
    return mark.select(*[F.when(F.col("chosen_"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def promoted(candidates: DataFrame, target: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """(batch, n, blocked, promoted): a batch goes as a whole, and only if the target has none of its rows by any of the keys."""
    hit = F.lit(False)
    rows = candidates
    for i, k in enumerate(keys):
        rows = rows.join(target.select(F.col(k).alias(f"t{i}_")).distinct(), F.col(k) == F.col(f"t{i}_"), "left")
        hit = hit | F.col(f"t{i}_").isNotNull()
    return rows.groupBy(batch).agg(F.count("*").alias("n"), F.count_if(hit).alias("blocked")).withColumn("promoted", F.col("blocked") == 0)


def within_budget(items: DataFrame, source: str, order: list[Column], most: int) -> DataFrame:
    """items with taken: the first `most` of each source; the rest is for the next run."""
    from .selection import per_key

    first = per_key(items, source, order, most, F.col("item_id")).select("item_id", F.lit(True).alias("taken"))
    return items.join(first, "item_id", "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def dispositions(arrivals: DataFrame, start: str, end: str, day: str, known: DataFrame, hash_: str) -> DataFrame:
    """arrivals with disposition: archived_only outside [start, end] or undated, duplicate where the content is known, else new."""
    inside = F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    seen = known.select(hash_).distinct().withColumn("seen_", F.lit(True))
    out = arrivals.join(seen, hash_, "left")
    return out.withColumn("disposition", F.when(~F.coalesce(inside, F.lit(False)), "archived_only").when(F.col("seen_"), "duplicate").otherwise("new")).drop("seen_")
