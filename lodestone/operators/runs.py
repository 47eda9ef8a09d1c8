"""Runs of sources and tasks: outcomes, health, staleness, legal transitions, ledgers, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run_outcomes(steps: DataFrame, keys: list[str], failed: Column, value: str) -> DataFrame:
    """Per run: steps, failures, value and the outcome: failed without a success, partially_succeeded with a failure, else succeeded."""
    out = steps.groupBy(*keys).agg(F.count("*").alias("steps"), F.count_if(failed).alias("failures"), F.bround(F.sum(value), 4).alias("value"))
    outcome = F.when(F.col("failures") == F.col("steps"), "failed").when(F.col("failures") > 0, "partially_succeeded").otherwise("succeeded")
    return out.withColumn("outcome", outcome)


def stage_statistics(steps: DataFrame, stage: str, failed: Column, reason: str, most: int = 20) -> DataFrame:
    """Per stage: rows, failures and at most so many distinct reasons of failure, in order, joined by commas."""
    reasons = steps.where(failed).groupBy(stage, reason).agg(F.count("*").alias("n"))
    first = Window.partitionBy(stage).orderBy(reason)
    listed = reasons.withColumn("i", F.row_number().over(first)).where(F.col("i") <= most).groupBy(stage).agg(F.array_join(F.sort_array(F.collect_list(reason)), ",").alias("reasons"))
    counts = steps.groupBy(stage).agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"))
    return counts.join(listed, stage, "left").withColumn("reasons", F.coalesce("reasons", F.lit("")))


def stale_runs(beats: DataFrame, key: str, at: str, now: str, minutes: int) -> DataFrame:
    """(key, last_beat): runs without a beat for so many minutes at the moment `now`."""
    last = beats.groupBy(key).agg(F.max(at).alias("last_beat"))
    return last.where(F.col("last_beat") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES"))


def illegal_transitions(states: DataFrame, key: str, order: list[str], state: str, legal: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows whose state may not follow the one before it in the same run; the first state of a run is always legal."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    ok = F.lit(False)
    for a, after in legal.items():
        ok = ok | ((F.col("before") == a) & F.col(state).isin(*after))
    return states.withColumn("before", before).where(F.col("before").isNotNull() & ~ok)


def readiness(events: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """(check, value, threshold, passed) of named shares of rows, all in one scan; a share of nothing is null and fails."""
    n = F.count("*")
    one = events.agg(*[F.bround(F.try_divide(F.count_if(c), n), 6).alias(name) for name, (c, _) in checks.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("value"), F.lit(float(t)).alias("threshold")) for name, (_, t) in checks.items()])
    out = one.select(F.explode(rows).alias("x")).select("x.*")
    return out.withColumn("passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))


def run_days(left: DataFrame, right: DataFrame, target: int = 28) -> DataFrame:
    """One row: distinct days on which either table has a row, and how many of the target remain."""
    days = left.select(F.to_date("ts").alias("day")).union(right.select(F.to_date("ts").alias("day"))).where("day IS NOT NULL").distinct()
    return days.agg(F.count("*").alias("run_days")).withColumn("remaining", F.greatest(F.lit(0), target - F.col("run_days")))


def merged_ledger(entries: DataFrame, key: list[str], order: list[str], status: str, vocabulary: dict[str, str]) -> DataFrame:
    """The first entry of each key with its status in the common vocabulary (others are 'unknown') and how many entries were merged."""
    rest = [c for c in entries.columns if c not in {*key, *order, status}]
    out = entries.groupBy(*key).agg(F.min(F.struct(*order, status, *rest)).alias("x"), F.count("*").alias("merged")).select(*key, "x.*", "merged")
    canonical = F.lit("unknown")
    for a, b in vocabulary.items():
        canonical = F.when(F.lower(F.trim(F.col(status))) == a, b).otherwise(canonical)
    return out.withColumn(status, canonical)


def due(sources: DataFrame, last_run: DataFrame, today: str) -> DataFrame:
    """Sources whose turn it is: daily ones that did not run today, weekly ones not for seven days or never."""
    day = F.lit(today).cast("date")
    last = last_run.groupBy("source_id").agg(F.max(F.to_date("ts")).alias("last_day"))
    daily = (F.col("frequency") == "daily") & (F.col("last_day").isNull() | (F.col("last_day") != day))
    weekly = (F.col("frequency") == "weekly") & (F.col("last_day").isNull() | (F.col("last_day") <= F.date_sub(day, 7)))
    return sources.join(last, "source_id", "left").where(F.col("enabled") & (daily | weekly))
