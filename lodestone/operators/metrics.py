"""Run, source and review statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def source_run_statistics(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Per source: runs, successes, value and rates; sources without runs stay, and a rate over nothing is null.

    Runs are summed before the join, so a busy source is one row there.
    """
    sums = runs.groupBy("source_id").agg(F.count("*").alias("runs"), F.count_if(F.col("ok")).alias("successes"), F.bround(F.sum("value"), 4).alias("value"))
    out = sources.join(sums, "source_id", "left").select("source_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "successes")], F.coalesce("value", F.lit(0.0)).alias("value"))
    return out.withColumn("success_rate", F.bround(F.try_divide("successes", "runs"), 6))


def group_counts(table: DataFrame, column: str) -> DataFrame:
    """Rows by value; blank counts as unset."""
    return table.groupBy(F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit("unset")).alias("value")).agg(F.count("*").alias("n"))


def daily_histogram(events: DataFrame, first: str, last: str) -> DataFrame:
    """(day, n) for each day of the range, zero where nothing happened."""
    counts = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    days = events.sparkSession.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day")
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def compare_periods(events: DataFrame, split: str) -> DataFrame:
    """(event_type, before, after, delta): counts on either side of a moment, in one scan."""
    early = F.col("ts") < F.lit(split).cast("timestamp")
    return events.groupBy("event_type").agg(F.count_if(early).alias("before"), F.count_if(~early).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def failure_streaks(events: DataFrame, key: str = "user_id", failed: str = "event_type = 'error'") -> DataFrame:
    """(key, failures): failures since the last success, for keys whose latest event failed."""
    last_ok = F.max(F.when(~F.expr(failed), F.struct("ts", "event_id"))).alias("ok")
    ok = events.groupBy(key).agg(last_ok)
    later = events.where(failed).join(ok, key).where(F.col("ok").isNull() | (F.struct("ts", "event_id") > F.col("ok")))
    return later.groupBy(key).agg(F.count("*").alias("failures"))


def day_streaks(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, last_day, days): the run of consecutive days that ends at the key's latest day."""
    days = events.groupBy(key, F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day")))
    runs = days.withColumn("island", island).groupBy(key, "island").agg(F.max("day").alias("last_day"), F.count("*").alias("days"))
    return runs.groupBy(key).agg(F.max(F.struct("last_day", "days")).alias("x")).select(key, "x.last_day", "x.days")


def latest_per_key(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The latest row of each key, ties by the larger event_id."""
    rest = [c for c in events.columns if c not in (key, "ts", "event_id")]
    return events.groupBy(key).agg(F.max(F.struct("ts", "event_id", *rest)).alias("x")).select(key, "x.*")


def label_accuracy(gate: DataFrame, labels: DataFrame) -> DataFrame:
    """How the gate's verdict agrees with the quality labels: one row of counts and rates."""
    both = gate.join(labels.where("quality IS NOT NULL"), "doc_id")
    good, ok = F.col("quality") == 1, F.col("status") == "ok"
    counts = both.agg(F.count("*").alias("n"), F.count_if(good & ok).alias("good_ok"), F.count_if(~good & ~ok).alias("bad_blocked"), F.count_if(good).alias("good"))
    return counts.withColumn("accuracy", F.bround(F.try_divide(F.col("good_ok") + F.col("bad_blocked"), F.col("n")), 6))
