"""Counts of a stream of files, as a table that a restart continues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import drained, own_folder


def daily_counts(spark: SparkSession, path: str, schema, kind: str = "event_type", files_per_trigger: int = 64, delay: str = "400 days", base: str | None = None) -> DataFrame:
    """(day, kind, n) from all files now in `path`, read as a stream in batches; a later batch replaces what an earlier one counted.

    A day's count leaves the state once the watermark, `delay` behind the latest event seen, has passed it; events later than that are dropped. State
    and results live in `base`, from which a further call goes on, or in a new folder of spark.checkpoint.dir.
    """
    base = base or own_folder(spark, "daily")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    days = rows.groupBy(F.window("ts", "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), kind, "n")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/counts/batch={number}")

    drained(days.writeStream.outputMode("update"), write, f"{base}/state")
    written = spark.read.schema(f"day date, {kind} string, n long, batch long").parquet(f"{base}/counts")
    return written.groupBy("day", kind).agg(F.max_by("n", "batch").alias("n"))
