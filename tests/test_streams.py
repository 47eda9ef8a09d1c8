"""Streams against the batch operators, over restarts and in any order of arrival."""

import datetime
import random

from pyspark.sql import functions as F

from lodestone.operators import curation as C
from lodestone.sources.versioned import TableSet
from lodestone.streaming import counts, ingest

RUNS = "source string, run_id long, ts timestamp, ok boolean"


def at(hours):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=hours)


def test_guards_equal_the_batch_operators_over_restarts(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"s{rng.randrange(6)}", i, at(i * 0.9 + rng.random()), rng.random() < 0.4) for i in range(160)]
    files, base = tmp_path / "runs", f"file://{tmp_path}/out"
    read = lambda: spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(str(files))
    order = list(range(160))
    order.sort(key=lambda i: i + rng.randrange(15))  # rows come up to 15 places late
    parts = [order[k : k + 40] for k in range(0, 160, 40)]
    for k, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], RUNS).coalesce(1).write.mode("append").parquet(str(files))
        got = ingest.guard_runs(spark, read, base, flush=k == len(parts) - 1)  # each call is a restart
    runs = spark.createDataFrame(rows, RUNS)
    want = C.cooldown(C.circuit_breaker(runs, "source", ["ts", "run_id"], ~F.col("ok")), "source", "ts", ["ts", "run_id"], F.col("ok"), 6 * 3600)
    pick = lambda df: sorted(tuple(r) for r in df.select("source", "run_id", "ts", "tripped", "suppressed").collect())
    assert pick(got) == pick(want) and any(r[3] for r in pick(want)) and any(r[4] for r in pick(want))


def test_documents_are_ingested_once(spark, tmp_path):
    schema = "document_id string, url string, title string, text string, fetched_at timestamp, quality_ok boolean"
    tables, files = TableSet(spark, str(tmp_path / "tables")), tmp_path / "in"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(files))
    add = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(files))
    add(("a", "https://x.org/1", "t", "one", at(1), True), ("b", "https://x.org/2", "t", "one", at(2), True))
    ingest.ingest_documents(stream(), tables, "feed")
    add(("c", "https://x.org/1", "t", "two", at(3), False))
    ingest.ingest_documents(stream(), tables, "feed")
    ingest.ingest_documents(stream(), tables, "feed")  # nothing new
    got = {r.document_id: (r.document_version, r.is_current, r.record_state, r.previous_document_id) for r in tables.read("documents").collect()}
    assert got == {"a": (1, False, "active", ""), "c": (2, True, "quarantined", "a")}
    assert {(r.run, r.disposition, r.n) for r in tables.read("ingested").collect()} == {("feed-0", "new", 1), ("feed-0", "duplicate_content", 1), ("feed-1", "updated", 1)}


def test_daily_counts_go_on_and_drop_what_is_too_late(spark, tmp_path):
    schema = "ts timestamp, event_type string"
    files, base = tmp_path / "in", f"file://{tmp_path}/out"
    add = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(files))
    read = lambda: {(r.day.day, r.event_type): r.n for r in counts.daily_counts(spark, str(files), schema, delay="2 days", base=base).collect()}
    add((at(1), "a"), (at(30), "a"), (at(31), "b"))
    assert read() == {(1, "a"): 1, (2, "a"): 1, (2, "b"): 1}
    add((at(2), "a"), (at(24 * 9), "a"))
    assert read() == {(1, "a"): 2, (2, "a"): 1, (2, "b"): 1, (10, "a"): 1}
    add((at(3), "a"), (at(24 * 9 + 1), "a"))  # the first is later than the watermark allows
    assert read() == {(1, "a"): 2, (2, "a"): 1, (2, "b"): 1, (10, "a"): 2}
