import datetime

from pyspark.sql import functions as F

from lodestone.operators import reviews as RV
from lodestone.operators import runs as RU

T0 = datetime.datetime(2024, 1, 1, 12)


def test_outcomes_and_reasons(spark):
    df = spark.createDataFrame([("a", "x", "r1", 1.0), ("a", "y", "", 2.0), ("b", "x", "r2", 1.0), ("c", "y", None, None)], "run string, state string, reason string, value double")
    bad = F.col("state") == "x"
    assert {r.run: r.outcome for r in RU.run_outcomes(df, ["run"], bad, "value").collect()} == {"a": "partially_succeeded", "b": "failed", "c": "succeeded"}
    assert {r.run: (r.n, r.failures, r.reasons) for r in RU.stage_statistics(df, "run", bad, "reason").collect()} == {"a": (2, 1, "r1"), "b": (1, 1, "r2"), "c": (1, 0, "")}


def test_transitions_and_staleness(spark):
    df = spark.createDataFrame([(1, T0, "queued"), (1, T0 + datetime.timedelta(minutes=5), "done"), (1, T0 + datetime.timedelta(minutes=9), "queued")], "run int, ts timestamp, state string")
    assert [r.state for r in RU.illegal_transitions(df, "run", ["ts"], "state", {"queued": ("done",)}).collect()] == ["queued"]
    assert RU.stale_runs(df, "run", "ts", "2024-01-01 12:39:00", 30).count() == 0
    assert RU.stale_runs(df, "run", "ts", "2024-01-01 12:39:01", 30).count() == 1


def test_shares_of_nothing_fail(spark):
    none = spark.createDataFrame([], "x int")
    assert [(r.value, r.passed) for r in RU.readiness(none, {"ok": (F.col("x") > 0, 0.0)}).collect()] == [(None, False)]
    assert RV.completeness(none, ["x"]).first().percent is None


def test_gate_keeps_the_order_and_ignores_null(spark):
    df = spark.createDataFrame([(1, 5, None), (2, None, 1)], "id int, a int, b int")
    reasons = {"b": F.col("b") == 1, "a": F.col("a") > 3}
    assert {r.id: (r.reasons, r.passed) for r in RV.gate(df, "id", reasons).collect()} == {1: ("a", False), 2: ("b", False)}
    assert {r.reason: r.n for r in RV.reason_counts(df, reasons).collect()} == {"a": 1, "b": 1}


def test_a_snapshot_depends_on_rows_only(spark):
    df = spark.createDataFrame([("p", i, str(i)) for i in range(200)], "part string, id int, v string")
    digest = lambda x: RV.snapshot(x, "part", "id", ["v"]).first().digest
    assert digest(df) == digest(df.orderBy(F.desc("id")).repartition(7)) != digest(df.where("id > 0"))


def test_packing_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 1)], "query_id int, rank int, size int")
    assert [r["rank"] for r in RV.context_pack(df, "size", 10).collect()] == [1]


def test_changed_fields_and_fusion(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "x", "y")], "id int, p string, q string")
    b = spark.createDataFrame([(1, "x", None), (2, "z", None)], "id int, p string, q string")
    assert [(r.id, r.changed) for r in RV.changed_fields(a, b, "id", ["p", "q"]).collect()] == [(2, "p,q")]
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    assert [(r.doc_id, r.score) for r in RV.fuse(hits, hits.where("rank = 2")).orderBy("rank").collect()] == [(10, 0.8), (11, 0.75)]
