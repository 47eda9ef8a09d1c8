from pyspark.sql import functions as F

from lodestone.operators import curation as C


def test_page_margins(spark):
    pages = [(1, p, f"Head  er\nbody {p}\nmore {p}\nand {p}\nfoot") for p in range(3)] + [(2, 0, "alone\nalone"), (3, 0, None), (3, 1, None)]
    got = C.page_margins(spark.createDataFrame(pages, "doc long, page int, text string"), "doc", "page", "text").collect()
    assert sorted({r.line for r in got if r.removed}) == ["Head  er", "foot"] and sum(r.removed for r in got) == 6 and len(got) == 19


def test_recheck_modes(spark):
    rows = spark.createDataFrame([("open", None, "h", None, None)], "status string, published date, file_hash string, validator string, checked_at timestamp")
    reasons = [C.recheck_policy(rows, "2024-01-01", m).first()[-2:] for m in ("force", "new_only", "recent")]
    assert reasons == [("force", True), ("new_only", False), ("old_with_hash", False)]


def test_breaker_trips_after_three_failures(spark):
    runs = spark.createDataFrame([(1, i, i in (1, 2, 3)) for i in range(6)], "k int, i int, bad boolean")
    assert [r.tripped for r in C.circuit_breaker(runs, "k", ["i"], F.col("bad")).orderBy("i").collect()] == [False] * 4 + [True, False]


def test_value_issues_of_nulls(spark):
    rows = spark.createDataFrame([(1, "a", True, None), (2, "z", None, None), (3, None, False, None)], "id int, v string, open boolean, basis string")
    got = C.value_issues(rows, "id", {"v": ("a",)}, {"open": (F.col("open"), F.col("basis") != "")}).collect()
    assert sorted(map(tuple, got)) == [(1, "open", "basis_missing"), (2, "v", "value_not_allowed")]
