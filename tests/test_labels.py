from pyspark.sql import functions as F

from lodestone.operators import labels as L


def test_template_fills_only_what_is_missing(spark):
    mine = spark.createDataFrame([(1, "a", ""), (2, None, "x"), (None, "n", None)], "k int, name string, place string")
    theirs = spark.createDataFrame([(1, "b", "p"), (3, "c", " "), (None, "m", "q")], "k int, name string, place string")
    got = {(r.k, r.name, r.place, r.origin, tuple(r.added), tuple(r.conflicting)) for r in L.filled_from_template(mine, theirs, "k", ["name", "place"]).collect()}
    assert got == {
        (1, "a", "p", "current", ("place",), ("name",)), (2, None, "x", "current", (), ()), (3, "c", None, "template", ("name",), ()),
        (None, "n", None, "current", (), ()), (None, "m", "q", "template", ("name", "place"), ()),
    }


def test_one_record_per_label(spark):
    labels = spark.createDataFrame([(1,), (1,), (2,), (None,)], "document_id int")
    documents = spark.createDataFrame([(1, "s"), (None, "t")], "document_id int, source string")
    events = spark.createDataFrame([(1, 9), (1, 7)], "document_id int, event_id int")
    got = L.label_context(labels, documents, events).select("document_id", "document.source", "event.event_id").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "s", 7), (1, "s", 7), (2, None, None), (None, None, None)]


def test_excerpts_and_changes(spark):
    long = "x" * 300
    rows = [("One here. Two there. " + "w" * 210 + ". End.",), (long,), ("",), (None,), ("a\nb\nb",)]
    table = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in table.select(L.sentence_excerpt(F.col("t"))).collect()]
    assert got[0] == "One here. Two there." and got[1] == long[:220] and got[2:4] == ["", ""]
    assert [r[0] for r in table.select(L.line_changes(F.lit("a\nc"), F.col("t"), 2)).collect()][-1] == "-c\n+b"
