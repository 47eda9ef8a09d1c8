"""Nearest vectors against a plain loop, with copies, near ties and odd rows."""

import random

import pyarrow as pa
import pytest

from lodestone.operators import retrieval as R


@pytest.mark.parametrize("block, part", [(4096, 16384), (3, 7)])
def test_nearest_vectors_equal_a_plain_loop(spark, block, part):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.125, 0.1, 1.0]) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(20)] + [(300 + i, [x + 1e-8 * i for x in rows[3][1]]) for i in range(20)] + [(400, None), (401, [0.5, None, 0.1, 0.1, 0.1, 0.1]), (402, [1.0]), (403, [])]
    asked = [(i, e) for i, e in rows if i % 10 == 0 and e != []]
    got = {}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in R.vector_topk(vectors, spark.createDataFrame(asked, "query_id long, embedding array<double>"), 5, block, part).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))

    def dot(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return round(total, 6)

    for q, e in asked:
        if e is None:
            continue  # nothing has a score
        scores = sorted(((s is None, -(s or 0), i, s) for i, v in rows for s in [dot(e, v)]), key=lambda x: x[:3])
        assert sorted(got[q]) == [(n, i, s) for n, (_, _, i, s) in enumerate(scores[:5], 1)]


def test_queries_may_be_rows_of_the_vectors(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    got = R.vector_topk(vectors, vectors.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding"), 2).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == {(0, 1, 0, 1.0), (0, 2, 1, 1.0), (10, 1, 6, 19.0), (10, 2, 13, 19.0), (20, 1, 6, 37.0), (20, 2, 13, 37.0)}


def test_grams_leave_in_slices_of_few_texts():
    texts = ["".join(random.Random(i).choice("abcdefgh") for _ in range(200)) for i in range(R.SLICE * 2 + 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "bare"])
    out = list(R._gram_rows(True)(iter([batch])))
    assert len(out) == 3 and all(len(set(b.column(0).to_pylist())) <= R.SLICE for b in out)
    assert [(d, g) for b in out for d, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist())] == [(d, g) for d, t in enumerate(texts) for g in sorted(set(R._least_grams(t).tolist()))]
