"""Hard negatives and near vectors against brute force, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import embedding_dedup, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, Label string"  # a clashing extra column


def test_products_in_residues_are_exact():
    rng = np.random.default_rng(3)
    for width, most in ((1, 3), (64, 256), (2500, 300), (7, 1 << 28)):
        a, b = (rng.integers(-most, most, (n, width)) for n in (5, 9))
        want = a.astype(object) @ b.astype(object).T
        moduli = hard_negatives.primes(int(abs(want).max()))
        assert len(set(moduli)) == len(moduli) and (hard_negatives.products(a, b, moduli) == want).all()


def mined(rows, anchors, positives=5, negatives=5):
    rows = sorted({(i, label, tuple(x)) for i, label, x in rows})
    out = set()
    for i, label, x in rows:
        if not anchors(i):
            continue
        score = lambda y: sum(p * q for p, q in zip(x, y, strict=True))  # noqa: B023, E731
        order = sorted((-score(y), j, other) for j, other, y in rows if j != i)
        for s, j, _ in [r for r in order if r[2] == label][:positives]:
            window = [r for r in order if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:negatives]
            out |= {(i, j, k, r[1], -s, -r[0]) for k, r in enumerate(window, 1)}
    return out


@pytest.mark.parametrize("block, slice_rows", [(4096, 8192), (7, 11)])
def test_hard_negatives_equal_brute_force(spark, block, slice_rows):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), [int(c) for c in rng.integers(-3, 6, 6)]) for i in range(150)]  # small numbers: many ties
    rows += rows[:20]  # repeated rows
    odd = [(None, 1, [1] * 6), (300, None, [1] * 6), (310, 1, None), (320, 2, [1, None, 1, 1, 1, 1])]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, label int, x array<long>, X2 string")
    got = hard_negatives.mine(table, F.col("vec_id") % 10 == 0, block=block, slice_rows=slice_rows).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == mined(rows, lambda i: i % 10 == 0)


def test_quantised_takes_whole_finite_vectors(spark):
    nan, inf = float("nan"), float("inf")
    table = spark.createDataFrame([(1, [0.5, -0.001], 1, "a"), (2, [nan, 1.0], 1, "a"), (3, [inf, 1.0], 1, "a"), (4, None, 1, "a"), (5, [None, 1.0], 1, "a"), (6, [1.0, 1.0], None, "a"), (7, [], 2, "a")], SCHEMA)
    assert {(r.vec_id, tuple(r.x)) for r in hard_negatives.quantised(table).collect()} == {(1, (128, -1)), (7, ())}


def test_hard_negatives_without_rows_partners_or_room(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, x array<long>")
    assert hard_negatives.mine(empty, F.col("vec_id") % 10 == 0).collect() == []
    one_label = spark.createDataFrame([(i, 1, [1, 2]) for i in range(20)], empty.schema)
    assert hard_negatives.mine(one_label, F.col("vec_id") % 10 == 0).collect() == []
    unlike = spark.createDataFrame([(0, 1, [1, 2]), (1, 1, [1]), (2, 2, [1, 0, 9])], empty.schema)  # missing components are 0
    assert [tuple(r) for r in hard_negatives.mine(unlike, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 1, 1)]
    with pytest.raises(OverflowError):
        hard_negatives.mine(spark.createDataFrame([(0, 1, [1 << 40])], empty.schema), F.col("vec_id") == 0)


def linked(rows):
    """vec_id, n_links and component of each row, by all pairs."""
    parent, n = {}, [0] * len(rows)

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    usable = [i is not None and label is not None and x is not None and None not in x and np.isfinite(x).all() and np.any(x) for i, x, label in rows]
    for a, (i, x, label) in enumerate(rows):
        for b, (j, y, other) in enumerate(rows[:a]):
            if usable[a] and usable[b] and label == other and len(x) == len(y) and np.dot(np.float32(x).astype(float), np.float32(y).astype(float)) >= 0.98 * np.linalg.norm(np.float32(x).astype(float)) * np.linalg.norm(np.float32(y).astype(float)):
                n[a] += 1
                n[b] += 1
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return sorted([(i, k, None if i is None else find(i)) for (i, _, _), k in zip(rows, n, strict=True)], key=repr)


@pytest.mark.parametrize("block", [2048, 16])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(9)
    rows = []
    for size in (1,) * 40 + (2, 3, 5, 60):  # one large group of near copies
        base = rng.standard_normal(24)
        for _ in range(size):
            rows.append((len(rows), (base + rng.standard_normal(24) * 0.1 * np.linalg.norm(base) / 24**0.5).tolist(), 1 + len(rows) % 2 if size < 9 else 1))
    rows += [(len(rows) + k, rows[60][1], rows[60][2]) for k in range(30)]  # exact copies
    rows += [(900, [3.0 * c for c in rows[2][1]], rows[2][2]), (901, [0.0] * 24, 1), (902, None, 1), (903, [float("nan")] * 24, 1), (904, [None] + [1.0] * 23, 1), (905, rows[2][1], None), (None, rows[2][1], rows[2][2]), (906, [], 1), (907, [1.0], 1), (908, [2.0], 1), (909, [1e30] * 24, 1), (910, [1e-30] * 24, 1)]
    rows += [rows[3], rows[3]]  # repeated rows
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).withColumn("rep", F.lit("x"))
    got = embedding_dedup.near_vectors(table).collect()
    assert sorted([tuple(r)[:3] for r in got], key=repr) == linked(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_near_vectors_of_an_empty_table(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_layout_reaches_the_recall():
    for rows in (100, 10_000, 10**9):
        projections, tables = embedding_dedup.layout(0.98, rows, 1.6, 0.9999)
        near = embedding_dedup._collides(1.6 / 0.04**0.5)
        assert 1 - (1 - near**projections) ** tables >= 0.9999
