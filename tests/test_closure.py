"""Classes and timelines against a union-find."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import closure as C


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("busy", [100_000, 5])
def test_closure_of_chains_cycles_stars_and_repeats(spark, monkeypatch, busy):
    monkeypatch.setattr(C, "BUSY", busy)
    rng = random.Random(2)
    names = list(range(3000))
    rng.shuffle(names)
    chain = list(zip(names[:1500], names[1:1501], strict=True))
    cycle = [(names[1600 + i], names[1600 + (i + 1) % 50]) for i in range(50)]
    star = [(names[2000], x) for x in names[2001:2400]]
    loose = [(rng.choice(names[2500:]), rng.choice(names[2500:])) for _ in range(200)]
    pairs = chain + cycle + star + loose + [(7000, 7000)] + star[:5]
    got = {r.id: r.root for r in C.closure(spark.createDataFrame([*pairs, (None, 1), (9, None)], "a long, b long"), "a", "b").collect()}
    assert got == roots(pairs)


def test_closure_of_an_empty_table(spark):
    assert C.closure(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


@pytest.mark.parametrize("parts", [None, 7])
def test_timelines_are_numbered_over_parts(spark, parts):
    rng = random.Random(3)
    rows = [(f"e{i}", f"e{i - 1}" if 0 < i < 300 else rng.choice(["", None, "gone", f"e{rng.randrange(400)}"]), f"2026-01-{rng.randrange(1, 28):02}", "x") for i in range(400)]
    rows += [rows[5], (None, "e1", "2026-01-01", "x"), ("", "e1", "2026-01-01", "x")]
    events = spark.createDataFrame(rows, "event_id string, related string, day string, `a.b` string")
    got = C.timelines(events, "event_id", "related", ["day"], parts).collect()
    named = [r for r in rows if r[0]]
    root = roots([(k, rel or k) for k, rel, _, _ in named])
    want = {}
    for k, _, day, _ in named:
        want.setdefault(root[k], []).append((day, k))
    assert len(got) == len(named)
    for line, events_ in want.items():
        mine = sorted((r.position, r.day, r.event_id) for r in got if r.timeline == line)
        assert mine == [(i, *x) for i, x in enumerate(sorted(events_), 1)]


def test_timeline_of_seeds(spark):
    events = spark.createDataFrame([(1, None, 3), (2, 1, 2), (3, 2, 1), (4, None, 1)], "id long, rel long, day int")
    seeds = spark.createDataFrame([(3,), (3,), (99,)], "s long")
    got = C.timeline_of(events, seeds, "id", "rel", ["day"]).orderBy("position").collect()
    assert [(r.seed, r.id, r.position) for r in got] == [(3, 3, 1), (3, 2, 2), (3, 1, 3)]
    assert C.timelines(events.where(F.lit(False)), "id", "rel", ["day"]).collect() == []
