"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, components, kept, mixed, only, scratch, signed, stored

#: Rows of a bucket that meet in one task, at most; a larger bucket is split into slices of about half of it that meet pairwise.
BLOCK = 2048
PLACE = ["table_no", "key", "group", "i", "j"]


def _collides(steps: float) -> float:
    """How likely two points fall in one cell of a projection whose cells are `steps` times as wide as the points' distance."""
    inside = math.erf(steps / math.sqrt(2))
    return inside - 2 / (math.sqrt(2 * math.pi) * steps) * (1 - math.exp(-(steps**2) / 2))


def layout(cosine: float, rows: int, cell: float, recall: float) -> tuple[int, int]:
    """(projections of a table, tables): so many projections that unrelated vectors, at a right angle, meet about once in
    `rows` pairs of a table, and so many tables that a pair at the threshold meets in one with probability `recall`."""
    near, far = (_collides(cell / math.sqrt(2 - 2 * c)) for c in (cosine, 0.0))
    projections = max(4, math.ceil(math.log(max(rows, 2)) / -math.log(far)))
    return projections, math.ceil(math.log(1 - recall) / math.log(1 - near**projections))


def _unit(lists: pa.Array, width: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no square under- or overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(rows: DataFrame, projections: int, tables: int, cell: float, seed: int) -> DataFrame:
    """rows (rep, group, weight, width, embedding) with keys: for each table the hash of the cells that the unit vector falls in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            keys = np.empty((len(batch), tables), np.int64)
            width = batch.column("width").to_numpy()
            for w in np.unique(width).tolist():
                if w not in drawn:
                    rng = np.random.default_rng([seed, w])
                    drawn[w] = rng.standard_normal((w, tables * projections)), rng.uniform(0, cell, tables * projections)
                at = np.flatnonzero(width == w)
                slopes, shift = drawn[w]
                cells = np.floor((_unit(batch.column("embedding").take(pa.array(at)), w) @ slopes + shift) / cell).astype(np.int64).view(U64).reshape(len(at), tables, projections)
                key = np.broadcast_to(batch.column("group").to_numpy()[at].view(U64)[:, None], (len(at), tables)) + np.arange(tables, dtype=U64)
                for i in range(projections):
                    key = mixed(key * U64(0xD6E8FEB86659FD93) + cells[:, :, i])
                keys[at] = signed(key)
            offsets = np.arange(0, keys.size + 1, tables, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], [*batch.schema.names, "keys"])

    return rows.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, keys array<long>")


def _linked(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, those of a block together, as (u, node, v, links): so many rows more link with the vector `node` of u, and v is the smallest of the block that it reaches."""

    def block(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if len(t) < 2:
            return None
        t = t.take(pa.array(np.argsort(t["rep"].to_numpy(), kind="stable")))
        reps, nodes, weight, slot, table = (t[c].to_numpy() for c in ("rep", "node", "weight", "slice", "table_no"))
        x = _unit(t["embedding"].combine_chunks(), t["width"][0].as_py())
        alike = x @ x.T >= cosine
        np.fill_diagonal(alike, False)
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        counted = np.argwhere(np.triu(alike & (slot[:, None] != slot) if i != j else alike))
        if table[0] and len(counted):  # a pair counts in the first table where it meets
            keys = t["keys"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)[:, : table[0]]
            new = np.ones(len(counted), bool)
            for at in range(0, len(counted), 1 << 16):
                a, b = counted[at : at + (1 << 16)].T
                new[at : at + (1 << 16)] = ~(keys[a] == keys[b]).any(axis=1)
            counted = counted[new]
        if not len(counted):  # all have met, and spread their labels, before
            return None
        links = sum(np.bincount(counted[:, a], weight[counted[:, b]], len(t)) for a, b in ((0, 1), (1, 0))).astype(np.int64)
        least = np.arange(len(t))
        while True:  # labels spread over the matrix until they settle
            near = np.minimum(least, np.where(alike, least, len(t)).min(axis=1))
            near = near[near]
            if (near == least).all():
                break
            least = near
        at = np.flatnonzero((links > 0) | (least != np.arange(len(t))))
        return reps[at], nodes[at], reps[least[at]], links[at]

    names, held, at = ["u", "node", "v", "links"], [], None
    for batch in batches:
        place = np.stack([batch.column(c).to_numpy() for c in PLACE])
        bounds = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        found = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            if at is not None and held and tuple(place[:, a]) != at:
                found.append(block(pa.Table.from_batches(held)))
                held = []
            at = tuple(place[:, a])
            held.append(batch.slice(a, b - a))
        if found := [x for x in found if x]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names)
    if held and (last := block(pa.Table.from_batches(held))):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, cell: float = 1.6, recall: float = 0.9999, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Two rows link when their labels are equal and the cosine of their vectors, in double precision, is at least
    `cosine`; n_links counts the other rows that a row links with, component_id is the smallest vec_id that links reach.

    Each table hashes a unit vector to the cells, `cell` wide, of random Gaussian projections; what falls together in one
    of the tables is compared exactly. The number of projections follows the number of rows and the number of tables the
    recall, which is that of a pair at the very threshold; closer pairs meet more surely. No link is found that isn't one.

    Equal vectors of a label are one row with a weight, so copies don't meet. Vectors move only for tables in which their
    bucket holds others. A bucket of more than BLOCK rows is split into slices, each two of which meet in a task of their own; a task
    gives a row's links as a number and one neighbour, not the pairs. A pair is counted in the first table where it meets.

    Null labels, null, empty or zero vectors and those with a null or non-finite component link with nothing; so do vectors of unlike
    length, and rows with a null vec_id (their component_id is null, kept is false). Rows that repeat a vec_id are rows of their
    own, which share a component; equal ones link. Other columns are not read. An empty table gives no rows.
    """
    with scratch(vectors.sparkSession):
        vectors = only(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
        usable = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("embedding", lambda c: c != 0)
        whole = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(usable)
        of = F.xxhash64("label", F.size("embedding"))
        same = stored(whole.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "distinct-vectors")
        rows = same.select("rep", F.xxhash64("embedding").alias("node"), of.alias("group"), F.size("embedding").alias("width"), "weight", "embedding")
        n = same.count()
        projections, tables = layout(cosine, n, cell, recall)
        hashed = stored(_hashed(rows, projections, tables, cell, seed), "hashed-vectors")

        places = hashed.select("rep", "node", "group", F.posexplode("keys").alias("table_no", "key"))
        crowded = places.groupBy("table_no", "key").agg(F.count("*").alias("n")).where("n > 1")
        slices = F.ceil(F.col("n") / F.lit(BLOCK // 2)).cast("int")
        slices = F.when(F.col("n") <= BLOCK, 1).otherwise(slices)
        meet = places.join(crowded, ["table_no", "key"]).withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("rep", "node", "table_no"), F.col("slices")).cast("int"))
        meet = meet.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        meet = meet.select("rep", "node", "group", "table_no", "key", "slice", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"))
        moved = meet.join(hashed, ["rep", "node", "group"]).select(*PLACE, "slice", "rep", "node", "width", "weight", "embedding", "keys").repartition(*PLACE).sortWithinPartitions(*PLACE)
        found = stored(moved.mapInArrow(lambda batches: _linked(batches, cosine), "u long, node long, v long, links long"), "vector-links")

        classes = components(found.select("u", "v"))
        links = found.groupBy(F.col("u").alias("rep"), "node").agg(F.sum("links").alias("links"))
        named = same.withColumn("node", F.xxhash64("embedding")).join(links, ["rep", "node"], "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left")
        named = named.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
        out = vectors.join(named, ["label", "embedding"], "left").select("vec_id", F.col("links"), "component")
        n_links = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)))
        component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
        return kept(out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")), "near-vectors")
