"""Bodies that are nearly the same as another one of their source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.likeness import common_length, matched, may_reach  # noqa: F401  the first for those who ask here
from ..sources.scratch import kept, scratch, stored
from .retrieval import _least_grams

BANDS, ROWS = 40, 3


def block_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks over the length of both: the longest common block, then the same to its left and right."""
    return 2 * matched(a, b) / (len(a) + len(b)) if len(a) + len(b) else 1.0


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, node, body) with the key of each band of a MinHash over the body's least grams, and the body's length."""
    slopes, shifts = (np.random.default_rng(5).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1))
    for batch in batches:
        keys = np.empty((len(batch), BANDS), np.int64)
        for row, body in zip(keys, batch.column(2).to_pylist(), strict=True):
            grams = np.unique(_least_grams(body)).view(np.uint64)
            h = grams[:, None] * slopes + shifts
            least = (h ^ (h >> np.uint64(29))).min(axis=0).reshape(BANDS, ROWS)
            row[:] = ((least[:, 0] * np.uint64(0x9E3779B97F4A7C15) + least[:, 1]) * np.uint64(0xBF58476D1CE4E5B9) + least[:, 2]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array([len(b) for b in batch.column(2).to_pylist()], pa.int32())], ["source", "node", "bands", "size"])


def _alike(least: float):
    """(node, other, ratio) both ways of the pairs of bodies that are near; what can't be near is told once for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for node, other, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if may_reach(a, b, least * (len(a) + len(b)) / 2 - 1e-9):
                    found += [(x, y, r) for x, y, r in ((node, other, block_ratio(a, b)), (other, node, block_ratio(b, a))) if r >= least]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["node", "other", "ratio"])

    return run


def template_similarity(documents: DataFrame, least: float = 0.88, shortest: int = 120, longest: int = 6000, rounds: int = 2) -> DataFrame:
    """(doc_id, sibling_id, similarity) of the documents (doc_id, source, text) whose body is nearly that of another document of their source.

    A body is the first `longest` characters without white space, of `shortest` at least. Two are near where the share of matching blocks (block_ratio,
    the document's body first) is `least` or more and they are not equal. similarity is the best share among the siblings that
    were tried, and every document with a near sibling that shares a bucket of its sketch is found; it need not be the nearest of all.

    Bodies meet under the bands of a MinHash over grams of 12 characters: two whose grams overlap by half share a bucket with
    probability 0.995. Equal bodies are one. In a bucket each first meets `rounds` bodies drawn there; only those that match
    none of these meet the others of the bucket, so a group of near copies doesn't meet pairwise. Lengths that fit are asked for where bodies meet, before any
    text moves; then a bound by the common subsequence of ever longer starts, which no share of blocks exceeds, comes before the blocks. Null sources are one source, null texts empty; rows that repeat a doc_id stand once for each.
    """
    with scratch(documents.sparkSession):
        docs = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.substr(T.compact(F.col("text")), F.lit(1), F.lit(longest)).alias("body")).where(F.length("body") >= shortest)
        docs = stored(docs.withColumn("node", F.xxhash64("source", "body")), "bodies")
        bodies = stored(docs.groupBy("source", "node").agg(F.any_value("body").alias("body"), F.min("doc_id").alias("doc_id")), "distinct-bodies")
        sketches = stored(bodies.select("source", "node", "body").mapInArrow(_sketched, "source string, node long, bands array<long>, size int"), "sketches")
        rows = sketches.select("node", F.posexplode("bands").alias("band", "key"), "source", "size")
        shared = rows.groupBy("source", "band", "key").agg(F.count("*").alias("n")).where("n > 1")
        rows = stored(rows.join(shared, ["source", "band", "key"]).select("node", F.xxhash64("source", "band", "key").alias("bucket"), "size"), "buckets")
        partners = rows.select(F.col("node").alias("other"), "bucket", F.col("size").alias("other_size"))

        def pairs_of(met: DataFrame) -> DataFrame:
            """Each pair once, if the lengths allow the share."""
            fit = met.where((F.col("node") != F.col("other")) & (2 * F.least("size", "other_size") >= least * (F.col("size") + F.col("other_size")) - 1e-9))
            return fit.select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other")).distinct()


        def near(pairs: DataFrame) -> DataFrame:
            named = lambda side: bodies.select(F.col("node").alias(side), F.col("body").alias(f"{side}_body"))
            both = pairs.join(named("node"), "node").join(named("other"), "other").select("node", "other", "node_body", "other_body")
            return stored(both.repartition("node", "other").mapInArrow(_alike(least), "node long, other long, ratio double"), "near-bodies")

        tried, found = None, None
        for turn in range(rounds):
            head = rows.groupBy("bucket").agg(F.min_by(F.struct(F.col("node").alias("other"), F.col("size").alias("other_size")), F.xxhash64(F.lit(turn), "node")).alias("head"))
            pairs = pairs_of(rows.join(head, "bucket").select("node", "size", "head.*"))
            pairs = stored(pairs if tried is None else pairs.join(tried, ["node", "other"], "left_anti"), "tried-pairs")
            fresh = near(pairs)
            tried, found = (pairs, fresh) if tried is None else (tried.union(pairs), found.union(fresh))
        open_ = rows.join(found.select("node").distinct(), "node", "left_anti")
        rest = pairs_of(open_.join(partners, "bucket")).join(tried, ["node", "other"], "left_anti")
        found = found.union(near(rest).join(open_.select("node").distinct(), "node", "left_semi"))
        best = found.groupBy("node").agg(F.max(F.struct("ratio", (-F.col("other")).alias("order"), "other")).alias("x")).select("node", F.col("x.ratio").alias("similarity"), F.col("x.other").alias("other"))
        named = best.join(bodies.select(F.col("node").alias("other"), F.col("doc_id").alias("sibling_id")), "other")
        return kept(docs.select("doc_id", "node").join(named, "node").select("doc_id", "sibling_id", "similarity"), "template-similarity")
