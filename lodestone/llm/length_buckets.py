"""Packing by optimal length buckets: boundaries by dynamic programming, then token-budget batches."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import only

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """How many words the text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0))


def histogram(lengths: DataFrame, exact_to: int = 1024, steps: int = 128) -> DataFrame:
    """(top, longest, n, total): lengths up to exact_to each for itself, longer ones in bins that widen by 1/steps
    of a power of two, so the table has at most exact_to + 1 + 64 * steps rows whatever the corpus is."""
    n = F.col("n_tokens")
    rank = F.when(n <= exact_to, n.cast("double")).otherwise(exact_to + F.ceil(steps * F.log2(n / exact_to)).cast("double"))
    return lengths.groupBy(rank.cast("long").alias("top")).agg(F.max("n_tokens").alias("longest"), F.count("*").alias("n"), F.sum("n_tokens").alias("total"))


def _next_row(best: np.ndarray, seen: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least best[i] + cost(i, j) over i < j for each j, and the first such i: it never decreases with j, so halves bound each other."""
    out, came = np.full(len(seen), np.inf), np.zeros(len(seen), np.int64)
    todo = [(1, len(seen) - 1, 0, len(seen) - 2)]
    while todo:
        low, high, a, b = todo.pop()
        if low > high:
            continue
        j = (low + high) // 2
        end = min(b, j - 1) + 1
        total = best[a:end] + (seen[j] - seen[a:end]) * longest[j - 1]
        i = a + int(total.argmin())
        out[j], came[j] = total[i - a], i
        todo += [(low, j - 1, a, i), (j + 1, high, i, b)]
    return out, came


def optimal_boundaries(longest: np.ndarray, n: np.ndarray, buckets: int) -> list[int]:
    """At most so many bucket lengths, each the longest of some bin, with the least padding: exact dynamic programming.

    cost(i, j) pads bins i+1..j to longest[j]; since the totals are fixed it is enough to minimise padded length.
    """
    m = len(longest)
    if not m:
        return []
    seen = np.concatenate([[0], np.cumsum(n)]).astype(float)
    best, came, ends = np.full(m + 1, np.inf), [], []
    best[0] = 0
    for _ in range(min(buckets, m)):
        best, at = _next_row(best, seen, longest)
        came.append(at)
        ends.append(best[m])
    k, at, out = int(np.argmin(ends)), m, []
    while at > 0:
        out.append(int(longest[at - 1]))
        at, k = int(came[k][at]), k - 1
    return out[::-1]


def length_buckets(docs: DataFrame, buckets: int = 16, budget: int = 32768, length=None, shard_rows: int = 50_000) -> DataFrame:
    """(doc_id, n_tokens, bucket_length, shard, batch, place, batch_rows), a row for each row of docs.

    length: the column of token counts; by default the number of words of `text`. The boundaries come from the
    histogram of all rows. A batch holds rows of one bucket, padded to bucket_length, of at most `budget` tokens
    with the padding; a row longer than that has a batch alone. (bucket_length, shard, batch) names a batch.
    Large buckets are dealt into shards of about shard_rows rows by a hash, so none meets in one task; each shard
    leaves one batch that isn't full.

    Null and empty texts have length 0 and share the first bucket; null doc_ids and repeated rows are kept as
    rows; ties are ordered by a hash of the row. Other columns are not read. An empty table gives no rows.
    """
    count = (word_count(F.col("text")) if length is None else F.coalesce(length, F.lit(0))).cast("long")
    lengths = (only(docs, "doc_id", "text") if length is None else docs).select("doc_id", count.alias("n_tokens"))
    bins = sorted(histogram(lengths).collect())  # bounded: see histogram
    longest, n = np.array([b.longest for b in bins]), np.array([b.n for b in bins])
    bounds = optimal_boundaries(longest, n, buckets)
    bucket, shards, low = F.lit(None).cast("long"), F.lit(1), -1
    for top in bounds[::-1]:
        bucket = F.when(F.col("n_tokens") <= top, F.lit(top).cast("long")).otherwise(bucket)
    for top in bounds:
        rows = int(n[(longest > low) & (longest <= top)].sum())
        shards, low = F.when(F.col("bucket_length") == top, math.ceil(rows / shard_rows)).otherwise(shards), top
    dealt = lengths.withColumn("bucket_length", bucket).withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), shards).cast("int"))
    at = F.row_number().over(Window.partitionBy("bucket_length", "shard").orderBy("n_tokens", "doc_id")) - 1
    rows = F.greatest(F.lit(1), F.floor(budget / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    return dealt.select("doc_id", "n_tokens", "bucket_length", "shard", (at / rows).cast("long").alias("batch"), (at % rows).cast("int").alias("place"), rows.alias("batch_rows"))
