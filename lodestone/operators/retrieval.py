"""Retrieval over a batch of queries: BM25, vectors, fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.window import Window

from ..functions import text as T


def postings(documents: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl): how often each term stands in each document, and the document's length in terms."""
    terms = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    rows = documents.select("doc_id", terms.alias("terms")).select("doc_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return rows.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


def bm25_topk(documents: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query (query_id, text).

    Only postings of query terms leave their task; the document frequency comes from the same rows.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))).alias("term"))
    size = documents.agg(F.count("*").alias("n"), F.avg(F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"))).alias("avgdl")).first()
    n, avgdl = size.n, size.avgdl or 1.0
    # Documents are dealt out before their terms meet the queries, so a frequent term is no task's alone; the broadcast tables have a row for each term of a query at most.
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)).alias("terms")).select("doc_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    held = rows.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    scored = held.repartition(tasks, "doc_id").join(F.broadcast(df), "term").join(F.broadcast(terms), "term").groupBy("query_id", "doc_id").agg(F.bround(F.sum(weight), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _every_score(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of all pairs, the queries broadcast in blocks of bounded size."""
    dot = F.aggregate(F.zip_with("embedding", "q", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    blocks = queries.count() // 1000 + 1
    out = None
    for i in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        one = block.agg(F.collect_list(F.struct("query_id", F.col("embedding").alias("q"))).alias("qs"))
        rows = vectors.withColumn("one", F.lit(1)).join(F.broadcast(one.withColumn("one", F.lit(1))), "one").select("vec_id", "embedding", F.explode("qs").alias("x")).select("vec_id", "embedding", "x.query_id", "x.q")
        rows = rows.select("query_id", "vec_id", dot.alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _nearest(k: int, size: int, chunk: int = 256) -> Callable:
    """The pairs of a block of queries and a slice of vectors that may be among a query's k best once scores are rounded to six places; of equal scores the first k."""

    def matrix(table: pa.Table) -> np.ndarray:
        flat = table["embedding"].combine_chunks().flatten() if len(table) else pa.array([], pa.float64())
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), size)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, theirs = matrix(left), matrix(right)
        asked, ids = (np.array(t[c].to_pylist(), np.int64) for t, c in ((left, "query_id"), (right, "vec_id")))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for start in range(0, len(mine) if len(theirs) else 0, chunk):
            some = mine[start : start + chunk]
            near = some @ theirs.T
            last = np.partition(near, len(theirs) - k, axis=1)[:, len(theirs) - k] if len(theirs) > k else np.full(len(some), -np.inf)
            slack = 1e-6 + 1e-12 * (1 + np.abs(some).sum(axis=1) * np.abs(theirs).max())  # rounding makes scores equal; another order of sums makes them differ
            q, v = np.nonzero(near >= (last - slack)[:, None])
            score = np.zeros(len(q))
            for x, y in zip(theirs.T, some.T, strict=True):  # in the order of places, as a loop adds
                score += x[v] * y[q]
            order = np.lexsort((ids[v], -score, q))
            q, v, score = q[order], v[order], score[order]
            fresh = np.ones(len(q), bool)
            fresh[1:] = (q[1:] != q[:-1]) | (score[1:] != score[:-1])
            starts = np.flatnonzero(fresh)
            keep = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) < k
            found.append((asked[start + q[keep]], ids[v[keep]], score[keep]))
        return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*found, strict=True), strict=True)})

    return run


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, part: int = 16384) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest by cosine of unit vectors.

    queries: (query_id, embedding), a stated set. Blocks of queries meet slices of vectors in tasks of bounded size, as products of matrices; only what may
    be among the best leaves a task, with scores summed place by place. Vectors and queries with nulls, components that aren't finite or another
    length than the longest query meet all in the plain way. Ids are longs.
    """
    size = queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    # abs(x) < 1e18 is false for NaN too, which Spark orders last
    plain = F.coalesce((F.size("embedding") == size) & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < 1e18, F.lit(False))), F.lit(False)) & F.lit(size > 0)
    whole, odd, asked, odd_asked = vectors.where(plain), vectors.where(~plain), queries.where(plain), queries.where(~plain)
    blocks, slices = (-(-df.count() // n) or 1 for df, n in ((asked, block), (whole, part)))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, so that small tables aren't drawn together into one task
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = F.col("embedding").alias("embedding")  # a column of each side, also where queries are rows of the vectors
    left = asked.select("query_id", own, deal("query_id", blocks).alias("b"), every(slices).alias("s")).repartition(tasks, "b", "s")
    right = whole.select("vec_id", own, deal("vec_id", slices).alias("s"), every(blocks).alias("b")).repartition(tasks, "b", "s")
    out = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(_nearest(k, size), "query_id long, vec_id long, score double")
    if not odd.isEmpty():
        out = out.unionByName(_every_score(odd, queries))
    if not odd_asked.isEmpty():
        out = out.unionByName(_every_score(whole, odd_asked))
    out = out.select("query_id", "vec_id", F.bround("score", 6).alias("score"))
    part_ = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy(F.desc("score"), "vec_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = out.withColumn("rank", F.row_number().over(part_)).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: Characters without white space: the grams that documents and quotes meet by; how many grams compete for each; the least quote that holds so many.
GRAM, REACH = 12, 13
SEEDED = GRAM + REACH - 1
SLICE = 128


def _least_grams(text: str) -> np.ndarray:
    """For each run of REACH grams the least of their hashes: a text that holds another one has all of its."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - GRAM + 1
    if n < REACH:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(0xD6E8FEB86659FD93) + c[i : i + n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.lib.stride_tricks.sliding_window_view(h, REACH).min(axis=1).view(np.int64)


def _gram_rows(every: bool) -> Callable:
    """The columns but the last, and each distinct least gram of that or, unless every, the first one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, len(whole), SLICE)):  # the grams of few texts are held at once
            found = [_least_grams(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            found = [np.unique(g) if every else g[:1] for g in found]
            at = pa.array(np.repeat(np.arange(len(found)), [len(g) for g in found]))
            grams = pa.array(np.concatenate([np.empty(0, np.int64), *found]))
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[:-1]], grams], [*batch.schema.names[:-1], "gram"])

    return rows


def locate_quotes(quotes: DataFrame, documents: DataFrame, block: int = 1000) -> DataFrame:
    """(item_id, doc_id, start_offset, end_offset, method) of quotes that stand in a document as they are, or but for white space.

    quotes: (item_id, text), a stated set; those of fewer than 4 characters without white space are not looked for.
    Documents and quotes meet on hashes of 12 characters without white space, the least of 13 neighbours, so only documents
    that hold the one of the quote's begin are searched. Quotes of fewer than 24 such characters are broadcast in
    blocks of about `block` and looked for in each document.
    """
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    wanted = quotes.select("item_id", F.col("text").alias("quote"), bare("text").alias("bare")).where("length(bare) >= 4")
    rows = documents.select("doc_id", bare("text").alias("bare"))
    with_gram = lambda df: StructType([*df.schema.fields[:-1]]).add("gram", LongType())
    seeds, short = wanted.where(F.length("bare") >= SEEDED), wanted.where(F.length("bare") < SEEDED)
    pairs = rows.mapInArrow(_gram_rows(True), with_gram(rows)).join(seeds.mapInArrow(_gram_rows(False), with_gram(seeds)), "gram").select("doc_id", "item_id", "quote")
    n = short.count()
    blocks = n // block + 1 if n else 0
    for i in range(blocks):
        one = short.where(F.pmod(F.xxhash64("item_id", "quote"), F.lit(blocks)) == i).agg(F.collect_list(F.struct("item_id", "quote", "bare")).alias("qs"))
        held = rows.crossJoin(F.broadcast(one)).select("doc_id", F.explode(F.filter("qs", lambda q: F.contains(F.col("bare"), q["bare"]))).alias("q"))
        pairs = pairs.unionByName(held.select("doc_id", "q.item_id", "q.quote"))
    both = pairs.distinct().join(documents.select("doc_id", "text"), "doc_id")
    both = both.withColumn("at", F.expr("locate(quote, text)")).withColumn("squeezed", F.expr("locate(regexp_replace(quote, '\\\\s+', ''), regexp_replace(text, '\\\\s+', ''))"))
    exact = F.col("at") > 0
    return both.where((F.col("at") > 0) | (F.col("squeezed") > 0)).select("item_id", "doc_id", F.when(exact, F.col("at") - 1).alias("start_offset"), F.when(exact, F.col("at") - 1 + F.length("quote")).alias("end_offset"), F.when(exact, "exact").otherwise("whitespace_only").alias("method"))
