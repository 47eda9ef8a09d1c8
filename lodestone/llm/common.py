"""What the training-data operators share: word hashing, shared storage, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import closure

U64 = np.uint64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_own_dir: dict[str, str] = {}
_open = threading.local()
#: Lets Spark delete an execution's shuffle files at its end instead of when the driver happens to collect garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local session gets a
    temporary one; a cluster has no folder that could stand in for it, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = _own_dir.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="lodestone-"))
    return where.rstrip("/")


def _write(df: DataFrame, label: str, options: dict[str, str]) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    was = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if was is None else spark.conf.set(SHUFFLES_GO, was)
    return spark.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes inside are deleted at its end. What outlives it is written by kept()."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        drop(spark, scopes.pop())


def drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors. Inside scratch() it lasts as long as that."""
    out, path = _write(df, label, options)
    scopes = _open.__dict__.get("scopes")
    if scopes:
        scopes[-1].append(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what stored() returned as df; nothing may read it afterwards."""
    drop(df.sparkSession, [df.stored_at])


def checkpointed(df: DataFrame) -> DataFrame:
    """Like stored(), by a reliable checkpoint in the shared folder: rows stay in Spark's own form, which long arrays of numbers are written and read faster in."""
    spark = df.sparkSession
    path, context = f"{shared_dir(spark)}/checkpoint-{uuid.uuid4().hex}", spark.sparkContext
    before = context.getCheckpointDir()
    context.setCheckpointDir(path)
    try:
        out = df.checkpoint()
    finally:
        context.setCheckpointDir(before.rsplit("/", 1)[0] if before else shared_dir(spark))
    scopes = _open.__dict__.get("scopes")
    if scopes:
        scopes[-1].append(path)
    return out


def kept(df: DataFrame, label: str) -> DataFrame:
    """Like stored(), for what an operator returns: it lasts as long as the scratch() around the innermost one, or else stays."""
    out, path = _write(df, label, {})
    scopes = _open.__dict__.get("scopes", [])
    if len(scopes) > 1:
        scopes[-2].append(path)
    out.stored_at = path
    return out


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever others are called (`Text` beside `text`, `a.b`)."""
    placed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return placed.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, _UPPER, _UPPER.lower())


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Words are runs of bytes other than space and \\x09-\\x0D; A-Z are lower-cased."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of so many words, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, U64(size))
    for i in range(size):
        out = out * U64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mixed(out)


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of fewer words the whole sequence is one; none without words."""
    words = word_hashes(words_of(text))
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(size, len(words))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, component) for the ids of edges (u, v): the smallest id that is reachable.

    Each round takes the smallest label among the neighbours and then the label of that label, so long
    chains often halve. Rounds are written to the shared folder. Joins on hot labels are left to AQE, which splits them. What
    hasn't settled after `rounds`, such as long chains of ids in no order, is left to closure(), whose rounds halve any graph.
    """
    both = stored(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.v == labels.id).groupBy(both.u.alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        step = stored(step, "step")
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("beyond"))
        labels = stored(step.join(jump, "next", "left").select("id", F.least("next", "beyond").alias("component"), "was"), "labels")
        if labels.where("component <> was").isEmpty():
            return labels.select("id", "component")
        labels = labels.select("id", "component")
    return closure(both, "u", "v").withColumnRenamed("root", "component")
