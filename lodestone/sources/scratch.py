"""Tables in the folder that driver and executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

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


def kept(df: DataFrame, label: str) -> DataFrame:
    """Like stored(), for what an operator returns: it lasts as long as the scratch() around the innermost one, or else stays."""
    out, path = _write(df, label, {})
    scopes = _open.__dict__.get("scopes", [])
    if len(scopes) > 1:
        scopes[-2].append(path)
    return out
