"""A corpus pipeline of five stages; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import discard, kept, scratch
from lodestone.llm.decontamination import drop_contaminated
from lodestone.llm.jaccard_join import keep_one_of_class
from lodestone.llm.length_buckets import length_buckets
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine scores as toxic go. Null and empty texts are judged by the bias alone; repeated rows are judged alike; an empty table stays empty."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly so, leave their texts; n_chars follows the text. Null texts and rows without a doc_id stay as they are; rows that share a doc_id lose the same lines."""
    return dedup_lines(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest doc_id. Texts without words and rows without a doc_id stay."""
    return keep_one_of_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go. Null and empty texts stay; each of repeated rows is judged."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its length bucket and batch; null and empty texts have length 0, repeated rows a place each."""
    return length_buckets(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("packing", packing)]
#: SQL can't express the trained machine; tests/llm/test_pipeline.py compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents. What a stage stores goes when its output stands, and that when the next stage's does; the last output stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
