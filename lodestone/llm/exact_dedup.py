"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, only, scratch, stored, texts_of

#: Bytes: a cut is made where the rolling hash says so, at least MIN and at most MAX after the last one.
MIN_CHUNK, MAX_CHUNK, MASK = 512, 16384, np.uint32((1 << 11) - 1)
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(text: bytes) -> list[int]:
    """The ends of the content-defined chunks: a gear hash of the last 32 bytes selects them, so equal runs are cut alike wherever they stand."""
    n = len(text)
    if n <= MIN_CHUNK:
        return [n] if n else []
    rolling = _GEAR[np.frombuffer(text, np.uint8)]
    for shift in (1, 2, 4, 8, 16):
        rolling[shift:] = rolling[shift:] + (rolling[:-shift] << np.uint32(shift))
    ends, last = [], 0
    for at in (np.flatnonzero((rolling >> np.uint32(16)) & MASK == 0) + 1).tolist():
        while at - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if at - last >= MIN_CHUNK:
            ends.append(last := at)
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    return ends if last == n else [*ends, n]


def _chunker(seed: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, chunks, recipes, shas = [], [], [], []
            for text in texts_of(batch):
                text, last, recipe = text.lower(), 0, []
                for end in cut_points(text):
                    chunk = text[last:end]
                    last = end
                    key = xxhash.xxh3_128_digest(chunk, seed=seed)
                    if with_bytes:
                        keys.append(key)
                        chunks.append(chunk)
                    else:
                        recipe.append(key)
                if not with_bytes:
                    recipes.append(b"".join(recipe))
                    shas.append(hashlib.sha256(text).hexdigest())
            if with_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(chunks, pa.binary())], ["chunk_key", "chunk"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(recipes, pa.binary()), pa.array(shas, pa.string())], ["doc_id", "recipe", "text_sha256"])

    return run


def chunk_store(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(chunk_key, chunk): each distinct chunk once. Copies meet in the map-side aggregate, so a hot chunk moves once per task."""
    return docs.select("text").mapInArrow(_chunker(seed, True), "chunk_key binary, chunk binary").distinct()


def verified_seed(docs: DataFrame, seeds: int = 4) -> int:
    """The first seed under which no two different chunks share an identifier: it compares the bytes of all chunks."""
    for seed in range(seeds):
        if chunk_store(docs, seed).groupBy("chunk_key").count().where("count > 1").isEmpty():
            return seed
    raise RuntimeError(f"chunks collide under each of {seeds} seeds")


def chunk_recipes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, recipe, text_sha256): the ordered identifiers of the document's chunks, 16 bytes each, end to end."""
    return docs.select("doc_id", "text").mapInArrow(_chunker(seed, False), "doc_id long, recipe binary, text_sha256 string")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chunks), a row for each row of docs (doc_id, text).

    Texts are equal when they are identical after lower-casing A-Z; of equal texts the largest doc_id stays.
    Chunks are deduplicated first and their identifiers verified against the bytes; then only the ordered
    identifier lists (about 1 % of the text) are grouped and joined.

    Null texts count as empty; empty texts have an empty recipe and equal each other. A null doc_id never stays
    unless all of its group are null, when keep_id is null and none is kept. Rows that repeat a doc_id and its
    text count in group_size and are marked alike. Other columns are not read. An empty table gives no rows.
    """
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(docs.sparkSession):
        recipes = stored(chunk_recipes(docs, verified_seed(docs)), "recipes")
        groups = stored(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "recipe-groups")
        out = recipes.join(groups, "recipe").select(
            "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256", (F.length("recipe") / 16).cast("int").alias("n_chunks")
        )
        return kept(out, "exact-groups")
