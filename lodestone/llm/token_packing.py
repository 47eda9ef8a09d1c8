"""Token ids and best-fit-decreasing packing into fixed-length rows."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that the vocabulary's texts are split by before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
#: Fixed value: Unicode's white space, in runs too long for the pattern.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
SCHEMA = "pack_id string, doc_ids array<long>, parts array<int>, cu_seqlens array<int>, n_tokens int, ids binary, positions binary"


class CapacityTree:
    """A segment tree over the capacities 0..most: which bins have so much room, and the least room that is enough."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room that holds `need`, and that room; the bin leaves the tree."""
        at, count = need + self.size, self.count
        while not count[at]:
            while at & 1:  # a right child: nothing larger below this parent
                at >>= 1
                if not at:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at + (not count[2 * at])
        room = at - self.size
        self._add(room, -1)
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: from the longest piece down, each goes where the least room is left over; ties by index."""
    tree, bins = CapacityTree(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if (got := tree.take(need)) is None:
            bins.append([])
            got = (len(bins) - 1, capacity)
        which, room = got
        bins[which].append(i)
        if room > need:
            tree.put(room - need, which)
    return bins


def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def encode(encoding, text: str) -> list[np.ndarray]:
    """The ids of a text, in parts. A long run of white space goes to the merges as the one piece that the pattern makes of it (all but its last
    character if a word follows), since the pattern itself can't take it: its look-ahead stacks a step for each character."""
    out, at = [], 0
    for run in LONG_BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out.append(encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()))
        out.append(np.array(encoding._encode_single_piece(text[run.start() : end]), np.uint32))
        at = end
    return [*out, encoding.encode_to_numpy(text[at:], disallowed_special=())]


def pack_tokens(docs: DataFrame, length: int = 2048, vocabulary: str = VOCABULARY, end: int | None = END, block: int = 2_000_000) -> DataFrame:
    """Packed rows of `length` token ids: (pack_id, doc_ids, parts, cu_seqlens, n_tokens, ids, positions).

    ids and positions are little-endian uint16 rows of `length` (uint32 where the vocabulary or length needs
    it), filled with `end` (or 0) and 0 after n_tokens. cu_seqlens are the segments' bounds, from 0 to n_tokens; positions
    start at 0 with each segment. A segment is part k of its document: its tokens from k * length on; documents
    longer than a row are cut there and nowhere else, so the parts in order are the document.

    Tokenizing and packing happen in one narrow stage: each task packs the pieces of about `block` tokens
    together, best fit decreasing, so memory is bounded by `block` and the longest text, and nothing is shuffled.

    docs: (doc_id, text). A null text counts as empty; an empty text is the end token alone (without one it has
    no segment). A null doc_id stays null. Repeated rows are packed each. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        ranks = _ranks(held.value)
        encoding = tiktoken.Encoding("lodestone", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        kind = np.dtype("<u2") if max(len(ranks), end or 0, length) < 1 << 16 else np.dtype("<u4")
        tail = np.array([] if end is None else [end], kind)
        pieces: list[np.ndarray] = []
        names: list[tuple] = []
        task, made, waiting = TaskContext.get().partitionId(), 0, 0

        def packed() -> pa.RecordBatch:
            nonlocal made
            rows = []
            for group in best_fit_decreasing(np.array([len(p) for p in pieces]), length):
                bounds = np.concatenate([[0], np.cumsum([len(pieces[i]) for i in group])])
                ids, positions = np.full(length, end or 0, kind), np.zeros(length, kind)
                ids[: bounds[-1]] = np.concatenate([pieces[i] for i in group])
                positions[: bounds[-1]] = np.concatenate([np.arange(len(pieces[i])) for i in group])
                rows.append({"pack_id": f"{task}-{made}", "doc_ids": [names[i][0] for i in group], "parts": [names[i][1] for i in group], "cu_seqlens": bounds.tolist(), "n_tokens": int(bounds[-1]), "ids": ids.tobytes(), "positions": positions.tobytes()})
                made += 1
            pieces.clear()
            names.clear()
            return pa.RecordBatch.from_pylist(rows, OUT)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([*[x.astype(kind) for x in encode(encoding, text or "")], tail])
                for k in range(0, len(ids), length):
                    pieces.append(ids[k : k + length])
                    names.append((doc_id, k // length))
                waiting += len(ids)
                if waiting >= block:
                    yield packed()
                    waiting = 0
        if pieces:
            yield packed()

    OUT = pa.schema([("pack_id", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary())])
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet: ids and positions are columns of fixed-size binary rows, ready to be mapped as matrices."""
    packed.write.parquet(path)
