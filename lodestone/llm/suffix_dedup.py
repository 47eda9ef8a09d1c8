"""Repeated passages by a sparse suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, kept, mixed, only, scratch, signed, stored, texts_of, window_hashes, word_hashes, words_of

#: Words: the least passage; the k-gram that minimisers are chosen by; how many k-grams compete for each.
PASSAGE, GRAM, REACH = 50, 8, 24
#: A passage holds a minimiser within its first REACH k-grams, so at least so many of its words follow from there.
SEED = PASSAGE - REACH + 1
#: How many following suffixes each one is compared with; seeds with more suffixes than these meet by whole windows.
NEAR = 2
#: Words before and after a seed that the windows of PASSAGE words which hold it can reach.
AROUND = PASSAGE - SEED
HELD = 200_000  # windows that a task holds at a time, unless one text has more


def _least(words: np.ndarray) -> np.ndarray:
    """For each run of REACH k-grams the position of the least hash in it, the leftmost of ties."""
    grams = mixed(window_hashes(words, GRAM))
    if len(grams) < REACH:
        return np.empty(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(grams, REACH).argmin(axis=1) + np.arange(len(grams) - REACH + 1)


def minimisers(words: np.ndarray) -> np.ndarray:
    """The positions that have the least k-gram hash of some REACH neighbours, the leftmost of ties: chosen by content alone."""
    return np.unique(_least(words))


def _contexts(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each seed with the AROUND words before and after it, the ends of the text among them."""
    edge = np.full(AROUND, U64(1))
    return window_hashes(np.concatenate([edge, words, edge]), SEED + 2 * AROUND)[at]


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, context, doc_id, pos): each retained suffix with the hash of its first SEED words and that of all words within reach."""
    for batch in batches:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            words = word_hashes(words_of(text))
            if doc_id is None or len(words) < PASSAGE:
                continue
            at, seeds = minimisers(words), window_hashes(words, SEED)
            at = at[at < len(seeds)]
            for column, x in zip(out, (signed(seeds[at]), signed(_contexts(words, at)), np.full(len(at), doc_id, np.int64), at), strict=True):
                column.append(x)
        seed, context, doc, pos = (np.concatenate(x) for x in out)
        yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(context), pa.array(doc), pa.array(pos.astype(np.int32))], ["seed", "context", "doc_id", "pos"])


def _pair_rows(a: np.ndarray, a_pos: np.ndarray, b: np.ndarray, b_pos: np.ndarray) -> pa.RecordBatch:
    """Pairs, that which stands first as a."""
    swap = (a > b) | ((a == b) & (a_pos > b_pos))
    columns = (np.where(swap, b, a), np.where(swap, b_pos, a_pos), np.where(swap, a, b), np.where(swap, a_pos, b_pos))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "a_pos", "b", "b_pos"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition, all pairs of suffixes of the seeds that have NEAR + 1 of them at most. Of the other
    seeds, and of the first and last one, which may go on in other partitions, the pairs of each suffix with the one before it
    of its context; and the first ones of these with no partner, unless their seed has that context only."""

    def whole(columns: list[np.ndarray], edge: bool) -> Iterator[pa.RecordBatch]:
        """Rows of whole seeds; edge: the first or last seed of the partition."""
        seed, context, doc, pos = columns
        fresh = np.concatenate([[True], seed[1:] != seed[:-1]])
        new = fresh | np.concatenate([[True], context[1:] != context[:-1]])
        group, n = np.cumsum(fresh) - 1, len(seed)
        many = np.bincount(group)[group] > NEAR + 1 if not edge else np.ones(n, bool)
        for step in range(1, NEAR + 1):
            at = np.flatnonzero((seed[step:] == seed[:-step]) & ~many[step:])
            yield _pair_rows(doc[at], pos[at], doc[at + step], pos[at + step])
        at = np.flatnonzero(many & ~new)
        yield _pair_rows(doc[at - 1], pos[at - 1], doc[at], pos[at])
        open_ = many & new & (edge | (np.bincount(group, weights=new)[group] > 1))
        none = pa.nulls(int(open_.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(doc[open_]), pa.array(pos[open_]), none.cast(pa.int64()), none.cast(pa.int32())], ["a", "a_pos", "b", "b_pos"])

    held: list[list[np.ndarray]] = []  # rows of the last seed so far
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        turns = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
        if held and held[-1][0][-1] != columns[0][0]:
            turns = np.concatenate([[0], turns])
        if not len(turns):
            held.append(columns)
            continue
        head, last = int(turns[0]), int(turns[-1])
        ended = [np.concatenate(x) for x in zip(*held, [c[:head] for c in columns], strict=True)]
        yield from whole(ended, first)
        first = False
        if last > head:
            yield from whole([c[head:last] for c in columns], False)
        held = [[c[last:] for c in columns]]
    if held:
        yield from whole([np.concatenate(x) for x in zip(*held, strict=True)], True)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, start, b, b_pos): the windows of PASSAGE words whose first minimiser is one of the given positions. For a
    block of documents each window once, where it stands first, with b null; where it stands again (b, b_pos) is the place before.
    Of windows that repeat the same run one after the other only the first is a row."""

    def block() -> pa.RecordBatch:
        key, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((start, doc, key))
        key, doc, start = key[order], doc[order], start[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        again = np.flatnonzero(~new)
        again = again[np.lexsort((start[again], doc[again]))]
        a = again - 1
        if len(again):
            on = (doc[again][1:] == doc[again][:-1]) & (start[again][1:] == start[again][:-1] + 1) & (doc[a][1:] == doc[a][:-1]) & (start[a][1:] == start[a][:-1] + 1)
            keep = np.concatenate([[True], ~on])
            again, a = again[keep], a[keep]
        at, b = np.concatenate([np.flatnonzero(new), again]), np.concatenate([np.zeros(int(new.sum()), np.int64), a])
        none = np.arange(len(at)) < new.sum()
        return pa.RecordBatch.from_arrays([pa.array(signed(key[at])), pa.array(doc[at]), pa.array(start[at].astype(np.int32)), pa.array(doc[b], mask=none), pa.array(start[b].astype(np.int32), mask=none)], ["key", "doc_id", "start", "b", "b_pos"])

    held, n = [], 0
    for batch in batches:
        for doc_id, text, wanted in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2), strict=True):
            words = word_hashes(words_of(text))
            windows = window_hashes(words, PASSAGE)
            start = np.flatnonzero(np.isin(_least(words)[: len(windows)], wanted.values.to_numpy()))
            if len(start):
                held.append((windows[start], np.full(len(start), doc_id, np.int64), start))
                n += len(start)
            if n > HELD:
                yield block()
                held, n = [], 0
    if held:
        yield block()


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, end, later): maximal common runs of at least PASSAGE words on the diagonals of the pairs, in both documents."""
    for batch in batches:
        doc, start, end, later = [], [], [], []
        rows = zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True)
        texts = zip(*[batch.column(i).cast(pa.binary()).to_pylist() for i in (4, 5)], strict=True)
        seen: tuple = ()
        for (a, b, shift, at), (x, y) in zip(rows, texts, strict=True):
            if seen[:2] != (a, b):
                seen = (a, b, word_hashes(words_of(x or b"")), word_hashes(words_of(y or b"")))
            wa, wb = seen[2:]
            low, high = max(0, -shift), min(len(wa), len(wb) - shift)
            if high - low < PASSAGE:
                continue
            equal = np.concatenate([[False], wa[low:high] == wb[low + shift : high + shift], [False]])
            turns = np.flatnonzero(equal[1:] != equal[:-1])
            for s, e in zip(turns[::2] + low, turns[1::2] + low, strict=True):
                if e - s >= PASSAGE and any(s <= p < e for p in at):
                    if a == b and shift == 0:
                        continue
                    doc += [a, b]
                    start += [int(s), int(s) + shift]
                    end += [int(e), int(e) + shift]
                    later += [False, True]
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(later, pa.bool_())], ["doc_id", "start", "end", "later"])


def _united(spans, out):
    """Sorted spans (start, end) with those that touch joined."""
    step = lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)).end >= s.start), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1)).start.alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1)).end, s.end).alias("end"))))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.sort_array(spans), F.array().cast("array<struct<start:int,end:int>>"), step).alias(out)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_repeated, spans, later): for each document with a passage of at least 50 words that stands elsewhere
    too, in it or in another: the words covered, their spans [start, end) in words, and of these the spans that
    repeat what stands before them in the order of documents, then positions.

    A-Z are lower-cased; words are [^\\x20\\x09-\\x0D]+. The retained suffixes are sorted by range over their first 27
    words, a hash of the 23 words on either side too, document and position, so copies of one passage, however many,
    spread over partitions. The suffixes of a seed that has three at most are all compared. Of other seeds, however
    frequent, each suffix is compared with the one before it that has the same words on either side, and the first ones of these
    meet by each 50-word window whose first minimiser is theirs, each window with the place where it stands before. So
    no text is the partner of all copies, and every repeated window is found. Pairs of one diagonal are one row, and their matches
    are extended left and right in the whole texts.

    Null texts count as empty; rows with a null doc_id and texts of fewer than 50 words have no passages and no
    rows; rows that repeat a doc_id are one document, and a passage of it isn't repeated by that. Other columns
    are not read. An empty table gives no rows.
    """
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(docs.sparkSession):
        rows = stored(docs.mapInArrow(_suffix_rows, "seed long, context long, doc_id long, pos int"), "suffixes")
        order = ["seed", "context", "doc_id", "pos"]
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        found = stored(ranged.mapInArrow(_neighbours, "a long, a_pos int, b long, b_pos int"), "suffix-neighbours")
        wanted = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.collect_set("a_pos").alias("wanted"))
        held = docs.join(wanted, docs.doc_id == wanted.id).dropDuplicates(["doc_id"]).select("doc_id", "text", "wanted")
        windows = held.mapInArrow(_window_rows, "key long, doc_id long, start int, b long, b_pos int")
        before = F.lag(F.struct("doc_id", "start")).over(Window.partitionBy("key", "b", "b_pos").orderBy("doc_id", "start"))  # the blocks' first places, with b null, meet
        again = windows.withColumn("before", before).select(F.coalesce("b", "before.doc_id").alias("a"), F.coalesce("b_pos", "before.start").alias("a_pos"), F.col("doc_id").alias("b"), F.col("start").alias("b_pos"))
        pairs = found.where("b IS NOT NULL").unionByName(again.where("a IS NOT NULL"))
        pairs = pairs.where("a <> b OR a_pos <> b_pos").groupBy("a", "b", (F.col("b_pos") - F.col("a_pos")).alias("shift")).agg(F.sort_array(F.collect_set("a_pos")).alias("at"))
        pairs = stored(pairs, "diagonals")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        texts = stored(docs.join(ids, docs.doc_id == ids.id, "left_semi").dropDuplicates(["doc_id"]), "passage-texts")
        both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
        spans = both.select("a", "b", "shift", "at", "a_text", "b_text").mapInArrow(_extended, "doc_id long, start int, end int, later boolean")
        spans = spans.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("all"), F.collect_list(F.when(F.col("later"), F.struct("start", "end"))).alias("copies"))
        spans = spans.select("doc_id", _united(F.col("all"), "spans"), _united(F.col("copies"), "later"))
        return kept(spans.select("doc_id", F.aggregate("spans", F.lit(0), lambda n, s: n + s.end - s.start).alias("n_repeated"), "spans", "later"), "passages")
