"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, only, stored, window_hashes, word_hashes

MASK = (1 << 64) - 1

_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
HITS = "array<struct<item_id: bigint, coverage: double, n_tiles: int>>"


def plain_words(text: bytes) -> np.ndarray:
    """The hashes of the words, A-Z lower-cased, ASCII punctuation dropped: moved passages often lose or gain it."""
    return word_hashes(text.lower().translate(_SPACED).split())


def _runs(at: np.ndarray) -> np.ndarray:
    """For each of the sorted places how many follow each other from it on, itself included."""
    if not len(at):
        return at
    ends = np.append(np.flatnonzero(np.diff(at) != 1), len(at) - 1)
    return ends[np.searchsorted(ends, np.arange(len(at)))] - np.arange(len(at)) + 1


BASE = 0xD6E8FEB86659FD93


def rolled(words: np.ndarray) -> np.ndarray:
    """Rolling sums: sums[i + n] - sums[i] * BASE^n is the hash of n words from i on, modulo 2^64."""
    out, total = [0], 0
    for w in words.tolist():
        total = (total * BASE + w) & MASK
        out.append(total)
    return np.array(out, U64)


def greedy_tiles(doc: np.ndarray, item: np.ndarray, seed: int, doc_at: np.ndarray | None = None, item_at: np.ndarray | None = None, doc_sums: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (doc start, item start, words): the longest run of equal words that are unmarked on both sides is marked, again and again,
    down to `seed` words. Ties: the earliest in the document, then in the item.

    Running Karp-Rabin: for each length from the longest possible one down, the rolling hashes of the item's unmarked windows are
    looked up for those of the document, and what matches is compared word by word before it is marked. doc_at, item_at: where windows of `seed` words
    start that the other side has too (all, if not given), sorted. Work for one length follows the number of these, however often words repeat.
    """
    every = lambda words: np.arange(max(0, len(words) - seed + 1))
    d_sums, t_sums = rolled(doc) if doc_sums is None else doc_sums, rolled(item)
    d_at, t_at = every(doc) if doc_at is None else doc_at, every(item) if item_at is None else item_at
    d_used, t_used = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles = []
    size = min(int(_runs(d_at).max(initial=0)), int(_runs(t_at).max(initial=0))) + seed - 1
    while size >= seed:
        d, t = (at[_runs(at) > size - seed] for at in (d_at, t_at))
        if not len(d) or not len(t):
            size -= 1
            continue
        power = U64(pow(BASE, size, MASK + 1))
        d_hash, t_hash = (sums[at + size] - sums[at] * power for sums, at in ((d_sums, d), (t_sums, t)))
        order = np.argsort(t_hash, kind="stable")
        sorted_, marked = t_hash[order], False
        low, high = np.searchsorted(sorted_, d_hash, "left"), np.searchsorted(sorted_, d_hash, "right")
        free = {int(x): int(x) for x in np.unique(low[high > low])}  # of each hash the first place in the item that may be unmarked
        for i in np.flatnonzero(high > low).tolist():
            a = int(d[i])
            if d_used[a] or d_used[a + size - 1]:  # marks are made in whole tiles of this size or more, so the ends tell
                continue
            k = free[int(low[i])]
            while k < high[i]:
                b = int(t[order[k]])
                if t_used[b] or t_used[b + size - 1]:
                    k += 1  # stays marked, so it is passed for good
                    if free[int(low[i])] == k - 1:
                        free[int(low[i])] = k
                elif (doc[a : a + size] == item[b : b + size]).all():
                    d_used[a : a + size] = t_used[b : b + size] = marked = True
                    tiles.append((a, b, size))
                    break
                else:
                    k += 1
        if marked:
            whole = lambda at, used: at[np.convolve(used, np.ones(seed, np.int64))[seed - 1 : len(used)][at] == 0]  # noqa: E731  windows without a mark
            d_at, t_at = whole(d_at, d_used), whole(t_at, t_used)
        size = min(size - 1, min(int(_runs(d_at).max(initial=0)), int(_runs(t_at).max(initial=0))) + seed - 1)
    return tiles


class Items:
    """A block of benchmark items with an index of their windows of `seed` words."""

    def __init__(self, rows: list[tuple[int, str]], seed: int) -> None:
        self.seed, self.ids, self.words = seed, [r[0] for r in rows], [plain_words((r[1] or "").encode()) for r in rows]
        windows = [window_hashes(w, seed) for w in self.words]
        keys = np.concatenate([np.empty(0, np.uint64), *windows])
        owner = np.repeat(np.arange(len(rows)), [len(w) for w in windows])
        place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(w)) for w in windows]])
        order = np.lexsort((owner, keys))
        self.keys, first = np.unique(keys[order], return_index=True)
        self.bounds, self.owner, self.place = np.append(first, len(keys)), owner[order], place[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.short = [i for i, w in enumerate(self.words) if 0 < len(w) < seed]

    def hits(self, text: bytes, least: float) -> list[tuple[int, float, int]]:
        """(item_id, covered share of the item's words, tiles) of the items covered by at least `least`."""
        words = plain_words(text)
        found = []
        for i in self.short:  # too short for a window: the whole item must occur
            w = self.words[i]
            if (window_hashes(words, len(w)) == window_hashes(w, len(w))[0]).any():
                found.append((self.ids[i], 1.0, 1))
        windows = window_hashes(words, self.seed)
        at = np.flatnonzero(self.maybe[(windows & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(at) and len(self.keys):
            key = np.searchsorted(self.keys, windows[at])
            there = self.keys[np.minimum(key, len(self.keys) - 1)] == windows[at]
            at, key = at[there], key[there]
            seen = np.unique(key)  # each window that repeats is looked up once
            n = self.bounds[seen + 1] - self.bounds[seen]
            which = np.repeat(self.bounds[seen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            by = np.argsort(self.owner[which], kind="stable")
            owner, place, of = self.owner[which][by], self.place[which][by], np.repeat(seen, n)[by]
            sums = None
            for i in np.unique(owner).tolist():
                mine, size = slice(*np.searchsorted(owner, [i, i + 1])), len(self.words[i])
                covered = np.unique(place[mine][:, None] + np.arange(self.seed)).size  # no tiling covers more
                if covered < least * size:
                    continue
                sums = rolled(words) if sums is None else sums
                tiles = greedy_tiles(words, self.words[i], self.seed, at[np.isin(key, of[mine])], np.sort(place[mine]), sums)
                share = sum(t[2] for t in tiles) / size
                if share >= least:
                    found.append((self.ids[i], share, len(tiles)))
        return sorted(found)


def _hits_column(held, least: float, text: str) -> Column:
    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        out = [[{"item_id": i, "coverage": c, "n_tiles": n} for i, c, n in held.value.hits(t or b"", least)] for t in texts.cast(pa.binary()).to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32())])))

    return hits(F.col(text))


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str = "hits", least: float = 0.5, seed: int = 4, block_bytes: int = 16_000_000, text: str = "text") -> DataFrame:
    """docs with a column of the benchmark items that `text` covers by at least `least`, as an array of (item_id, coverage, n_tiles).

    The benchmark is the query set: it is taken in blocks of about block_bytes of text. Each block is broadcast for a pass of its own,
    whose result is stored before the next one, so what the driver and a task hold is bounded whatever its size; one block needs no storing.
    """
    benchmark = only(benchmark, "item_id", "text")
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, spark = int(total // block_bytes) + 1, benchmark.sparkSession
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = docs
    for k in range(blocks):
        rows = sorted((r.item_id, r.text) for r in benchmark.where(part == k).where("item_id is not null and text is not null").select("item_id", "text").distinct().collect())
        found = _hits_column(spark.sparkContext.broadcast(Items(rows, seed)), least, text)
        out = out.withColumn(name, F.concat(name, found) if k else found)
        if k < blocks - 1:
            out = stored(out, "hits")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, contaminated, item_ids, coverage, n_tiles), a row for each row of docs (doc_id, text).

    benchmark: (item_id, text). A document is contaminated when tiles of at least `seed` words cover at least
    `least` of the words of some item, in any order; coverage and n_tiles are those of the most covered item.

    Null texts count as empty and are clean; items without id or text, or with no words, match nothing; items
    with fewer words than `seed` must occur whole; an item that repeats is named once; a null doc_id stays null;
    repeated rows are judged each; other columns are not read; an empty table gives no rows.
    """
    found = with_hits(only(docs, "doc_id", "text"), benchmark, **options)
    best = F.array_max(F.transform("hits", lambda h: F.struct(h.coverage, (-h.n_tiles).alias("fewer"))))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.array_distinct(F.transform("hits", lambda h: h.item_id)).alias("item_ids"), F.coalesce(best.coverage, F.lit(0.0)).alias("coverage"), F.coalesce(-best.fewer, F.lit(0)).alias("n_tiles"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs (text, and any other columns) that cover no benchmark item, with all their columns. Null and empty texts stay; repeated
    rows are judged each; an empty table gives no rows; an empty benchmark drops nothing."""
    placed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = with_hits(placed, benchmark, text=f"c{docs.columns.index('text')}", **options)
    return found.where(F.size("hits") == 0).drop("hits").toDF(*docs.columns)
