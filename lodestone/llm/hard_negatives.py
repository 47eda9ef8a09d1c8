"""Hard negatives by exact integer inner products, computed as matrix products in a residue number system."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, only, scratch, stored

#: float32 holds whole numbers up to here exactly.
EXACT = 1 << 24
MOST = 1 << 62


def primes(bound: int, below: int = 256) -> list[int]:
    """The largest primes below `below`, as many as it takes for their product to exceed 2 * bound + 1."""
    out, product = [], 1
    for p in range(below - 1, 1, -1):
        if product > 2 * bound + 1:
            return out
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
    raise ValueError(f"no residues below {below} tell scores of {bound} apart")


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo the odd prime p, between -(p - 1) / 2 and (p - 1) / 2, as float32."""
    r = x % p
    return (r - p * (r > p // 2)).astype(np.float32)


def products(a: np.ndarray, b: np.ndarray, moduli: list[int]) -> np.ndarray:
    """a @ b.T for int64 matrices, exact if every entry lies within half the product of the moduli.

    Each modulus has a product of float32 matrices whose sums stay below 2^24, so it is exact; the residues are put
    together by Chinese remaindering in mixed radix: digit k is what is missing modulo p_k, divided by p_1 ... p_(k-1).
    """
    total, radix = np.zeros((len(a), len(b)), np.int64), 1
    for p in moduli:
        width, left, right = EXACT // (p // 2) ** 2, residues(a, p), residues(b, p)
        digit = np.zeros(total.shape, np.int64)
        for at in range(0, a.shape[1], width):
            digit += (left[:, at : at + width] @ right[:, at : at + width].T).astype(np.int64)
        digit = (digit - total) % p * pow(radix, -1, p) % p
        # digits around zero, so the sum is the representative around zero
        digit -= p * (digit > p // 2)
        total += digit * radix
        radix *= p
    return total


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of `width`; shorter lists are filled with zeros."""
    lists = column.to_pylist() if any(n != width for n in np.diff(column.offsets.to_numpy())) else None
    if lists is None:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = x
    return out


def _grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, block: int, slice_rows: int, run, schema: str) -> DataFrame:
    """run(anchors, rows) for each block of anchors and slice of rows; every anchor meets every row once, in tasks of bounded size."""
    blocks, slices = -(-n_anchors // block) or 1, -(-n_rows // slice_rows) or 1
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(n)).cast("int")
    left = anchors.withColumns({"block": deal(blocks), "slice": F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))})
    right = rows.withColumns({"slice": deal(slices), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(run, schema)


def _scored(left: pa.Table, right: pa.Table, width: int, moduli: list[int], step: int = 128) -> Iterator[tuple[int, np.ndarray]]:
    """(number of an anchor, its scores with all rows)."""
    a, b = (_matrix(t["x"].combine_chunks(), width) for t in (left, right))
    for at in range(0, len(a), step):
        yield from enumerate(products(a[at : at + step], b, moduli), at)


def _first(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Of the indices `among`, the k with the highest scores, ties by index."""
    s = scores[among]
    if len(s) > k:
        few = s >= np.partition(s, len(s) - k)[len(s) - k]
        among, s = among[few], s[few]
    return among[np.argsort(-s, kind="stable")[:k]]


def _ranked(rows: DataFrame, by: list[str], kind: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(f"{kind}_score"), f"{kind}_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = 4096, slice_rows: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of hard negatives.

    vectors: (vec_id long, label, x array<long>). A score is the inner product; higher scores come first, ties by
    smaller vec_id. Anchors are the rows where the condition `anchors` holds. Each has as positives the first so many
    other rows of its label, and for each of these the first so many rows of another label whose score is at least
    low % and at most high % of the positive's.

    Every anchor is scored with every row, twice: for the positives, then for the windows that these open. Blocks of
    anchors meet slices of rows, so a task holds some `block` anchors and `slice_rows` rows; each pair of them gives its
    first rows only, and windows over these select. Nothing is broadcast or collected but the number of rows and the largest norms.

    Rows with a null vec_id, label or x, or a null in x, take no part. Rows that repeat another one count once. A row
    never meets rows of its own vec_id; rows that share a vec_id and differ are scored each, and a result names it by
    their best score. In vectors of unlike length missing components are 0. No anchor, no positive or no row in the
    window gives no row of the result. Scores must fit in 63 bits: where the largest norms allow more, it is an OverflowError.
    """
    with scratch(vectors.sparkSession):
        whole = only(vectors, "vec_id", "label", "x").where("vec_id is not null AND label is not null AND x is not null AND NOT exists(x, c -> c is null)")
        rows = stored(whole.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("x").cast("array<long>").alias("x")).distinct(), "mining-rows")
        norm = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
        is_anchor = F.coalesce(anchors, F.lit(False))
        n, m, norms, anchor_norms, width = rows.agg(F.count("*"), F.count_if(is_anchor), F.max(norm), F.max(F.when(is_anchor, norm)), F.max(F.size("x"))).first()
        bound = ((norms or 0) * (anchor_norms or 0)) ** 0.5 * (1 + 1e-9)
        if max(bound, (norms or 0) ** 0.5) >= MOST:
            raise OverflowError(f"scores up to {bound:.3g} don't fit in 63 bits")
        moduli, width = primes(int(bound) + 1), max(1, width or 0)
        held = stored(rows.where(is_anchor), "anchors")

        def same(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by("vec_id")
            ids, labels = right["vec_id"].to_numpy(), right["label"].to_numpy()
            own, mine_ = left["label"].to_numpy(), left["vec_id"].to_numpy()
            out = [(mine_[i], own[i], ids[j], s[j]) for i, s in _scored(left, right, width, moduli) for j in _first(s, np.flatnonzero((labels == own[i]) & (ids != mine_[i])), positives)]
            return pa.table(dict(zip(("anchor_id", "label", "positive_id", "positive_score"), zip(*out, strict=True) if out else [[]] * 4, strict=True)), schema=pa.schema([("anchor_id", pa.int64()), ("label", left.schema.field("label").type), ("positive_id", pa.int64()), ("positive_score", pa.int64())]))

        label = rows.schema["label"].dataType.simpleString()
        near = _grid(held, rows, m, n, block, slice_rows, same, f"anchor_id long, label {label}, positive_id long, positive_score long")
        near = near.groupBy("anchor_id", "label", "positive_id").agg(F.max("positive_score").alias("positive_score"))
        best = _ranked(near, ["anchor_id", "label"], "positive", positives).groupBy("anchor_id", "label").agg(F.collect_list(F.struct("positive_score", "positive_id")).alias("p"))  # so many at most
        windows = best.select(F.col("anchor_id").alias("vec_id"), "label", F.col("p.positive_score").alias("scores"), F.col("p.positive_id").alias("positive_ids"))
        windows = stored(held.join(windows, ["vec_id", "label"]), "mining-windows")

        def others(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by("vec_id")
            ids, labels = right["vec_id"].to_numpy(), right["label"].to_numpy()
            own, mine_, tops, names = (left[c].to_pylist() for c in ("label", "vec_id", "scores", "positive_ids"))
            out = []
            for i, s in _scored(left, right, width, moduli):
                # low * top <= 100 * score <= high * top, in whole numbers
                bounds = [(-(-low * top // 100), high * top // 100) for top in tops[i]]
                fits = np.flatnonzero((labels != own[i]) & (ids != mine_[i]) & (s >= min(x for x, _ in bounds)) & (s <= max(x for _, x in bounds)))
                for (least, most), top, name in zip(bounds, tops[i], names[i], strict=True):
                    out += [(mine_[i], name, top, ids[j], s[j]) for j in _first(s, fits[(s[fits] >= least) & (s[fits] <= most)], negatives)]
            columns = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
            return pa.table(dict(zip(columns, zip(*out, strict=True) if out else [[]] * 5, strict=True)), schema=pa.schema([(c, pa.int64()) for c in columns]))

        found = _grid(windows, rows, m, n, block, slice_rows, others, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        found = found.groupBy("anchor_id", "positive_id", "negative_id").agg(F.max("positive_score").alias("positive_score"), F.max("negative_score").alias("negative_score"))
        ranked = _ranked(found, ["anchor_id", "positive_id"], "negative", negatives)
        return kept(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """embeddings (vec_id, embedding, label) as (vec_id, label, x): components floor(scale * x). Rows with a null label or
    vector, or a null or non-finite component, are left out; so are components beyond 2^62 (an OverflowError says so)."""
    finite = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return only(embeddings, "vec_id", "label", "embedding").where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite).select("vec_id", "label", x.alias("x"))
