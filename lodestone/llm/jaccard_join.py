"""N-gram Jaccard join by PartEnum signatures, exact, with classes instead of all pairs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, components, discard, kept, mixed, scratch, shingles, signed, stored, texts_of

#: Similarity 0.8: |x & y| >= 0.8 |x | y| is |x ^ y| <= (|x| + |y|) / 9, and sizes differ by a quarter at most.
SHARE = 9
#: Columns of 64 parity bits each.
PARITY = [f"p{i}" for i in range(16)]


@dataclass(frozen=True)
class Window2:
    """Two neighbouring size bands [low, mid) and [mid, high): n1 partitions of the domain, each of n2 parts."""

    low: int
    mid: int
    high: int
    n1: int
    n2: int
    drop: int  # how many of its emptiest partitions each set leaves out


def bands(most: int) -> list[int]:
    """Lower bounds of size bands such that a size and any size up to a quarter larger are in one band or in neighbours."""
    out = [1, 2]
    while out[-2] <= most:
        out.append(max(out[-1] + 1, 5 * (out[-1] - 1) // 4 + 1))
    return out


def differing(sizes: np.ndarray, window: Window2, upper: bool) -> np.ndarray:
    """For each size the largest symmetric difference from a set it must meet in this window: as a member of the
    lower band any set of the window, as one of the upper band those of the lower band."""
    other = np.full(len(sizes), window.mid - 1) if upper else np.minimum(5 * sizes // 4, window.high - 1)
    return (sizes + other) // SHARE


def windows(most: int) -> list[Window2]:
    out, edge = [], bands(most)
    for low, mid, high in zip(edge, edge[1:], edge[2:], strict=False):
        bare = Window2(low, mid, high, 1, 1, 0)
        k = max(int(differing(np.array([mid - 1]), bare, False)[0]), int(differing(np.array([high - 1]), bare, True)[0]))
        n1 = k // 2 + 1
        drop = -(-n1 // 12) if n1 >= 8 else 0
        out.append(Window2(low, mid, high, n1 + 2 * drop, 1 if k == 0 else 5 if n1 <= 2 else 4 if n1 <= 6 else 3, drop))
    return out


def _signatures(sets: list[np.ndarray], window: Window2, number: int, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of sets of one band.

    Of the first k // 2 + 1 + 2 * drop partitions of two sets that differ in at most k elements, more than
    2 * drop differ in at most one element. Each set leaves out `drop` of its emptiest partitions, so one of
    them is in both. There the differing element is in one part; leaving that part out, the rest is equal.
    """
    sizes = np.array([len(s) for s in sets])
    use = differing(sizes, window, upper) // 2 + 1 + 2 * window.drop
    h, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    part = ((h >> U64(32)) * U64(window.n1)) >> U64(32)
    sub = ((h & U64(0xFFFFFFFF)) * U64(window.n2)) >> U64(32)
    cell = (who * window.n1 + part.astype(np.int64)) * window.n2 + sub.astype(np.int64)
    sums = np.zeros(len(sets) * window.n1 * window.n2, U64)
    np.add.at(sums, cell, mixed(h))
    sums = sums.reshape(len(sets), window.n1, window.n2)
    counts = np.bincount(cell // window.n2, minlength=len(sets) * window.n1).reshape(len(sets), window.n1)
    keep = np.arange(window.n1) < use[:, None]
    if window.drop:
        order = np.argsort(np.where(keep, counts, 1 << 40), axis=1, kind="stable")[:, : window.drop]
        np.put_along_axis(keep, order, False, axis=1)
    whole = sums.sum(axis=2, dtype=U64)[:, :, None]
    rest = whole - sums if window.n2 > 1 else whole
    name = (np.arange(window.n1)[:, None] * window.n2 + np.arange(window.n2)).astype(U64) + U64((number + 1) << 40)
    out = mixed(rest + mixed(name)[None])
    return out[keep].ravel(), np.repeat(np.nonzero(keep)[0], window.n2)


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, a, b): each signature once for a block of documents with b null, and for its other documents there b, the first one."""

    def block(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        most = max(map(len, sets))  # an edge depends only on those before it, so the blocks' bands agree
        plan, edge = windows(most), np.array(bands(most))
        band = np.searchsorted(edge, [len(s) for s in sets], "right") - 1
        sigs, docs = [np.empty(0, U64)], [np.empty(0, np.int64)]
        for b in np.unique(band).tolist():
            at = np.flatnonzero(band == b)
            mine = [sets[i] for i in at]
            for number, upper in ((b, False), (b - 1, True)):
                if number >= 0:
                    s, i = _signatures(mine, plan[number], number, upper)
                    sigs.append(s)
                    docs.append(at[i])
        sig, doc = np.concatenate(sigs), np.array(ids, np.int64)[np.concatenate(docs)]
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        first = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.empty(0, bool)
        pivot = doc[first][np.cumsum(first) - 1] if len(sig) else doc
        new = first | (doc != pivot)
        return pa.RecordBatch.from_arrays([pa.array(signed(sig[new])), pa.array(doc[new]), pa.array(pivot[new], mask=first[new])], ["sig", "a", "b"])

    ids, sets, held, seen = [], [], 0, set()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            s = shingles(text)
            key = xxhash.xxh3_128_digest(s.tobytes())
            if doc_id is None or not len(s) or key in seen:  # equal sets are one class already
                continue
            seen.add(key)
            ids.append(doc_id)
            sets.append(s)
            held += len(s)
            if held > 1_000_000:
                yield block(ids, sets)
                ids, sets, held, seen = [], [], 0, set()
    if sets:
        yield block(ids, sets)


def _parity(s: np.ndarray) -> np.ndarray:
    """64 * len(PARITY) bits, bit i the parity of the elements that fall on i: two sets differ in at least as many elements as bits."""
    bits = np.bincount((s & U64(64 * len(PARITY) - 1)).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _long_parity(s: np.ndarray) -> bytes | None:
    """The same of at least 2 * len(s) bits, a power of two, for sets too large for PARITY to tell apart; else None."""
    if 2 * len(s) <= 64 * len(PARITY):
        return None
    size = 1 << (2 * len(s) - 1).bit_length()
    return np.packbits((np.bincount((s & U64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def _member_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t) for t in texts_of(batch)]
        parity = np.array([_parity(s) for s in sets]).reshape(len(sets), len(PARITY))
        columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())]
        columns.append(pa.array([_long_parity(s) for s in sets], pa.binary()))
        yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, parity.T)], ["doc_id", "n_shingles", "set_key", "bits", *PARITY])


def _may_link(u: str, v: str) -> Column:
    """Sizes and parities of u and v allow the similarity; prefixes of the columns' names."""
    nu, nv = F.col(f"{u}n"), F.col(f"{v}n")
    differ = sum((F.bit_count(F.col(f"{u}{p}").bitwiseXOR(F.col(f"{v}{p}"))) for p in PARITY[1:]), F.bit_count(F.col(f"{u}{PARITY[0]}").bitwiseXOR(F.col(f"{v}{PARITY[0]}"))))
    return (4 * F.greatest(nu, nv) <= 5 * F.least(nu, nv)) & (SHARE * differ <= nu + nv)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose long parities allow the similarity, or of which one set has none; a longer parity folds onto a shorter one."""
    for batch in batches:
        keep = []
        for nu, nv, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
            if x is not None and y is not None:
                x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
                differ = int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())
            keep.append(x is None or y is None or SHARE * differ <= nu + nv)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in texts_of(batch)], pa.binary())], ["id", "elements"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _with(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (u, v) with the table's columns of either side: u_x, v_x."""
    for side in "uv":
        pairs = pairs.join(table.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return pairs.select("u", "v", *[f"{s}_{c}" for c in columns for s in "uv"])


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose sets, made again from the whole texts, reach the similarity."""
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    sets = stored(docs.join(ids, docs.doc_id == ids.id, "left_semi").mapInArrow(_set_rows, "id long, elements binary"), "shingle-sets")
    links = stored(_with(pairs, sets, ["elements"]).mapInArrow(_linked, "u long, v long").distinct(), "links")
    discard(sets)
    return links


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs (doc_id, text).

    A-Z are lower-cased, words are [^\\x20\\x09-\\x0D]+, a set is the distinct 5-word shingles or, of fewer words,
    the whole sequence. Documents link when 100 |x & y| >= 80 |x | y|; component_id is the smallest doc_id that
    links reach. Equal sets are one class and only its smallest doc_id takes part further.

    Documents that share a signature are first compared with the first one that has it, in blocks of documents
    and then among the blocks' first ones, so a large group of copies gives a star and not all pairs. Where a
    signature's documents are then still in several components, all pairs across these are compared: nothing
    that shares a signature is left out, and whatever links shares one. Sizes and parity bits bound the similarity
    as a condition of that join, so pairs that can't link leave no rows; parities of a length that follows the set do
    the same for large sets, before the others' texts are read again.

    Null and empty texts, and texts of white space, have n_shingles 0 and component_id = doc_id. A null doc_id
    links with nothing and has a null component. Rows that repeat a doc_id link as one document when either
    links. Other columns are not read. An empty table gives no rows. Elements are 64-bit hashes.
    """
    with scratch(docs.sparkSession):
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        members = stored(docs.mapInArrow(_member_rows, "doc_id long, n_shingles long, set_key binary, bits binary, " + ", ".join(f"{p} long" for p in PARITY)), "members")
        full = members.where("doc_id is not null and n_shingles > 0")
        classes = stored(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), *[F.first(p).alias(p) for p in PARITY]), "classes")
        reps = stored(full.select("set_key", "doc_id").join(classes.select("set_key", "rep"), "set_key").select(F.col("doc_id").alias("id"), "rep").distinct(), "representatives")
        sets, long = (classes.select(F.col("rep").alias("id"), "n", *columns) for columns in (PARITY, ["bits"]))

        rows = docs.mapInArrow(_signature_rows, "sig long, a long, b long")
        first = F.min("a").over(Window.partitionBy("sig", "b"))  # the blocks' first ones, with b null, meet; pairs of a block only each other
        shared = stored(rows.withColumn("b", F.coalesce("b", first)).where("a <> b"), "shared-signatures")
        named = shared
        for side in "ab":
            named = named.join(reps.select(F.col("id").alias(side), F.col("rep").alias(f"{side}_rep")), side)
        named = stored(named.where("a_rep <> b_rep").select("sig", F.least("a_rep", "b_rep").alias("u"), F.greatest("a_rep", "b_rep").alias("v")).distinct(), "signature-pairs")
        discard(shared)

        stars = _with(named.select("u", "v").distinct(), sets, ["n", *PARITY]).where(_may_link("u_", "v_")).select("u", "v")
        stars = stored(_with(stars, long, ["n", "bits"]).mapInArrow(_near, "u long, v long"), "star-pairs")
        one = stars.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
        links = _verified(one, docs)
        labels = components(links)
        links = links.union(_verified(_across(stars.join(one, ["u", "v"], "left_anti"), labels), docs))
        labels = components(links)

        inside = named.select("sig", F.col("u").alias("id")).union(named.select("sig", "v")).distinct().join(labels, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component"))
        inside = stored(inside, "signature-members")
        several = inside.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("sig")
        rest = stored(inside.join(several, "sig", "left_semi"), "open-signatures").join(sets, "id")
        u, v = rest.alias("u"), rest.alias("v")
        pairs = u.join(v, F.expr("u.sig = v.sig AND u.id < v.id AND u.component <> v.component") & _may_link("u.", "v."))
        pairs = pairs.select(F.col("u.id").alias("u"), F.col("v.id").alias("v")).distinct().join(stars, ["u", "v"], "left_anti")
        pairs = stored(_with(pairs, long, ["n", "bits"]).mapInArrow(_near, "u long, v long"), "open-pairs")
        if not pairs.isEmpty():
            labels = components(links.union(_verified(pairs, docs)))

        found = members.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "rep"), "set_key", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))).otherwise(F.col("doc_id"))
        return kept(found.select("doc_id", "n_shingles", component.alias("component_id")), "jaccard-classes")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    for side in "uv":
        pairs = pairs.join(labels.select(F.col("id").alias(side), F.col("component").alias(f"{side}_component")), side, "left")
    return stored(pairs.where(F.coalesce("u_component", "u") != F.coalesce("v_component", "v")).select("u", "v"), "open-stars")


def keep_one_of_class(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of the smallest doc_id of each class of jaccard_classes.

    Rows with a null doc_id, empty texts and texts without words stay; rows that repeat a doc_id stay or go together;
    columns of any name are kept. An empty table gives no rows.
    """
    name = f"copy_{uuid.uuid4().hex}"  # no column of docs has it
    away = jaccard_classes(docs).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(away, docs.doc_id == away[name], "left_anti")
