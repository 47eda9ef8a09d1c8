"""Toxicity: a factorization machine over hashed terms, fitted on a bounded sample of labelled documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, texts_of

BUCKETS = 1 << 20
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(word: bytes) -> list[int]:
    """The buckets of a word: the word itself and its first 4 and 5 bytes, which catch a stem under any ending."""
    out = [xxhash.xxh3_64_intdigest(word) % BUCKETS]
    out += [xxhash.xxh3_64_intdigest(word[:n], seed=n) % BUCKETS for n in (4, 5) if len(word) >= n]
    return out


def distinct_words(text: bytes) -> set[bytes]:
    return set(text.lower().translate(_SPACED).split())


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of terms of the dot product of their factors)."""

    buckets: np.ndarray  # sorted; a position here is a term's index
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self) -> None:
        self.index = {b: i for i, b in enumerate(self.buckets.tolist())}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("buckets", "bias", "weights", "factors")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def terms(self, text: bytes) -> list[int]:
        found: set[int] = set()
        for word in distinct_words(text):
            got = self.cache.get(word)
            if got is None:
                if len(self.cache) > 500_000:
                    self.cache.clear()
                got = self.cache[word] = tuple(i for b in terms_of(word) if (i := self.index.get(b)) is not None)
            found.update(got)
        return sorted(found)

    def score(self, text: bytes) -> float:
        at = self.terms(text)
        v = self.factors[at]
        total = v.sum(axis=0)
        y = self.bias + self.weights[at].sum() + 0.5 * float(total @ total - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def _chosen(rows: list[np.ndarray], toxic: np.ndarray, most: int, least_df: int = 4, least_g: float = 6.63) -> np.ndarray:
    """The buckets whose presence tells most about the label, by the G statistic (6.63: one chance in a hundred)."""
    flat = np.concatenate([np.empty(0, np.int64), *rows])
    lab = np.repeat(toxic, [len(r) for r in rows])
    n, n1 = len(toxic), toxic.sum()
    df, df1 = np.bincount(flat, minlength=BUCKETS).astype(float), np.bincount(flat, weights=lab, minlength=BUCKETS)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda o, e: np.where(o > 0, o * np.log(o / e), 0)
        g = part(df1, df * n1 / n) + part(df - df1, df * (n - n1) / n) + part(n1 - df1, (n - df) * n1 / n) + part(n - n1 - df + df1, (n - df) * (n - n1) / n)
    g = np.where(df >= least_df, np.nan_to_num(g), -1)
    return np.sort(np.argsort(-g, kind="stable")[: min(most, int((g > least_g).sum()))])


def fit(rows: list[np.ndarray], toxic: np.ndarray, most_terms: int = 8192, rank: int = 8, epochs: int = 12, rate: float = 0.1, l2: float = 1e-4, seed: int = 4) -> Machine:
    """Adagrad on the logistic loss in batches of 128; without both labels the score is the base rate."""
    n, n1 = len(toxic), float(toxic.sum())
    bias = float(np.log((n1 + 0.5) / (n - n1 + 0.5)))
    if not 0 < n1 < n:
        return Machine(np.empty(0, np.int64), bias, np.empty(0), np.empty((0, rank)))
    buckets, rng = _chosen(rows, toxic, most_terms), np.random.default_rng(seed)
    place = np.full(BUCKETS, -1)
    place[buckets] = np.arange(len(buckets))
    rows = [(p := place[r])[p >= 0] for r in rows]
    w, v = np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), rank))
    weight = np.where(toxic > 0, np.sqrt((n - n1) / n1), 1.0)  # the rarer label counts more, or short evidence never reaches 0.5
    gw, gv, gb = np.full(len(w), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 128):
            pick = order[at : at + 128]
            flat = np.concatenate([rows[i] for i in pick])
            who = np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
            vf, total = v[flat], np.zeros((len(pick), rank))
            np.add.at(total, who, vf)
            pairs = 0.5 * ((total**2).sum(1) - np.bincount(who, (vf**2).sum(1), len(pick)))
            y = bias + np.bincount(who, w[flat], len(pick)) + pairs
            miss = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - toxic[pick]) * weight[pick]
            used = np.unique(flat)
            dw = np.bincount(flat, miss[who], len(w))[used] / len(pick) + l2 * w[used]
            dv = np.zeros_like(v)
            np.add.at(dv, flat, miss[who, None] * (total[who] - vf))
            dv = dv[used] / len(pick) + l2 * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.2 * rate * dv / np.sqrt(gv[used])
            gb += miss.mean() ** 2
            bias -= rate * miss.mean() / np.sqrt(gb)
    return Machine(buckets, float(bias), w, v)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [sorted({b for w in distinct_words(t) for b in terms_of(w)}) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 8_000, **options) -> Machine:
    """Fit on at most `sample` labelled documents, those outside the held-out fold with the smallest hash of the id.

    Of several labels of a document the largest counts; null labels and texts without an id are left out.
    """
    known = only(labels, "doc_id", "toxic").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = sorted((r.doc_id, r.toxic) for r in known.collect())  # at most `sample` pairs of integers
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")
    rows = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInArrow(_term_rows, "doc_id long, toxic int, terms array<int>")
    got = rows.toArrow().sort_by("doc_id")
    if not ids or not got.num_rows:
        return fit([], np.empty(0), **options)
    terms = got.column("terms").combine_chunks()  # numbers stay in Arrow's own arrays: as Python objects they would take a multiple of the memory
    values, ends = terms.values.to_numpy(), terms.offsets.to_numpy()
    return fit([values[i:j].astype(np.int64) for i, j in zip(ends, ends[1:], strict=False)], got.column("toxic").to_numpy().astype(float), **options)


def score_with(docs: DataFrame, machine: Machine, text: str = "text") -> Column:
    """A column: the machine's score of the whole text, 0 to 1; of an empty or null text what the bias alone says."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # at most most_terms rows of rank + 1 numbers

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        one = held.value.score
        return pa.array([one(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.float64())

    return score(F.col(text))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs (doc_id, text).

    labels: (doc_id, toxic 0/1). Only the text enters a score. A null text counts as empty; a null doc_id is
    scored and not held out; repeated rows score alike; an empty table gives no rows; without labels of both
    kinds every score is the base rate. Other columns are not read.
    """
    docs = only(docs, "doc_id", "text")
    machine = train(docs, labels, **options)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_with(docs, machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, text, and any other columns) whose text scores below 0.5, with all their columns.

    Null and empty texts get what the bias says, which rejects them only where most labels are toxic; repeated rows and ties score alike; a null
    doc_id is judged and not learnt from; an empty table gives no rows; without labels of both kinds the base rate decides.
    """
    machine, placed = train(docs, labels, **options), docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return placed.where(score_with(docs, machine, f"c{docs.columns.index('text')}") < 0.5).toDF(*docs.columns)
