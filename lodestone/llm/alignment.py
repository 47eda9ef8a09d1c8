"""Tokens of two vocabularies aligned by bytes, by fragments of byte ranges that compose associatively."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, only, scratch, stored

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: The white space of Unicode beyond ASCII, in UTF-8.
WIDE_BLANKS = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
#: Where no token of either vocabulary can cross: a space after anything but white space. Neither splits words nor merges over it.
SAFE = re.compile(rb" (?<=[!-~\x80-\xff] )" + b"".join(b"(?<!" + x + b" )" for x in WIDE_BLANKS.split(b"|")))
UNSURE = re.compile(rb"(?:[\x00-\x20\x7f]|" + WIDE_BLANKS + rb") ")


def words_of(text: bytes) -> list[bytes]:
    """The text cut at its safe spaces, which go: the tokens of space + text are those of space + word for each word."""
    if text[:1] == b" " or UNSURE.search(text):
        return SAFE.split(text)
    return text.split(b" ")


def _none() -> np.ndarray:
    return np.empty(0, np.int64)


@dataclass
class Open:
    """Tokens of both vocabularies, in order, with the bytes where they end."""

    a: np.ndarray = field(default_factory=_none)
    a_ends: np.ndarray = field(default_factory=_none)
    b: np.ndarray = field(default_factory=_none)
    b_ends: np.ndarray = field(default_factory=_none)

    def __add__(self, other: Open) -> Open:
        return Open(*(np.concatenate([getattr(self, f.name), getattr(other, f.name)]) for f in fields(self)))

    def part(self, a: slice, b: slice) -> Open:
        return Open(self.a[a], self.a_ends[a], self.b[b], self.b_ends[b])


def links_of(o: Open) -> np.ndarray:
    """A code for each pair of overlapping tokens of a stretch that starts and ends with tokens of both: the id of A in the upper half, that of B in the lower."""
    first, last = (np.concatenate([[np.iinfo(np.int64).min], x[:-1]]) if len(x) else x for x in (o.a_ends, o.b_ends))
    low, high = np.searchsorted(o.b_ends, first, "right"), np.searchsorted(last, o.a_ends, "left")
    n = high - low
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return np.repeat(o.a, n) << 32 | o.b[at]


def counted(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, sorted, and how often each stands there."""
    distinct, at = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(at, n, len(distinct)).astype(np.int64)


def texts_of_groups(o: Open, a: np.ndarray, b: np.ndarray) -> list[bytes]:
    """Of the groups that begin and end at these places of the tokens of A and B."""
    x, y, a, b = list(map(str, o.a.tolist())), list(map(str, o.b.tolist())), a.tolist(), b.tolist()
    return [f"{','.join(x[i:j])}|{','.join(y[k:m])}".encode() for i, j, k, m in zip(a, a[1:], b, b[1:], strict=False)]


@dataclass
class Fragment:
    """What is known of a range of bytes of a text. Its tokens are those that end in the range, its bounds the bytes where
    tokens of both vocabularies end. Up to the first bound runs an open prefix, which may belong to a group that
    begins before; after the last one an open suffix; between them all groups are closed. Without a bound all is prefix."""

    ok: bool = True
    bound: bool = False
    prefix: Open = field(default_factory=Open)
    suffix: Open = field(default_factory=Open)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    groups: bytes = b""
    codes: np.ndarray = field(default_factory=_none)
    counts: np.ndarray = field(default_factory=_none)

    def __add__(self, other: Fragment) -> Fragment:
        """The fragment of both ranges, one after the other; associative, Fragment() being neutral."""
        ok = self.ok and other.ok
        if not self.bound:
            prefix = self.prefix + other.prefix
            return Fragment(ok, other.bound, prefix, *(getattr(other, f.name) for f in fields(other)[3:]))
        if not other.bound:
            return Fragment(ok, True, self.prefix, self.suffix + other.prefix, *(getattr(self, f.name) for f in fields(self)[4:]))
        seam = closed(self.suffix + other.prefix)
        codes, counts = counted(np.concatenate([x.codes for x in (self, seam, other)]), np.concatenate([x.counts for x in (self, seam, other)]))
        groups = b";".join(x.groups for x in (self, seam, other) if x.n_groups)
        return Fragment(ok, True, self.prefix, other.suffix, *(getattr(self, n) + getattr(seam, n) + getattr(other, n) for n in ("n_a", "n_b", "n_groups")), groups, codes, counts)

    def whole(self) -> Fragment:
        """The fragment of a whole text: before its start nothing is open."""
        return START + self


def closed(o: Open) -> Fragment:
    """One group of these tokens; none if there are none."""
    if not len(o.a) and not len(o.b):
        return Fragment(bound=True)
    return Fragment(True, True, Open(), Open(), len(o.a), len(o.b), 1, *texts_of_groups(o, *(np.array([0, len(x)]) for x in (o.a, o.b))), *counted(links_of(o)))


START = Fragment(bound=True)


def fragment(o: Open) -> Fragment:
    """The fragment of a range with these tokens."""
    bounds = np.intersect1d(o.a_ends, o.b_ends, assume_unique=True)
    if not len(bounds):
        return Fragment(prefix=o)
    i, j = (np.searchsorted(x, bounds, "right") for x in (o.a_ends, o.b_ends))
    inner = o.part(slice(i[0], i[-1]), slice(j[0], j[-1]))
    groups = b";".join(texts_of_groups(inner, i - i[0], j - j[0]))
    return Fragment(True, True, o.part(slice(i[0]), slice(j[0])), o.part(slice(i[-1], None), slice(j[-1], None)), len(inner.a), len(inner.b), len(bounds) - 1, groups, *counted(links_of(inner)))


def cut(full: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """Byte ranges of about `size`, as (from, start, end, to): the words that touch a range stand in full[from:to]. A range ends
    anywhere in a word of at most `size` bytes; a longer word stays whole, since its tokens need all of it."""
    out, came, start = [], 0, 0
    while start < len(full):
        end = start + size
        left, right, go = end, end, end
        if end >= len(full):
            end = right = go = len(full)
        else:
            after = SAFE.search(full, end, end + size)
            before = None if after is None or after.start() == end else [m.start() for m in SAFE.finditer(full, max(start, end - size), end)]
            if after is not None and after.start() == end:
                pass
            elif after is not None and before and after.start() - before[-1] <= size:
                left, right = before[-1], after.start()
            else:
                after = SAFE.search(full, end)
                end = left = right = after.start() if after else len(full)
        out.append((came, start, end, right))
        came, start = left, end
    return out


class Vocabularies:
    """Two vocabularies, and what a worker has learnt of words: their groups, links and counts."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(byte_bpe.decode())
        self.tokenizer.encode_special_tokens = True
        self.pieces = SentencePieceProcessor(model_proto=piece_bpe)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level names: these stand for themselves, the others follow from 256 on
        names = {c: c for c in plain} | {256 + k: c for k, c in enumerate(c for c in range(256) if c not in set(plain))}
        held = self.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(held.values()) + 1)
        for name, i in held.items():
            self.a_bytes[i] = bytes(names[ord(c)] for c in name) if all(ord(c) in names for c in name) else name.encode()
        piece = self.pieces.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.pieces.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.pieces.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        self.n = np.empty((4, 1 << 12), np.int64)  # rows: tokens of A and B, groups, whether the bytes are right
        self.codes, self.bounds = np.empty(1 << 14, np.int64), np.zeros(1 << 12, np.int64)

    def tokens(self, words: list[bytes]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """The ids of A and B of space + word for each, and whether both are those bytes."""
        ok = []
        for w in words:
            try:
                w.decode()
                ok.append(True)
            except UnicodeDecodeError:
                ok.append(False)
        texts = [w.decode() if k else "" for w, k in zip(words, ok, strict=True)]
        a = [e.ids for e in self.tokenizer.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        blank = [self.pieces.piece_to_id("▁")]
        b = [x or blank for x in self.pieces.encode(texts, num_threads=1)]  # it gives no piece for an empty text
        for k, (w, x, y) in enumerate(zip(words, a, b, strict=True)):
            w = b" " + w
            ok[k] &= b"".join(map(self.a_bytes.__getitem__, x)) == w and b"".join(map(self.b_bytes.__getitem__, y)) == w
        return a, b, ok

    def learn(self, words: list[bytes]) -> None:
        a, b, ok = self.tokens(words)
        a, b = ([x if k else [] for x, k in zip(t, ok, strict=True)] for t in (a, b))
        counts = np.array([[len(x) for x in t] for t in (a, b)], np.int64).reshape(2, len(words))
        ids = [np.fromiter((i for x in t for i in x), np.int64, int(n.sum())) for t, n in zip((a, b), counts, strict=True)]
        every = Open(ids[0], np.cumsum(self.a_size[ids[0]]), ids[1], np.cumsum(self.b_size[ids[1]]))  # words stand one after another, each ends with a bound
        codes = links_of(every)
        ends = np.cumsum(np.array([len(w) + 1 if k else 0 for w, k in zip(words, ok, strict=True)], np.int64))
        bounds = np.intersect1d(every.a_ends, every.b_ends, assume_unique=True)
        texts, at = texts_of_groups(every, *(np.concatenate([[0], np.searchsorted(x, bounds, "right")]) for x in (every.a_ends, every.b_ends))), 0
        n_groups = np.diff(np.searchsorted(bounds, ends, "right"), prepend=0)
        links = np.searchsorted(every.b_ends, every.a_ends, "left") - np.searchsorted(every.b_ends, every.a_ends - self.a_size[every.a], "right") + 1
        n_links = np.diff(np.concatenate([[0], np.cumsum(links)])[np.cumsum(counts[0])], prepend=0)
        for n in n_groups.tolist():
            self.groups.append(b";".join(texts[at : at + n]))
            at += n
        base, used = len(self.index), self.bounds[len(self.index)]
        for k, w in enumerate(words, base):
            self.index[w] = k
        total = base + len(words)
        if total + 1 > self.n.shape[1]:
            room = 2 * total
            self.n = np.concatenate([self.n, np.empty((4, room - self.n.shape[1]), np.int64)], axis=1)
            self.bounds = np.concatenate([self.bounds, np.empty(room + 1 - len(self.bounds), np.int64)])
        if used + len(codes) > len(self.codes):
            self.codes = np.concatenate([self.codes[:used], np.empty(used + 2 * len(codes), np.int64)])
        self.n[:, base:total] = *counts, n_groups, ok
        self.bounds[base + 1 : total + 1] = used + np.cumsum(n_links)
        self.codes[used : used + len(codes)] = codes

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words, learnt where they are new."""
        if new := [w for w in dict.fromkeys(words) if w not in self.index]:
            self.learn(new)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def codes_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of these words, one after another, and how many each has."""
        n = self.bounds[words + 1] - self.bounds[words]
        return self.codes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.bounds[words], n)], n

    def middle(self, words: np.ndarray) -> Fragment:
        """The fragment of whole words; a bound stands at its start too."""
        if not len(words):
            return Fragment()
        n_a, n_b, n_groups, ok = self.n[:, words]
        groups = b";".join(map(self.groups.__getitem__, words.tolist()))
        return Fragment(bool(ok.all()), True, Open(), Open(), int(n_a.sum()), int(n_b.sum()), int(n_groups.sum()), groups, *counted(self.codes_of(words)[0]))

    def of_range(self, body: bytes, at: int, start: int, end: int) -> Fragment:
        """The fragment of the bytes start < x <= end of a text, of which body, from byte `at` on, holds the words that touch the range."""
        words = words_of(body[1:])
        stops = at + np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[at], stops[:-1]])
        inside = np.flatnonzero((starts >= start) & (stops <= end))
        low, high = (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (len(words), len(words))
        out = Fragment()
        for k in range(low):
            out += self.in_word(words[k], int(starts[k]), start, end)
        out += self.middle(self.numbers(words[low:high]))
        for k in range(high, len(words)):
            out += self.in_word(words[k], int(starts[k]), start, end)
        return out

    def in_word(self, word: bytes, at: int, start: int, end: int) -> Fragment:
        """Of a word that lies across a bound of the range: the tokens that end inside."""
        (a,), (b,), (ok,) = self.tokens([word])
        if not ok:
            return Fragment(ok=False)
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = at + np.cumsum(self.a_size[a]), at + np.cumsum(self.b_size[b])
        i, j = ((x > start) & (x <= end) for x in (a_ends, b_ends))
        return fragment(Open(a[i], a_ends[i], b[j], b_ends[j]))


_loaded: dict[tuple[int, int], Vocabularies] = {}


def _vocabularies(held) -> Vocabularies:
    """Those of this worker; what it has learnt lasts from task to task."""
    a, b = held.value
    if (hash(a), hash(b)) not in _loaded:
        _loaded.clear()
        _loaded[hash(a), hash(b)] = Vocabularies(a, b)
    return _loaded[hash(a), hash(b)]


_PARTS = [f"{side}_{f.name}" for side in ("prefix", "suffix") for f in fields(Open)]
_FRAGMENT = f"key long, doc_id long, seq long, ok boolean, bound boolean, {', '.join(f'{p} binary' for p in _PARTS)}, n_a long, n_b long, n_groups long, `groups` binary, codes binary, counts binary"
_BATCH = "batch string, doc_id long, n_a long, n_b long, n_groups long, n_links long, `groups` string, places binary, counts binary, codes binary, held binary"
_COUNTS = ("n_a", "n_b", "n_groups")


def _row(key: int, doc_id: int | None, seq: int, f: Fragment) -> dict:
    opened = {f"{side}_{x.name}": getattr(getattr(f, side), x.name).tobytes() for side in ("prefix", "suffix") for x in fields(Open)}
    return {"key": key, "doc_id": doc_id, "seq": seq, "ok": f.ok, "bound": f.bound, **opened, **{n: getattr(f, n) for n in _COUNTS}, "groups": f.groups, "codes": f.codes.tobytes(), "counts": f.counts.tobytes()}


def _of_row(r: dict) -> Fragment:
    array = lambda n: np.frombuffer(r[n], np.int64)
    sides = [Open(*(array(f"{side}_{x.name}") for x in fields(Open))) for side in ("prefix", "suffix")]
    return Fragment(r["ok"], r["bound"], *sides, *(r[n] for n in _COUNTS), r["groups"], array("codes"), array("counts"))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n.strip("`"), kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


class _Batch:
    """Documents whose links are written together: each names its links by their place in the batch's list of distinct links."""

    def __init__(self, name: str, digest: bool) -> None:
        self.name, self.digest = name, digest
        self.rows: list[dict] = []
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_id: int | None, f: tuple[int, int, int], groups: bytes | None, codes: np.ndarray, counts: np.ndarray) -> None:
        """groups: None for a document without tokens."""
        shown = "" if groups is None else hashlib.sha256(groups).hexdigest() if self.digest else groups.decode()
        self.rows.append({"batch": self.name, "doc_id": doc_id, **dict(zip(_COUNTS, f, strict=True)), "n_links": int(counts.sum()), "groups": shown})
        self.codes.append(codes)
        self.counts.append(counts)

    def written(self) -> pa.RecordBatch:
        sizes = np.cumsum([len(x) for x in self.codes])[:-1]
        distinct, places = np.unique(np.concatenate(self.codes), return_inverse=True)
        for row, at, n in zip(self.rows, np.split(places.astype(np.int32), sizes), self.counts, strict=True):
            row |= {"places": at.tobytes(), "counts": n.astype(np.int32).tobytes()}
        self.rows.append({"batch": self.name, "codes": distinct.tobytes(), "held": np.bincount(places, minlength=len(distinct)).astype(np.int64).tobytes()})
        return pa.RecordBatch.from_pylist(self.rows, _schema(_BATCH))


def _short(held, block: int, words: int, digest: bool):
    """Texts that a task takes whole: (doc_id, text) to rows of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, task, made = _vocabularies(held), TaskContext.get().partitionId(), 0
        docs: list[tuple[int | None, list[bytes]]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            nonlocal made
            if len(known.index) > words:
                known.forget()
            out = _Batch(f"s{task}-{made}", digest)
            made += 1
            ids = known.numbers([w for _, ws in docs for w in ws])
            ends = np.cumsum([len(ws) for _, ws in docs])
            doc = np.repeat(np.arange(len(docs)), np.diff(ends, prepend=0))
            # links of the batch's distinct words first, then each document's by the words it holds
            distinct, at = np.unique(ids, return_inverse=True)
            codes, n = known.codes_of(distinct)
            listed, place = np.unique(codes, return_inverse=True)
            pairs, times = counted(doc * max(1, len(distinct)) + at)
            doc_of, word_of = np.divmod(pairs, max(1, len(distinct)))
            first, many = (np.cumsum(n) - n)[word_of], n[word_of]
            each = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
            links, counts = counted(np.repeat(doc_of, many) * max(1, len(listed)) + place[each], np.repeat(times, many))
            link_doc, link_at = np.divmod(links, max(1, len(listed)))
            edges = np.searchsorted(link_doc, np.arange(len(docs) + 1))
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            for k, (doc_id, _) in enumerate(docs):
                mine = ids[begins[k] : ends[k]]
                n_a, n_b, n_groups, ok = known.n[:, mine]
                if not len(mine) or not ok.all():
                    out.add(doc_id, (0, 0, 0), None, _none(), _none())
                else:
                    some = slice(edges[k], edges[k + 1])
                    out.add(doc_id, (int(n_a.sum()), int(n_b.sum()), int(n_groups.sum())), b";".join(map(known.groups.__getitem__, mine.tolist())), listed[link_at[some]], counts[some])
            docs.clear()
            return out.written()

        for arrow in batches:
            for doc_id, text in zip(arrow.column(0).to_pylist(), arrow.column(1).cast(pa.binary()).to_pylist(), strict=True):
                docs.append((doc_id, words_of(text) if text else []))
                size += len(text or b"") + 64
                if size >= block:
                    yield batch()
                    size = 0
        if docs:
            yield batch()

    return run


def _chunks(size: int):
    """Long texts, (key, doc_id, text), to the byte ranges that tasks take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "doc_id", "seq", "at", "start", "end", "body")
        for arrow in batches:
            for key, doc_id, text in zip(*(arrow.column(i).to_pylist() for i in (0, 1)), arrow.column(2).cast(pa.binary()).to_pylist(), strict=True):
                full = b" " + text
                rows = [dict(zip(names, (key, doc_id, seq, at, start, end, full[at:to]), strict=True)) for seq, (at, start, end, to) in enumerate(cut(full, size))]
                for k in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 64], pa.schema([(n, pa.binary() if n == "body" else pa.int64()) for n in names]))

    return run


def align_tokens(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, chunk: int = 1 << 15, fan: int = 8, block: int = 4 << 20, words: int = 400_000, digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row of docs (doc_id, text).

    A encodes space + text by a byte-level BPE, B the text by a piece BPE with byte fallback that adds the space; special tokens' strings are
    plain text. Byte offsets where tokens of both end cut the tokens into groups: `groups` lists them as `a1,a2|b1;a3|b2,b3`
    (its SHA-256 in hex with digest=True). Tokens of A and B that overlap in bytes are links. The count of two ids is in how many
    rows of docs they link; n_best counts the links whose count is the highest that their id of A has, count_sum sums the counts over links.

    No token crosses a space after anything but white space, so both sides are tokenized word by word, and a worker
    remembers up to `words` words and more until a batch ends. A text longer than `chunk` bytes is cut into byte ranges, which may end inside words and
    tokens: tasks turn each into a Fragment, and a tree of joins of `fan` neighbours composes them, whatever the
    length of the text. Batches of `block` bytes list their distinct links once; these meet the corpus's counts,
    so neither the counts nor a document's links are broadcast or collected. A task holds a batch, or `fan` fragments of one text; the
    groups' text grows with its document as the text does.

    Null and empty texts have no tokens: zeros and ''. So have texts whose bytes differ from what the tokens of A or B spell (such as
    the piece mark U+2581, or bytes that aren't UTF-8). A null doc_id stays null; repeated rows are rows of their own and count each. Other
    columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((Path(byte_bpe).read_bytes(), Path(piece_bpe).read_bytes()))  # two vocabulary files
    with scratch(spark):
        docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        long_ = F.coalesce(F.octet_length("text") >= chunk, F.lit(False))
        batches = stored(docs.where(~long_).mapInArrow(_short(held, block, words, digest), _BATCH), "aligned-texts", compression="zstd")

        ranges = docs.where(long_).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInArrow(_chunks(chunk), "key long, doc_id long, seq long, at long, start long, end long, body binary")

        def fragments(arrows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _vocabularies(held)
            for arrow in arrows:
                for r in arrow.to_pylist():
                    if len(known.index) > words:
                        known.forget()
                    yield pa.RecordBatch.from_pylist([_row(r["key"], r["doc_id"], r["seq"], known.of_range(r["body"], r["at"], r["start"], r["end"]))], _schema(_FRAGMENT))

        def composed(t: pa.Table) -> pa.Table:
            rows = sorted(t.to_pylist(), key=lambda r: r["seq"])
            out = Fragment()
            for r in rows:
                out += _of_row(r)
            return pa.Table.from_pylist([_row(rows[0]["key"], rows[0]["doc_id"], rows[0]["seq"] // fan, out)], _schema(_FRAGMENT))

        level = stored(stored(ranges, "byte-ranges").repartition("key", "seq").mapInArrow(fragments, _FRAGMENT), "fragments", compression="zstd")
        most = (level.agg(F.max("seq")).first()[0] or 0) + 1
        while most > 1:
            level = stored(level.groupBy("key", F.floor(F.col("seq") / fan).alias("above")).applyInArrow(composed, _FRAGMENT), "fragments", compression="zstd")
            most = -(-most // fan)

        def batched(arrows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            for made, arrow in enumerate(arrows):
                out = _Batch(f"l{task}-{made}", digest)
                for r in arrow.to_pylist():
                    f = _of_row(r).whole()
                    if f.ok:
                        out.add(r["doc_id"], (f.n_a, f.n_b, f.n_groups), f.groups, f.codes, f.counts)
                    else:
                        out.add(r["doc_id"], (0, 0, 0), None, _none(), _none())
                if out.rows:
                    yield out.written()

        batches = batches.union(stored(level.mapInArrow(batched, _BATCH), "aligned-long-texts", compression="zstd"))

        def unpacked(arrows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for arrow in arrows:
                for name, codes, n in zip(*(arrow.column(c).to_pylist() for c in ("batch", "codes", "held")), strict=True):
                    codes, n = np.frombuffer(codes, np.int64), np.frombuffer(n, np.int64)
                    for k in range(0, len(codes), 1 << 16):
                        some = codes[k : k + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(np.arange(k, k + len(some), dtype=np.int32)), pa.array(some), pa.array(n[k : k + (1 << 16)])], ["batch", "place", "code", "held"])

        listed = stored(batches.where("codes is not null").select("batch", "codes", "held").mapInArrow(unpacked, "batch string, place int, code long, held long"), "listed-links")
        totals = stored(listed.groupBy("code").agg(F.sum("held").alias("n")).withColumn("a", F.shiftright("code", 32)), "link-counts")
        highest = totals.groupBy("a").agg(F.max("n").alias("most"))
        judged = totals.join(highest, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
        judged = listed.join(judged, "code").select("batch", "place", "n", "best")

        def summed(rows: pa.Table, links: pa.Table) -> pa.Table:
            links = links.sort_by("place")
            n, best = links["n"].to_numpy(), links["best"].to_numpy()
            total, good = [], []
            for at, counts in zip(rows["places"].to_pylist(), rows["counts"].to_pylist(), strict=True):
                at, counts = np.frombuffer(at, np.int32), np.frombuffer(counts, np.int32).astype(np.int64)
                total.append(int((n[at] * counts).sum()))
                good.append(int(counts[best[at]].sum()))
            kept_ = rows.select(["doc_id", *_COUNTS, "n_links"])
            return kept_.append_column("n_best", pa.array(good, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column("groups", rows["groups"])

        texts = batches.where("codes is null").drop("codes", "held")
        out = texts.groupBy("batch").cogroup(judged.groupBy("batch")).applyInArrow(summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, `groups` string")
        return kept(out, "aligned")
