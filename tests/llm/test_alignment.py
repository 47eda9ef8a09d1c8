"""Alignment of two tokenizers against whole texts encoded at once."""

import collections
import hashlib
import random
from pathlib import Path

import numpy as np
import pytest

from lodestone.llm import alignment
from lodestone.llm.alignment import Fragment, cut

PARTS = ["a", "the", " ", " ", "  ", "\n", "\t", "é", "ü", "文", "字", "😀", "'s", "'", "1", "23", ".", ",", "　", "<s>", "<|endoftext|>", "Ġ", "xxxxxxxxx", "\x00", "\x1c", "\u0085", " \n", "Hello", "world", "ing"]


@pytest.fixture(scope="module")
def known():
    return alignment.Vocabularies(Path(alignment.BYTE_BPE).read_bytes(), Path(alignment.PIECE_BPE).read_bytes())


def plain(known, text):
    """(n_a, n_b, n_groups, groups, links) of a text encoded at once, links by all pairs; None if it has no tokens."""
    full = f" {text}".encode()
    a, b = known.tokenizer.encode(f" {text}", add_special_tokens=False).ids, known.pieces.encode(text)
    if not text or b"".join(known.a_bytes[i] for i in a) != full or b"".join(known.b_bytes[i] for i in b) != full:
        return None
    spans = []
    for ids, held in ((a, known.a_bytes), (b, known.b_bytes)):
        ends = np.cumsum([len(held[i]) for i in ids]).tolist()
        spans.append([(i, s, e) for i, s, e in zip(ids, [0, *ends], ends, strict=False)])
    groups, links, last = [], [], 0
    for end in sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}):
        x, y = ([t for t in side if last < t[2] <= end] for side in spans)
        groups.append(f"{','.join(str(t[0]) for t in x)}|{','.join(str(t[0]) for t in y)}")
        links += [p[0] << 32 | q[0] for p in x for q in y if max(p[1], q[1]) < min(p[2], q[2])]
        last = end
    return len(a), len(b), len(groups), ";".join(groups), sorted(links)


def told(f):
    return (f.n_a, f.n_b, f.n_groups, f.groups.decode(), sorted(np.repeat(f.codes, f.counts).tolist())) if f.ok else None


@pytest.mark.parametrize("size", [3, 8, 1000])
def test_fragments_compose_to_the_whole_in_any_order(known, size):
    rng = random.Random(size)
    for k in range(300):
        text = "".join(rng.choice([*PARTS, "▁"][: len(PARTS) + k % 2]) for _ in range(rng.randrange(1, 40)))
        full = f" {text}".encode()
        ranges = cut(full, size)
        assert [s for _, s, _, _ in ranges] == [0, *[e for _, _, e, _ in ranges][:-1]] and ranges[-1][2] == len(full)
        parts = [known.of_range(full[at:to], at, s, e) for at, s, e, to in ranges]
        in_turn, tree = Fragment(), list(parts)
        for f in parts:
            in_turn += f
        while len(tree) > 1:
            i = rng.randrange(len(tree) - 1)
            tree[i : i + 2] = [tree[i] + tree[i + 1]]
        assert told(in_turn.whole()) == told(tree[0].whole()) == plain(known, text), text


def expected(known, texts):
    found = [plain(known, t or "") for t in texts]
    holds = collections.Counter(c for f in found if f for c in set(f[4]))
    highest = collections.defaultdict(int)
    for c, n in holds.items():
        highest[c >> 32] = max(highest[c >> 32], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[4]), sum(holds[c] == highest[c >> 32] for c in f[4]), sum(holds[c] for c in f[4]), f[3]) for f in found]


@pytest.mark.parametrize("options", [{}, {"chunk": 64, "block": 2000, "fan": 2, "words": 5}])
def test_aligned_documents_equal_brute_force(spark, known, options):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [None, "", " ", "   ", "\n", "a", "one word▁here", "x" * 300, " ".join(["the same words"] * 200), texts[0], texts[0], "end ", " start", "<s> and <|endoftext|> </s>"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "no id")]  # repeated rows, a null id
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, Text string, `a.b` string")
    want = expected(known, [t for _, t in rows])
    got = alignment.align_tokens(docs, **options).collect()
    key = lambda r: (r[0] is None, repr(r))
    assert sorted(map(tuple, got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)
    digests = alignment.align_tokens(docs, digest=True, **options).collect()
    assert sorted(r.groups for r in digests) == sorted(hashlib.sha256(w[-1].encode()).hexdigest() if w[0] else "" for w in want)


def test_texts_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT 2L, 'a b'")
    assert {r.doc_id: r.n_a for r in alignment.align_tokens(docs).collect()} == {1: 0, 2: 2}


def test_alignment_of_an_empty_table(spark):
    assert alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
