"""run() of the corpus pipeline against a plain version of its five stages."""

import math
import os
import random

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import decontamination, line_dedup, toxicity
from lodestone.llm.common import shared_dir, shingles

BAD = ["scumword", "trashword", "idiotword"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables():
    rng = random.Random(21)
    words = lambda n, k=900: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    bench = [(i, words(25, 5000)) for i in range(4)] + [(9, None), (10, "")]
    texts = ["\n".join(words(rng.randrange(4, 20)) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    texts += [f"{words(8)} {rng.choice(BAD)} {rng.choice(BAD)} {words(6)}" for _ in range(30)]
    base = words(80).split()
    for _ in range(8):  # near copies, on one line each
        w = list(base)
        w[rng.randrange(80)] = f"x{rng.randrange(99)}"
        texts.append(" ".join(w))
    texts += ["a line that repeats in many texts of the table\n" + words(12) for _ in range(6)] + ["a line that repeats in many texts of this table\n" + words(12)]
    texts += [words(5) + "\n" + bench[k][1] for k in range(2)] + [" ".join(bench[2][1].split()[12:] + ["and"] + bench[2][1].split()[:12])]
    texts += [None, "", " \n ", texts[0], words(6000)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int(any(b in (t or "") for b in BAD))) for i, t in enumerate(texts) if i % 9]
    return [*rows, rows[3], (None, "no id here", "en", "s", 10)], labels, bench


def jaccard(x, y):
    return len(x & y) * 100 >= 80 * len(x | y)


def clean_lines(rows):
    """Each text without the lines that have the words of an earlier line, or 80 percent of both."""
    seen, out, gone = [], [], {}
    for i, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda x: x[0]):
        for k, line in enumerate((t or "").lower().replace("\t", " ").replace("\r", " ").split("\n")):
            words = set(line.split(" ")) - {""}
            if words and any(words == s or jaccard(words, s) for s in seen):
                gone.setdefault(i, set()).add(k)
            if words:
                seen.append(words)
    for i, t, lang, source, n in rows:
        if i in gone and t is not None:
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
            n = len(t)
        out.append((i, t, lang, source, n))
    return out


def one_of_each(rows):
    sets = {r[0]: set(shingles((r[1] or "").encode()).tolist()) for r in rows if r[0] is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i, s in sets.items() if s)
    for a in ids:
        for b in ids:
            if a < b and jaccard(sets[a], sets[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return [r for r in rows if r[0] is None or find(r[0]) == r[0]]


def covers(text, item, seed=4):
    """The share of the item's words that greedy tiles of the text cover."""
    a, b = (decontamination.plain_words((t or "").encode()).tolist() for t in (text, item))
    if not b:
        return 0.0
    used_a, used_b, marked = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in [i for i, w in enumerate(a) if w == b[j]]:
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < min(seed, len(b)):
            return marked / len(b)
        n, i, j = best[0], -best[1], -best[2]
        used_a[i : i + n] = used_b[j : j + n] = [True] * n
        marked += n


def least_padded(lengths, buckets=16):
    """The least sum of padded lengths with so many buckets, over all boundaries."""
    distinct = sorted(set(lengths))
    below = [sum(x <= d for x in lengths) for d in distinct]
    best = [0.0] + [math.inf] * len(distinct)
    for _ in range(buckets):
        best = [0.0] + [min([best[j], *[best[i] + (below[j - 1] - (below[i - 1] if i else 0)) * distinct[j - 1] for i in range(j)]]) for j in range(1, len(distinct) + 1)]
    return best[-1]


@pytest.fixture
def small_tables(monkeypatch):
    monkeypatch.setattr(line_dedup, "SLOTS", 1 << 10)
    monkeypatch.setattr(line_dedup, "BITS", 1 << 12)


def test_run_equals_a_plain_version(spark, tmp_path, small_tables):
    rows, labels, bench = tables()
    docs = spark.createDataFrame(rows, DOCUMENTS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    place = {b: i for i, b in enumerate(machine.buckets.tolist())}

    def score(text):
        terms = sorted({place[b] for w in toxicity.distinct_words((text or "").encode()) for b in toxicity.terms_of(w) if b in place})
        y = machine.bias + sum(machine.weights[i] for i in terms) + sum(float(np.dot(machine.factors[i], machine.factors[j])) for i in terms for j in terms if i < j)
        return 1 / (1 + math.exp(-y))

    want = [r for r in rows if score(r[1]) < 0.5]
    assert 15 < len(rows) - len(want) < 40
    want = clean_lines(want)
    want = one_of_each(want)
    want = [r for r in want if not any(covers(r[1], t) >= 0.5 for _, t in bench)]

    shared = shared_dir(spark).removeprefix("file:")
    stored = lambda: {n for n in os.listdir(shared) if any(files for *_, files in os.walk(f"{shared}/{n}"))}
    before = stored()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = [len((r[1] or "").split()) for r in want]
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in got) == sorted((r[0] is None, r[0], n) for r, n in zip(want, sizes, strict=True))
    assert sum(r.bucket_length for r in got) == least_padded(sizes) and all(r.n_tokens <= r.bucket_length for r in got)
    assert all(r.bucket_length == min(x.bucket_length for x in got if x.bucket_length >= r.n_tokens) for r in got)
    batches = {}
    for r in got:
        batches.setdefault((r.bucket_length, r.shard, r.batch), []).append(r.place)
        assert r.batch_rows * r.bucket_length <= 32768 or r.batch_rows == 1
    assert all(sorted(p) == list(range(len(p))) for p in batches.values())
    assert {n.rsplit("-", 1)[0] for n in stored() - before} == {"stage-packing"}  # nothing else stays


def test_run_of_empty_tables(spark, tmp_path, small_tables):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pairs_of_words_decide_where_single_words_say_nothing(spark):
    """An insult with a group's name is toxic, either alone is not: with the factors at nought the score doesn't tell them apart."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join([f"f{rng.randrange(40)}" for _ in range(5)] + ["insultword"] * a + ["groupname"] * b)))
        labels.append((i, int(a and b)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs, known, epochs=40)
    held = [r for r in toxicity.toxicity(docs, known, epochs=40).collect() if r.held_out]
    right = lambda score: np.mean([(score(rows[r.doc_id][1].encode()) >= 0.5) == labels[r.doc_id][1] for r in held])
    assert np.mean([(r.score >= 0.5) == labels[r.doc_id][1] for r in held]) >= 0.97 and right(machine.score) >= 0.97
    both, one, other = (machine.score(t) for t in (b"insultword groupname", b"insultword", b"groupname"))
    machine.factors[:] = 0
    assert both > 0.5 > max(one, other) and machine.score(b"insultword groupname") < both
