"""Edge cases of the training-data operators, and brute force where SQL says nothing."""

import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
import tiktoken

from lodestone.llm import common, decontamination, exact_dedup, jaccard_join, length_buckets, line_dedup, queries, revisits, suffix_dedup, token_packing, toxicity, url_reputation
from lodestone.llm.common import shingles, words_of

DOCS = "doc_id long, text string, kept string"  # a clashing extra column


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Near copies, exact copies, repeated passages and lines, null, empty and long texts, a null id, a repeated row."""
    rng = random.Random(7)
    base, passage, out = words(rng, 120), words(rng, 60, 5000), []
    for i in range(30):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
        out.append((i, " ".join(w)))
    for i in range(30, 50):
        lines = [" ".join(words(rng, rng.randrange(3, 15))) for _ in range(8)]
        if i % 3 == 0:
            lines.insert(2, " ".join(passage))
        if i % 4 == 0:
            lines += ["one two three four five six seven eight nine ten", "One two three four five six seven eight nine TEN", "one two three four five six seven eight nine eleven"]
        out.append((i, "\n".join(lines)))
    out += [(60, None), (61, ""), (62, " \t\n"), (63, "a b"), (64, "A  b"), (65, " ".join(words(rng, 9000))), (None, " ".join(base)), (66, out[3][1].upper()), (67, out[3][1]), (67, out[3][1])]
    return [(i, t, "x") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_exact_dedup(docs, rows):
    texts = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t, _ in rows]
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [i for (i, _, _), t in zip(rows, texts, strict=True) if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same) and r.keep_id == max((i for i in same if i is not None), default=None) and r.kept == (r.doc_id is not None and r.doc_id == r.keep_id)


def test_chunks_are_the_text_and_content_defined():
    text = np.random.default_rng(1).integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    cuts = exact_dedup.cut_points(text)
    assert cuts[-1] == len(text) and max(np.diff([0, *cuts])) <= exact_dedup.MAX_CHUNK
    moved = {c - 37 for c in exact_dedup.cut_points(b"x" * 37 + text)}
    assert len(moved & set(cuts)) > 0.8 * len(cuts) and exact_dedup.cut_points(b"") == []


def test_jaccard_classes_equal_brute_force(docs, rows):
    sets = [(i, shingles((t or "").encode())) for i, t, _ in rows]
    parent = {i: i for i, s in sets if i is not None}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and len(x) and len(y):
                both = len(np.intersect1d(x, y))
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    u, v = sorted((find(a), find(b)))
                    parent[v] = u
    got = jaccard_join.jaccard_classes(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else find(r.doc_id))
    assert {r.doc_id: r.n_shingles for r in got}[63] == 1
    assert jaccard_join.keep_one_of_class(docs).columns == docs.columns


def test_jaccard_classes_of_large_sets(spark):
    """Sets on both sides of the size from which long parities bound the similarity, near and beyond 0.8."""
    rng = random.Random(3)
    out = []
    for k, n in enumerate((500, 515, 1020, 1100, 2600)):
        base = words(rng, n, 100_000)
        for j, edits in enumerate((0, n // 60, n // 45, n // 20)):
            w = list(base)
            for at in rng.sample(range(n), edits):
                w[at] = f"y{rng.randrange(10**6)}"
            out.append((10 * k + j, " ".join(w)))
        out.append((10 * k + 4, " ".join(base + words(rng, n // 5, 100_000))))
    sets = {i: set(zip(*(t.split()[s:] for s in range(5)), strict=False)) for i, t in out}
    best = {i: min(j for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in sets}
    want = {i: best[best[i]] for i in sets}
    assert len(set(want.values())) < len(want) - 5 and any(i == c for i, c in want.items() if i % 10)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert got == want
    s = [np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)) for n in (512, 513, 3000)]
    assert [x and 8 * len(x) for x in map(jaccard_join._long_parity, s)] == [None, 2048, 8192]


def test_windows_cover_all_pairs_of_sizes():
    edge, plan = np.array(jaccard_join.bands(3000)), jaccard_join.windows(3000)
    for a in range(1, 1200):
        for b in {a, 5 * a // 4}:
            i, j = np.searchsorted(edge, [a, b], "right") - 1
            assert j - i in (0, 1)
            upper = j > i
            k = (a + b) // 9
            ka, kb = (int(jaccard_join.differing(np.array([s]), plan[i], u)[0]) for s, u in ((a, False), (b, upper)))
            assert ka >= k and kb >= k and max(ka, kb) // 2 + 1 + 2 * plan[i].drop <= plan[i].n1


def test_signatures_of_very_long_texts():
    """Sets of more than 1,122,241 shingles have signatures, the same ones in any block, and near copies share some."""
    import pyarrow as pa

    long = [b"%x" % i for i in range(1_130_000)]
    near = long[:500_000] + [b"other"] + long[500_001:]
    got = []
    for texts in ([b" ".join(long)], [b"a b c", b" ".join(near)]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
        got += [{s for r in jaccard_join._signature_rows(iter([batch])) for s in r.column(0).to_pylist()}]
    assert got[0] & got[1]
    for most in (1, 2, 5, 63, 64, 3000):
        assert len(jaccard_join.windows(most)) > np.searchsorted(jaccard_join.bands(most), most, "right") - 1
        assert jaccard_join.windows(most) == jaccard_join.windows(1 << 20)[: len(jaccard_join.windows(most))]


@pytest.fixture
def small_tables(monkeypatch):
    """Tables of rarity and of named lines that a few rows fill, as a large corpus fills the usual ones."""
    for name, size in (("SLOTS", 256), ("FREQUENT", 100), ("BLOCK", 16), ("BITS", 1024)):
        monkeypatch.setattr(line_dedup, name, size)


def without_repeats(texts):
    """Brute force: {doc_id: (lines, numbers of those that repeat an earlier one)} of (doc_id, text)."""
    seen, want = [], {}
    for i, t in sorted(((i, t) for i, t in texts if i is not None), key=lambda r: r[0]):
        if i in want:
            continue
        lines, gone = (t or "").split("\n"), []
        for k, line in enumerate(lines):
            s = frozenset(re.sub("[\t\r]", " ", line.lower()).split(" ")) - {""}
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                gone.append(k)
            seen += [s] if s else []
        want[i] = (len(lines), gone)
    return want


def test_line_dedup_equals_brute_force(docs, rows, small_tables):
    want = without_repeats([(i, t) for i, t, _ in rows])
    assert {r.doc_id: (r.n_lines, list(r.removed)) for r in line_dedup.removed_lines(docs).collect()} == want
    left = line_dedup.dedup_lines(docs)
    assert left.columns == docs.columns
    strip = lambda i, t: t if t is None or i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i][1])
    assert sorted(map(repr, left.collect())) == sorted(map(repr, [type(left.first())(doc_id=i, text=strip(i, t), kept=k) for i, t, k in rows]))


def test_line_dedup_runs_few_jobs_and_stores_no_tokens(spark, docs, small_tables, monkeypatch):
    """What the driver holds grows with the jobs of a call; the tokens of all lines never stand in the shared folder."""
    labels, write = [], common._write
    monkeypatch.setattr(common, "_write", lambda df, label, options: (labels.append((label, df.columns)), write(df, label, options))[1])
    monkeypatch.setattr(common, "checkpointed", lambda df: pytest.fail("a checkpoint of all tokens"))
    monkeypatch.setattr(line_dedup, "checkpointed", common.checkpointed, raising=False)
    spark.sparkContext.setJobGroup("line-dedup", "")
    try:
        line_dedup.removed_lines(docs)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("line-dedup"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [label for label, columns in labels if "tokens" in columns] == ["named-lines"] * 2
    assert len(labels) <= 16 and jobs <= 80


def test_line_dedup_puts_frequent_words_last(spark, small_tables, monkeypatch):
    """Long words that all lines hold stand last in the order of words; the result is that of brute force."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "SLOTS", 20)
    rng = random.Random(5)
    texts = [" ".join(["everywhere-in-all-lines", "another-frequent-word", *words(rng, rng.randrange(3, 9), 40)]) for _ in range(150)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with common.scratch(spark):
        lines = line_dedup.token_lines(table)
        first, last = (x.select(F.explode("prefix").alias("token")).groupBy("token").count().agg(F.max("count")).first()[0] for x in (line_dedup.first_lines(lines, 80), line_dedup.ordered_lines(lines, 80)))
    assert first > 100 and last < first
    assert {r.doc_id: (r.n_lines, list(r.removed)) for r in line_dedup.removed_lines(table).collect()} == without_repeats(enumerate(texts))


def test_line_dedup_takes_short_lines(spark, tmp_path, small_tables):
    """Lines of one word and more, near copies of many lengths and permuted lines, in the query, the stage of the pipeline and the operator, against brute force."""
    rng = random.Random(11)
    texts = ["\n".join(" ".join(words(rng, rng.randrange(7), 9)) for _ in range(6)) for _ in range(40)]
    texts += ["Home\nabout us\n港口大雾停航\na b c d", "home\nus about\n港口大雾停航\na b c d e", "\n \n\t", None, "Home\n\nhome\r"]
    for _ in range(30):
        base = words(rng, rng.randrange(4, 90), 10**6)
        for _ in range(5):
            w = [x if rng.random() > 0.06 else f"n{rng.randrange(10**6)}" for x in base] + words(rng, rng.randrange(3), 10**6)
            rng.shuffle(w)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    want = without_repeats(enumerate(texts))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_lines, list(r.removed)) for r in line_dedup.removed_lines(table).collect()} == want
    import corpus_pipeline

    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.n_lines, list(r.removed)) for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()} == want
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, table, str(tmp_path)).collect()}
    assert all(left[i] == (t if not want[i][1] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i][1])) for i, t in enumerate(texts))


def test_repeated_passages_equal_brute_force(docs, rows):
    n, count, windows = 50, {}, {}
    for i, t, _ in rows:
        if i is None or i in windows:
            continue
        w = words_of((t or "").encode())
        windows[i] = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        for x in windows[i]:
            count[x] = count.get(x, 0) + 1
    want = {}
    for i, ws in windows.items():
        at = {p for k, x in enumerate(ws) if count[x] > 1 for p in range(k, k + n)}
        if at:
            want[i] = len(at)
    got = {r.doc_id: r.n_repeated for r in suffix_dedup.repeated_passages(docs).collect()}
    assert set(got) == set(want) and sum(got.values()) >= 0.99 * sum(want.values())
    assert all(got[i] <= want[i] for i in got)


def test_passages_that_hold_a_frequent_line(spark):
    """Passages of 50 words and more around a line that many documents share: every window, and which of them stood before."""
    rng, line = random.Random(13), [f"line{i}" for i in range(35)]
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    texts = [own(30) + line + own(30) for _ in range(150)]
    for _ in range(40):
        left, right = own(rng.randrange(24)), own(rng.randrange(24))
        texts += [own(30) + left + line + right + own(30) for _ in range(rng.randrange(2, 4))]
    texts += [line + line + line, line + own(15), own(15) + line, line[:30] + own(20) + line]
    rng.shuffle(texts)
    places, want = {}, {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            places.setdefault(tuple(t[k : k + 50]), []).append((i, k))
    for at in places.values():
        for nth, (i, k) in enumerate(at):
            if len(at) > 1:
                every, later = want.setdefault(i, (set(), set()))
                every |= set(range(k, k + 50))
                later |= set(range(k, k + 50)) if nth else set()
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    cover = lambda spans: {p for s in spans for p in range(s.start, s.end)}
    got = {r.doc_id: (cover(r.spans), cover(r.later)) for r in suffix_dedup.repeated_passages(table).collect()}
    assert got == want


def test_greedy_tiles_take_the_longest_first():
    item, doc = (np.array([ord(c) for c in t.split()], np.uint64) for t in ("a b c d e f g h i j", "x f g h i j y a b c d e z a b c"))
    assert sorted(decontamination.greedy_tiles(doc, item, 3)) == [(1, 5, 5), (7, 0, 5)]


def naive_tiles(a, b, seed):
    """Greedy string tiling as defined: of all pairs of places the longest unmarked run, again and again."""
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                best = (i, j, n) if n > best[2] else best
        i, j, n = best
        if n < seed:
            return out
        out.append(best)
        used_a[i : i + n] = used_b[j : j + n] = [True] * n


def test_greedy_tiles_equal_naive_tiling():
    rng = random.Random(1)
    for _ in range(400):
        letters, seed = rng.choice([1, 2, 3, 6]), rng.choice([1, 2, 3, 4])
        a, b = ([rng.randrange(letters) for _ in range(rng.randrange(n))] for n in (28, 22))
        assert decontamination.greedy_tiles(np.array(a, np.uint64), np.array(b, np.uint64), seed) == naive_tiles(a, b, seed)


def test_items_covered_as_naive_tiling_says():
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, rng.randrange(1, 25), 6))) for i in range(25)]
    index = decontamination.Items(items, 4)
    for _ in range(40):
        text = " ".join(words(rng, rng.randrange(80), 6))
        a, want = text.split(), []
        for i, t in items:
            b = t.split()
            tiles = naive_tiles(a, b, min(4, len(b)))
            share = sum(n for *_, n in tiles) / len(b)
            if share >= (0.5 if len(b) >= 4 else 1.0):
                want.append((i, share, len(tiles)))
        assert index.hits(text.encode(), 0.5) == want


def test_repeated_words_cost_little():
    index = decontamination.Items([(i, " ".join(["same"] * 300)) for i in range(20)], 4)
    began = time.time()
    assert index.hits(" ".join(["same"] * 20_000).encode(), 0.5) == [(i, 1.0, 1) for i in range(20)]
    assert time.time() - began < 15


def test_decontamination_of_odd_tables(spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(1, item, "x", 1), (1, item, "x", 1), (2, None, "x", 2), (3, "", "x", 3), (4, "z " * 3000 + item, "x", 4), (None, "clean", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Text string, `a.b` long")
    bench = spark.createDataFrame([(1, item), (1, item), (None, "clean"), (2, None)], "item_id long, text string")
    for options in ({}, {"block_bytes": 20}):  # passes of one block each
        assert sorted((r.doc_id or 0, r.contaminated) for r in decontamination.decontaminate(docs, bench, **options).collect()) == [(0, False), (1, True), (1, True), (2, False), (3, False), (4, True)]
        left = decontamination.drop_contaminated(docs, bench, **options)
        assert left.columns == docs.columns and sorted(r[3] for r in left.collect()) == [2, 3, 5]
    assert decontamination.drop_contaminated(docs, bench.where("false")).count() == 6 and decontamination.drop_contaminated(docs.where("false"), bench).collect() == []


def test_ids_of_long_white_space():
    encoding = tiktoken.Encoding("t", pat_str=token_packing.PATTERN, mergeable_ranks=token_packing._ranks(Path(token_packing.VOCABULARY).read_bytes()), special_tokens={})
    rng, blanks = random.Random(2), " \n\t\x0b\x85\xa0\u2003\u3000\r"
    for _ in range(300):
        text = "".join("".join(rng.choice(blanks) for _ in range(rng.choice([1, 2, 999, 1000, 1500]))) if rng.random() < 0.5 else rng.choice(["a", "'s", "\x1c", "é!", "12", " x"]) for _ in range(rng.randrange(1, 6)))
        assert np.concatenate(token_packing.encode(encoding, text)).tolist() == encoding.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, " \n" * 500_000, "a" + " " * 1_000_000 + "b"], ids=len)
def test_a_million_blanks_are_packed(spark, text):
    rows = token_packing.pack_tokens(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, Text string")).collect()
    assert sum(r.n_tokens for r in rows) >= 1_000_000


def test_operators_take_columns_that_differ_by_case(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "x")], "doc_id long, text string, Text string")
    labels = spark.createDataFrame([(1, 0, "x"), (2, 1, "x")], "doc_id long, toxic int, Toxic string")
    assert all(r.group_size == 2 for r in exact_dedup.exact_dedup(docs).collect()) and suffix_dedup.repeated_passages(docs).collect() == []
    assert toxicity.toxicity(docs, labels).count() == 2 and length_buckets.length_buckets(docs).count() == 2
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns


def test_components_of_a_long_chain_in_no_order(spark):
    ids = list(range(400))
    random.Random(3).shuffle(ids)
    with common.scratch(spark):
        got = common.components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "u long, v long"), rounds=2).collect()
    assert len(got) == 400 and {r.component for r in got} == {0}


def test_decontamination_finds_reordered_items(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    d = spark.createDataFrame([(1, "so: " + item.upper() + "!"), (2, "zeta eta theta iota kappa and alpha beta gamma delta epsilon"), (3, "alpha beta gamma only"), (4, None), (5, "two words here")], "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (8, None), (9, "two words")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, list(r.item_ids), r.coverage, r.n_tiles) for r in decontamination.decontaminate(d, b).collect()}
    assert got == {1: (True, [7], 1.0, 1), 2: (True, [7], 1.0, 2), 3: (False, [], 0.0, 0), 4: (False, [], 0.0, 0), 5: (True, [9], 1.0, 1)}
    assert decontamination.decontaminate(d, b, block_bytes=10).where("contaminated").count() == 3


def test_packing_is_lossless(docs, rows):
    packed = token_packing.pack_tokens(docs, length=256, block=20_000).collect()
    import base64
    from pathlib import Path

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(token_packing.VOCABULARY).read_bytes().splitlines())}
    encoding = tiktoken.Encoding("t", pat_str=token_packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = {}
    for r in packed:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for d, k, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.setdefault(d, {}).setdefault(k, []).append(ids[a:b].tolist())
    for i, t in {i: t for i, t, _ in rows}.items():
        whole = [x for k in sorted(parts[i]) for x in parts[i][k][0]]
        assert whole[-1] == token_packing.END and encoding.decode(whole[:-1]) == (t or "")


def test_best_fit_decreasing_equals_a_plain_search():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 300)
    rooms, want = [], []
    for i in np.argsort(-lengths, kind="stable").tolist():
        fits = [(r, b) for b, r in enumerate(rooms) if r >= lengths[i]]
        if not fits:
            rooms.append(64)
            want.append(0)
            fits = [(64, len(rooms) - 1)]
        b = min(fits)[1]
        rooms[b] -= lengths[i]
    bins = token_packing.best_fit_decreasing(lengths, 64)
    assert len(bins) == len(rooms) and sorted(i for b in bins for i in b) == list(range(300)) and all(lengths[b].sum() <= 64 for b in bins)


def test_boundaries_are_optimal():
    from itertools import combinations

    longest, n = np.array([1, 2, 5, 6, 9, 14]), np.array([5, 1, 7, 2, 3, 1])
    cost = lambda bounds: sum(c * min(b for b in bounds if b >= x) for x, c in zip(longest, n, strict=True))
    best = min(cost((*c, 14)) for k in range(3) for c in combinations(longest[:-1].tolist(), k))
    assert cost(length_buckets.optimal_boundaries(longest, n, 3)) == best
    assert length_buckets.optimal_boundaries(np.array([]), np.array([]), 3) == []


def test_boundaries_of_many_bins_equal_the_whole_table_of_costs(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    for m, k in ((1, 3), (7, 9), (90, 5), (200, 16)):
        longest, n = np.sort(rng.choice(5000, m, replace=False)), rng.integers(1, 1 + rng.integers(1, 900), m)
        seen, best = np.concatenate([[0], np.cumsum(n)]), [0.0] + [np.inf] * m
        for _ in range(k):
            best = [0.0] + [min(best[j], min(best[i] + (seen[j] - seen[i]) * longest[j - 1] for i in range(j))) for j in range(1, m + 1)]
        bounds = np.array(length_buckets.optimal_boundaries(longest, n, k))
        assert len(bounds) <= k and (n * bounds[np.searchsorted(bounds, longest)]).sum() == best[m]
    m, short = 9217, 501  # the most bins there are
    n = np.ones(m, int)
    n[short] = 10**6
    assert short in length_buckets.optimal_boundaries(np.arange(m), n, 2)
    lengths = [*range(1025), *{int(1024 * 2 ** (i / 128)) for i in range(1, 640)}]
    short = next(i for i in range(500, 999) if i * 1500 // len(lengths) == (i + 1) * 1500 // len(lengths))
    table = spark.createDataFrame([(i, x) for i, x in enumerate([*lengths, *[short] * 200_000])], "doc_id long, x long")
    assert length_buckets.length_buckets(table, buckets=2, length=F.col("x")).where(F.col("x") == short).select("bucket_length").distinct().collect() == [(short,)]


def test_batches_keep_their_budget(docs, rows):
    got = length_buckets.length_buckets(docs, buckets=4, budget=500, shard_rows=10).collect()
    assert len(got) == len(rows) and all(r.n_tokens <= r.bucket_length for r in got)
    sizes = {}
    for r in got:
        sizes.setdefault((r.bucket_length, r.shard, r.batch), []).append(r.place)
    assert all(sorted(p) == list(range(len(p))) and (len(p) == 1 or len(p) * k[0] <= 500) for k, p in sizes.items())


def test_toxicity_learns_words_stems_and_pairs(spark):
    rng, rows = random.Random(5), []
    for i in range(1500):
        w, toxic = words(rng, 30), i % 5 == 1
        w += (["insult", "group"] if i % 2 else [f"zorgl{rng.randrange(999)}"]) if toxic else (["insult"] if i % 3 == 0 else ["group"] if i % 3 == 1 else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic")).join(table, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert len(got) > 200 and right >= 0.95 * len(got)


def test_toxicity_without_labels(docs, spark):
    got = toxicity.toxicity(docs, spark.createDataFrame([(1, None)], "doc_id long, toxic int")).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5}


def test_urls(spark):
    pages = spark.createDataFrame([(1, "https://WWW.Example.org/es/x?y", "h"), (2, "http://a.com", "h"), (3, None, "h"), (4, "no scheme", "h"), (5, "http://b.com/de/1#z", "h"), (6, "http://bad.net/1", "h"), (6, "http://bad.net/1", "h")], "page_id long, url string, host string")
    more = spark.createDataFrame([(100 + i, f"http://bad.net/{i}", "h") for i in range(50)] + [(200 + i, f"http://good.net/{i}", "h") for i in range(50)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(50)] + [(200 + i, 0) for i in range(50)] + [(1, None)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.url_filter(pages.union(more), outcomes).collect()}
    assert got[1] == ("www.example.org", "/es/x", "example.org/es/", "block") and got[2] == ("a.com", "", None, "allow")
    assert got[3][:3] == ("", "", None) and got[4][:2] == ("", "") and got[5][2:] == ("com/de/", "block") and got[6][3] == "block" and got[200][3] == "allow"


@pytest.mark.parametrize("slice_rows", [3, 200_000])
def test_revisits(spark, slice_rows):
    rng, rows = random.Random(2), []
    for i in range(120):
        full = rng.random() < 0.5
        rows.append((i, rng.choice(["http://A.com/x?utm_source=f", "https://www.a.com/x/", "http://b.org/y", None]), rng.randrange(40), 200 if full else 304, {"ETag": f'"{rng.randrange(2)}"', "Content-Length": "5" if full else "0"}, f"p{i}" if full else None))
    table = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>, payload_digest string")
    key = {"http://A.com/x?utm_source=f": "a.com/x", "https://www.a.com/x/": "a.com/x", "http://b.org/y": "b.org/y", None: None}
    got = {r.record_id: r for r in revisits.resolve_revisits(table, slice_rows).collect()}
    assert len(got) == sum(r[3] == 304 for r in rows)
    for i, url, ts, status, headers, _ in rows:
        if status == 304:
            before = [r for r in rows if r[3] == 200 and key[r[1]] == key[url] and url and r[2] < ts]
            hit = max(before, key=lambda r: (r[2], r[0]), default=None)
            want = "no_earlier_response" if not hit else "resolved" if hit[4]["ETag"] == headers["ETag"] else "validator_mismatch"
            assert (got[i].refers_to, got[i].outcome) == (hit and hit[0], want)
            assert want != "resolved" or got[i].headers == {"etag": headers["ETag"], "content-length": "5"}


def test_empty_tables(spark, docs, small_tables):
    none, labels = docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (exact_dedup.exact_dedup(none), jaccard_join.jaccard_classes(none), line_dedup.removed_lines(none), suffix_dedup.repeated_passages(none), length_buckets.length_buckets(none), token_packing.pack_tokens(none), toxicity.toxicity(none, labels), decontamination.decontaminate(none, bench)):
        assert df.count() == 0
