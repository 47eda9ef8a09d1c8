import difflib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import values as V
from lodestone.operators import changes as CH
from lodestone.operators import events as E
from lodestone.operators import related as R
from lodestone.functions.rules import Rules, ValueLexicon
from lodestone.sources import tables as TB


def test_near_titles_against_all_pairs(spark):
    """Classes of equal keys against each other: nothing extra, and at least nine in ten of what all pairs find."""
    rng, titles = random.Random(3), []
    for _ in range(25):
        base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(12, 60)))
        titles += [base, base.upper()]
        for _ in range(3):
            t = list(base)
            for _ in range(rng.randrange(1, max(2, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            titles.append("".join(t))
    keys = ["".join(c for c in t.lower() if c.isalnum()) for t in titles]
    first = {k: keys.index(k) for k in keys}
    pairs = [(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if min(len(keys[i]), len(keys[j])) >= 6 and first[keys[i]] == i and (first[keys[j]] == j or keys[i] == keys[j])]
    want = {p for p in pairs if difflib.SequenceMatcher(None, keys[p[0]], keys[p[1]]).ratio() >= 0.84}
    got = {(r.a, r.b) for r in R.near_titles(spark.createDataFrame(list(enumerate(titles)), "event_id long, title string"), "event_id", "title").collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("rows, chars", [(32768, 1 << 23), (7, 500)])
def test_near_keys_equal_all_pairs(spark, monkeypatch, rows, chars):
    """Edits that touch every gram of a title are found too; before, such pairs met on no rare gram."""
    monkeypatch.setattr(R, "ROWS", rows)
    monkeypatch.setattr(R, "CHARS", chars)
    rng, keys = random.Random(4), {"abcdefghijklmnopqrstuvwxy", "中文标题一二三四五六七八", "中文标题一二三四五六七九"}
    for size in (7, 30, 64, 90, 250, 700):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)]
        keys |= {"".join(base), "".join(c if i % 6 else rng.choice("123456789") for i, c in enumerate(base)), "".join(c for i, c in enumerate(base) if i % 4 != 3)}
        keys |= {"".join(rng.sample(base, size)) for _ in range(3)} | {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)) for _ in range(6)}
    keys = sorted(keys, key=lambda k: rng.random())
    frame = lambda part: spark.createDataFrame(part, "id long, k string")
    share = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    for least in (0.84, 0.72):
        got = [(r.a, r.b, r.ratio) for r in R.near_keys(frame(list(enumerate(keys))), None, least).collect()]
        assert len(got) == len(set(got)) > 5 and set(got) == {(i, j, s) for i, a in enumerate(keys) for j, b in enumerate(keys) if i < j and (s := share(a, b)) >= least}
        got = {(r.a, r.b) for r in R.near_keys(frame(list(enumerate(keys[:20]))), frame(list(enumerate(keys[10:]))), least).collect()}
        assert got == {(i, j) for i, a in enumerate(keys[:20]) for j, b in enumerate(keys[10:]) if share(a, b) >= least}
    assert R.near_keys(frame([]), None, 0.84).collect() == R.near_keys(frame([(1, "a")]), frame([]), 0.84).collect() == []


def test_titles_of_the_queries_are_whole_first_lines(spark, tmp_path):
    """Before, titles were cut at 120 characters: 0 and 1 counted as copies, 2 and 3 weren't alike."""
    from lodestone.plans import catalog, relations, sources  # noqa: F401  register their queries

    rng = random.Random(6)
    text = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    head, tail = text(120), text(900)
    rows = [(i, f"{t}\nnext", "en", f"src{i}", len(t) + 5) for i, t in enumerate((head + text(400), head + text(400), text(120) + tail, text(120) + tail))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    share = difflib.SequenceMatcher(None, rows[2][1].split("\n")[0], rows[3][1].split("\n")[0]).ratio()
    assert {(r.a, r.b, r.ratio) for r in catalog.Q["near_titles"](spark, str(tmp_path)).collect()} == {(2, 3, round(share, 6))} and share > 0.84
    assert {(r.a, r.b) for r in catalog.Q["duplicate_scores"](spark, str(tmp_path)).collect()} == {(2, 3)} and {r.event_id for r in catalog.Q["duplicate_event_ids"](spark, str(tmp_path)).collect()} == {2, 3}


def test_rows_that_repeat_a_similar_title(spark):
    """As a loop over all earlier rows finds them; before, only the first row of a repeated title was looked at."""
    titles = ["harbour notice 1", "harbour notice 2", "Harbour Notice 1", "harbour notice 2!", "other words", "short", None, "other words"]
    keys = ["".join(c for c in (t or "").lower() if c.isalnum()) for t in titles]
    want = {b for b, k in enumerate(keys) if len(k) >= 6 and any(o != k and len(o) >= 6 and difflib.SequenceMatcher(None, o, k).ratio() >= 0.84 for o in keys[:b])}
    got = {r.b for r in R.similar_rows(spark.createDataFrame(list(enumerate(titles)), "row long, title string"), "row", "title").collect()}
    assert got == want == {1, 2, 3}


def test_fixed_vocabulary(spark):
    """Functions whose default terms the given tables don't hold."""
    r = spark.range(1).select(
        V.first_class(F.lit("需要登录"), V.ERROR_CLASSES, "degraded").alias("a"), V.first_class(F.lit("timeout"), V.ERROR_CLASSES, "degraded").alias("b"), V.confidence(F.lit("85%")).alias("c"), V.confidence(F.lit("none")).alias("d"),
        V.string_list(F.lit("a，b;  c、|")).alias("e"), V.url_policy(F.lit("http://192.168.1.9/x")).alias("f"), V.url_policy(F.lit("https://a.org:99999/")).alias("g"), V.personal_data(F.lit("手机号: x")).alias("h"),
        V.redact_log(F.lit("Authorization: Bearer abc C:\\\\a\\\\b.txt sk-12345678")).alias("i"), V.first_sentence(F.lit("短。港口今天停航。后文")).alias("j"), TB.joined_lines(F.lit("港口大雾停航，各船舶请注意航行安全与靠泊安排，以及\n后续通知情况请大家继续关注并转告相关人员，不得延误任何作业。\n标题")).alias("k"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == ("manual_only", "degraded", 0.85, None, ["a", "b", "c"], "local_address", "port", True)
    assert "sk-****" in r.i and "Bearer ****" in r.i and r.j == "港口今天停航。" and r.k.count("\n") == 1


def test_business_value_and_action(spark):
    rows = spark.createDataFrame([(1, "党支部参观码头", "", "企业动态"), (2, "台风停航", "党建", "港口作业"), (3, "港口物流", "", "企业动态"), (4, "散文", "", "其他")], "event_id long, title string, summary string, category string").withColumn("impact", F.lit(""))
    got = {r.event_id: r.x for r in rows.select("event_id", E.business_value(ValueLexicon()).alias("x")).collect()}
    assert [got[i].value for i in (1, 2, 3, 4)] == ["低", "高", "中", "无关"] and got[1].hits == "党支部、参观"
    act = E.suggested_action(Rules(), {n: n for n in ("resolved", "unverified", "high_risk", "high_opportunity", "medium_risk", "none")}, {"海上气象": "area"})
    table = spark.createDataFrame([("解除", "高", "高", "x"), ("待核实", "高", "低", "x"), ("新增", "高", "低", "海上气象"), ("新增", "低", "高", "x"), ("新增", "低", "低", "x")], "status string, risk_level string, opportunity_level string, category string")
    assert [r[0] for r in table.select(act).collect()] == ["resolved", "unverified", "area", "high_opportunity", "none"]


def test_edits_name_exactly_one_row(spark):
    table = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0"), (2, "c", "t0")], "k long, v string, at string")
    changes = spark.createDataFrame([(1, "update", "z", "t1"), (2, "delete", None, "t1"), (3, "insert", "n", "t1"), (4, "delete", None, "t1")], "k long, op string, v string, changed_at string")
    assert sorted(map(tuple, CH.edited(table, changes, "k", "at").collect())) == [(1, "z", "t1"), (2, "b", "t0"), (2, "c", "t0"), (3, "n", "t1")]
    assert sorted((r.k, r.n) for r in CH.refused_changes(table, changes, "k").collect()) == [(2, 2), (4, 0)]
