"""The quality gate's every issue, fact slots, near templates against all pairs, re-evaluation."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import quality as Q
from lodestone.operators import templates as P

SENTENCE = "港口今日发布作业通知，相关泊位将于明日恢复装卸作业并安排船舶进港。"


def assessed(spark, **change):
    row = {"doc_id": 1, "title": "港口作业通知", "text": "\n".join([SENTENCE] * 3), "published_at": "2026-01-05", **change}
    kinds = {"doc_id": "long", "template_similarity": "double", "facts_differ": "boolean", "html_paragraphs": "int"}
    return Q.assess(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row)), sites=("某港官方网站",)).first()


@pytest.mark.parametrize("change, issues, status", [
    ({}, "", "ok"),
    ({"text": "短"}, "thin_body", "body_failed"),
    ({"text": None}, "thin_body", "body_failed"),
    ({"text": "公告附件一.pdf 公告附件二.docx 以及其他需要下载的文件列表说明如下所示请下载附件查看更多文件列表的说明以及下载说明和更多内容说明如下所示"}, "attachments_only", "body_failed"),
    ({"text": SENTENCE * 3 + "返回顶部" * 3}, "navigation_noise", "body_failed"),
    ({"text": SENTENCE * 2 + "-=*#" * 40}, "low_density", "body_failed"),
    ({"title": "网站 首页"}, "generic_title", "report_failed"),
    ({"title": "某港官方网站"}, "generic_title", "report_failed"),
    ({"title": "某某港集团官网"}, "generic_title", "report_failed"),
    ({"title": None, "published_at": None}, "generic_title,date_missing", "report_failed"),
    ({"published_at": "20260105"}, "date_missing", "report_failed"),
    ({"text": SENTENCE * 3 + "�"}, "encoding_anomaly", "encoding_anomaly"),
    ({"template_similarity": 0.9}, "near_template", "body_failed"),
])
def test_each_issue(spark, change, issues, status):
    got = assessed(spark, **change)
    assert (got.issues, got.status) == (issues, status)
    assert got.processing_allowed == (status in ("ok", "report_failed")) and got.report_allowed == (status == "ok")


NOTICE = "海上大风黄色预警 第12期\n2026年1月5日10时发布，预计今天夜间到明天白天，渤海海峡有阵风7到8级，请过往船舶注意避让。\n" + "\n".join([SENTENCE] * 4)


def test_facts_and_the_exception_for_notices(spark):
    facts = spark.range(1).select(Q.structured_facts(F.lit("预警"), F.lit(NOTICE)).alias("f")).first().f
    assert facts == {"issue_number": "12", "published_time": "2026年1月5日10时", "risk_level": "黄色", "area": "渤海海峡", "weather_metric": "阵风7到8级", "valid_time": "今天夜间到明天白天", "lifecycle": "发布"}
    assert spark.range(1).select(Q.structured_facts(F.lit("t"), F.lit("第12期")).alias("f")).first().f == {}
    passes = assessed(spark, text=NOTICE, template_similarity=0.95, facts_differ=True)
    assert (passes.issues, passes.template_similarity_warning) == ("", 1) and passes.structured_fact_count >= 4
    assert assessed(spark, text=NOTICE, template_similarity=0.95, facts_differ=False).issues == "near_template"


def test_facts_differ_as_all_pairs_say(spark):
    texts = [("a", "t", NOTICE), ("a", "t", NOTICE.replace("第12期", "第13期")), ("a", "第12期", "plain text"), ("b", "t", NOTICE), ("b", "t", NOTICE), ("b", "t", "plain"), ("c", "t", "only one"), ("d", "t", ""), ("d", "t", None), (None, "t", NOTICE), ("e", "第99期", NOTICE), ("e", "t", "plain")]
    rows = [(i, *r) for i, r in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, title string, text string")
    facts = {r.doc_id: (r.own, r.line) for r in docs.select("doc_id", Q.fact_line(Q.structured_facts(F.col("title"), F.col("text"))).alias("own"), Q.fact_line(Q.structured_facts(F.lit(""), F.col("text"))).alias("line")).collect()}
    got = {r.doc_id: r.facts_differ for r in Q.with_siblings(docs, spark.createDataFrame([], "doc_id long, similarity double")).collect()}
    for i, source, _, _ in rows:
        others = [(j, t) for j, s, _, t in rows if j != i and (s or "") == (source or "") and (t or "").strip()]
        assert got[i] == (not others or any(facts[j][1] and facts[j][1] != facts[i][0] for j, _ in others)), i


def test_block_ratio_is_the_share_of_matching_blocks():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(50)))
        b = "".join(rng.choice("abcd") if rng.random() < 0.2 else c for c in a)[rng.randrange(4) :]
        ratio = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert P.block_ratio(a, b) == pytest.approx(ratio) and 2 * P.common_length(a, b) >= ratio * (len(a) + len(b)) - 1e-9


def test_near_templates_equal_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    rows = []
    for group in (1,) * 12 + (2, 3, 25):  # a large group of near copies
        base = [word() for _ in range(60)]
        for _ in range(group):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(60)] = word()
            rows.append((len(rows), f"s{len(rows) % 2 if group < 9 else 0}", " ".join(w)))
    rows += [(900, "s0", rows[-1][2]), (901, "s0", rows[-1][2].replace(" ", "\n")), (902, "s0", None), (903, "s0", "short"), (904, None, rows[-1][2]), (905, None, rows[-1][2] + "x"), rows[3]]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, body string")
    got = P.template_similarity(docs).collect()
    body = {i: re.sub(r"\s+", "", t or "")[:6000] for i, _, t in rows}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    want = {i for i, s, _ in rows for j, o, _ in rows if (s or "") == (o or "") and body[i] != body[j] and min(len(body[i]), len(body[j])) >= 120 and ratio(body[i], body[j]) >= 0.88}
    assert {r.doc_id for r in got} == want and len(want) > 25
    assert all(r.similarity == pytest.approx(ratio(body[r.doc_id], body[r.sibling_id])) for r in got)


def test_reevaluation_of_quarantined_near_templates(spark):
    other = NOTICE.replace("第12期", "第13期")
    rows = [(1, "a", "预警", NOTICE, "2026-01-05", "quarantined", 0.97), (2, "a", "预警", other, "2026-01-06", "active", 0.97), (3, "a", "预警", "短", "2026-01-06", "quarantined", 0.9), (4, "a", "预警", NOTICE, "2026-01-05", "quarantined", 0.5), (5, "a", "预警", NOTICE, "2026-01-05", "quarantined", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, title string, text string, published_at string, record_state string, old_similarity double")
    near = spark.createDataFrame([(1, 0.97), (2, 0.97)], "doc_id long, similarity double")
    found = Q.reevaluate(docs, near)
    assert {(r.doc_id, r.new_status, r.processing_allowed, r.template_similarity_warning) for r in found.collect()} == {(1, "ok", True, 1), (3, "body_failed", False, 0)}
    assert tuple(Q.reevaluated(found).first()) == (2, 1, 1)
    assert tuple(Q.reevaluated(found.where("false")).first()) == (0, 0, 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, title string, text string, published_at string")
    assert P.template_similarity(docs).collect() == [] and Q.assess(docs).collect() == []


def test_issues_are_counted_without_a_second_assessment(spark):
    docs = spark.createDataFrame([(1, "港口作业通知", "\n".join([SENTENCE] * 3), "2026-01-05"), (2, None, "短", None), (3, "首页", "短", "2026-01-05")], "doc_id long, title string, text string, published_at string")
    counts = Q.issue_counts(Q.assess(docs))
    assert {(r.issue, r.n) for r in counts.collect()} == {("thin_body", 2), ("generic_title", 2), ("date_missing", 1)}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("encoding_anomaly") == 1


def test_strip_takes_the_white_space_of_the_pattern(spark):
    every = spark.range(0x10000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    wrong = every.where("length(c) = 1").where((Q.T.strip(F.col("c")) == "") != F.col("c").rlike(r"^(?U)\s$")).count()
    assert wrong == 0 and spark.range(1).select(Q.T.strip(F.lit("　 a b \n"))).first()[0] == "a b"
