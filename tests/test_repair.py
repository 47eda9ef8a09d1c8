"""Candidates of quotes against every span, and the classes of failed quotes."""

import difflib
import random

from pyspark.sql import functions as F

from lodestone.operators import repair as R

TEXT = "黄海中部今天有大风。请船舶注意避让！\n港口作业将于明日恢复；泊位安排另行通知。\n\n  last line without a mark  \nab"


def every(quote, text):
    found, seen = [], set()
    for a, b, t in [*[(m.start() + m[0].index(m[0].strip()), 0, m[0].strip()) for m in R.SENTENCE.finditer(text) if len(m[0].strip()) >= 4], *[(m.start(), m.end(), m[0].strip()) for m in R.PARAGRAPH.finditer(text) if m[0].strip()]]:
        b = b or a + len(t)
        if (a, b) not in seen:
            seen.add((a, b))
            found.append((a, b, round(difflib.SequenceMatcher(None, quote, t).ratio(), 4), t))
    return sorted(found, key=lambda x: -x[2])


def test_candidates_equal_all_spans(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["port", "storm", "fog", "berth", "a", "line", "大风", "；", "。"])
    texts = {i: "\n".join(" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 12))) for i in range(20)} | {20: None, 21: "", 22: "same line here\n" * 9}
    quotes = [(k, rng.randrange(23), rng.choice([None, "", " ", *[" ".join(word() for _ in range(rng.randrange(1, 12)))] * 5])) for k in range(80)] + [(900, 99, "x")]
    got = {}
    for r in R.candidates(spark.createDataFrame(quotes, "quote_id long, document_id long, quote string"), spark.createDataFrame(list(texts.items()), "document_id long, text string")).collect():
        got.setdefault(r.quote_id, []).append((r["rank"], r.start_offset, r.end_offset, r.similarity, r.text))
    for k, d, q in quotes:
        want = every(q.strip(), texts.get(d) or "")[:3] if q and q.strip() and d in texts else []
        assert sorted(got.get(k, [])) == [(n, *x) for n, x in enumerate(want, 1)]


def test_reasons_pieces_and_refresh(spark):
    quotes = {1: "黄海中部今天有大风，请船舶注意避让！", 2: "港口作业将恢复", 3: "请船舶注意避让。黄海中部今天有大风；", 4: "无关的句子在这里没有出处", 5: "黄海中南部今天有大风。", 6: "请 船舶注意避让！ 港口作业将于明日恢复", 7: None}
    evidence = spark.createDataFrame([(k, f"e{k}", "d", q, None if k == 4 else "pending") for k, q in quotes.items()] + [(8, "e1", "d", "x", "verified"), (9, "e1", "gone", "x", "pending"), (10, "gone", "d", "x", "pending")], "evidence_id long, event_id string, document_id string, quote_text string, verification_status string")
    docs = spark.createDataFrame([("d", TEXT)], "document_id string, text string")
    events = spark.createDataFrame([(f"e{k}", "t") for k in range(1, 8)], "event_id string, title string")
    rows = R.issues(evidence, docs, events)
    got = {r.evidence_id: r for r in rows.collect()}
    assert {k: r.reason for k, r in got.items() if k not in (1, 6)} == {2: "rewritten", 3: "rewritten", 4: "none", 5: "meaning_change", 7: "none"}
    assert got[1].reason in ("close", "rewritten") and got[5].action == "extract_again" and got[2].action == "choose_candidate"
    assert [TEXT[a:b] for a, b in got[3].pieces] == ["请船舶注意避让", "黄海中部今天有大风"] and got[4].pieces == []
    fresh = {r.evidence_id: r for r in R.refreshed(R.refreshed(evidence, rows), rows).collect()}
    assert len(fresh) == 10 and fresh[8].repair_status is None and (fresh[7].candidate_start_offset, fresh[7].candidate_text) == (-1, "") and fresh[2].candidate_text == TEXT[fresh[2].candidate_start_offset : fresh[2].candidate_end_offset]
    assert R.issues(evidence.where(F.lit(False)), docs, events).collect() == []
