"""Commits of several tables, versioned upserts against a loop, promotions and transitions, and failures midway."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import upserts as U
from lodestone.sources.versioned import Conflict, TableSet

ARRIVALS = "document_id string, url string, title string, text string, fetched_at timestamp, quality_ok boolean"


def at(minute):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minute)


def test_commits_are_whole_numbered_and_idempotent(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path))
    assert tables.read("a") is None and tables.manifest()["number"] == 0
    assert tables.update(lambda held: {"a": spark.range(3), "b": spark.range(2)}, ("load", 0))
    assert not tables.update(lambda held: {"a": spark.range(9)}, ("load", 0))
    old = tables.manifest()
    assert tables.update(lambda held: {"a": held["a"].union(spark.range(1))}, ("load", 1))
    assert tables.read("a").count() == 4 and tables.read("a", old).count() == 3 and tables.read("b").count() == 2
    with pytest.raises(Conflict):  # a writer that read before the last commit
        tables.update(lambda held: {"a": spark.range(7)}, at=old)
    assert tables.read("a").count() == 4 and tables.vacuum() == 2 and tables.read("a").count() == 4 and tables.read("b").count() == 2


def test_a_write_that_fails_midway_leaves_the_old_state(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path))
    tables.update(lambda held: {"a": spark.range(3), "b": spark.range(2)})
    broken = spark.range(5).select(F.raise_error(F.lit("disk gone")).cast("long").alias("id"))
    with pytest.raises(Exception, match="disk gone"):
        tables.update(lambda held: {"a": spark.range(100), "b": broken}, ("run", 1))
    assert tables.read("a").count() == 3 and tables.read("b").count() == 2 and tables.manifest()["number"] == 1
    assert tables.update(lambda held: {"a": spark.range(100), "b": spark.range(1)}, ("run", 1))  # the retry
    assert tables.read("a").count() == 100


def plain(stored, arrivals):
    """What a loop over the batch does; content that was current before the batch or came earlier in it is a duplicate."""
    current = {d["hash"] for d in stored if d["is_current"]}
    out, rows = {}, [dict(d) for d in stored]
    for i, url, _, text, _, good in sorted(arrivals, key=lambda r: (r[4] is not None, r[4] or 0, r[0])):
        h = hashlib.sha256((text or "").strip().encode()).hexdigest()
        if h in current:
            out[i] = ("duplicate_content", None, "", False)
            continue
        current.add(h)
        before = [d for d in rows if url and d["url"] == url and d["is_current"]]
        for d in before:
            d["is_current"] = False
        version = before[-1]["version"] + 1 if before else 1
        rows.append({"id": i, "url": url or "", "hash": h, "version": version, "is_current": True, "state": "active" if good else "quarantined"})
        out[i] = ("new" if version == 1 else "updated", version, before[-1]["id"] if before else "", None)
    return rows, out


def test_upserts_equal_a_loop(spark, tmp_path):
    rng = random.Random(8)
    tables, stored, number = TableSet(spark, str(tmp_path)), [], 0
    tables.update(lambda held: {"evidence": spark.createDataFrame([("v1", "e1", "d0", "verified")], "evidence_id string, event_id string, document_id string, verification_status string")})
    for batch in range(3):
        rows = []
        for _ in range(40):
            rows.append((f"d{number}", rng.choice(["", None, *[f"https://a.org/{k}" for k in range(8)]]), "t", rng.choice([None, "", *[f"text {k}" for k in range(30)]]), rng.choice([None, at(rng.randrange(500))]), rng.random() < 0.7))
            number += 1
        docs = spark.createDataFrame(rows, ARRIVALS)
        disposed = {r.document_id: r for r in U.dispose(docs, tables.read("documents") if stored else spark.createDataFrame([], U.DOCUMENTS)).collect()}
        stored, want = plain(stored, rows)
        assert {i: (r.disposition, r.document_version, r.previous_document_id) for i, r in disposed.items()} == {i: w[:3] for i, w in want.items()}
        assert U.store_documents(tables, docs, ("feed", batch)) and not U.store_documents(tables, docs, ("feed", batch))
        got = {r.document_id: (r.url_key, r.content_hash, r.document_version, r.is_current, r.record_state) for r in tables.read("documents").collect()}
        assert got == {d["id"]: (d["url"], d["hash"], d["version"], d["is_current"], d["state"]) for d in stored}
    ledger = tables.read("ingested").groupBy("run").agg(F.sum("n").alias("n")).collect()
    assert {r.run: r.n for r in ledger} == {f"feed-{k}": 40 for k in range(3)}


def source_tables(spark, path):
    tables = TableSet(spark, str(path))
    docs = [("d1", "https://a.org/1", "", "one", "h1", at(1), 3, "d0", True, "ok", "active"), ("d0", "https://a.org/1", "", "old", "h0", at(0), 2, "", False, "ok", "active"), ("d2", "https://a.org/2", "", "two", "h2", at(1), 1, "", True, "failed", "quarantined")]
    tables.update(lambda held: {
        "documents": spark.createDataFrame(docs, U.DOCUMENTS),
        "events": spark.createDataFrame([("e1", "d1", True, True, True), ("e2", "d2", True, True, True), ("e3", "d1", True, True, True), ("e4", "gone", True, True, True)], "event_id string, document_id string, human_verified boolean, evidence_verified boolean, eligible_for_customer_report boolean"),
        "evidence": spark.createDataFrame([("v1", "e1", "d1", "verified"), ("v2", "e2", "d2", "verified")], "evidence_id string, event_id string, document_id string, verification_status string"),
        "chunks": spark.createDataFrame([("c1", "d1", "done"), ("c2", "d2", "done")], "chunk_id string, document_id string, embedding_status string"),
    })
    return tables


def test_promotion_is_all_or_nothing_and_once(spark, tmp_path):
    source, target = source_tables(spark, tmp_path / "qa"), TableSet(spark, str(tmp_path / "formal"))
    chosen = lambda *ids: spark.createDataFrame([(i,) for i in ids], "event_id string")
    reasons = spark.createDataFrame([("e1", ""), ("e2", "no_human"), ("e3", "")], "event_id string, reasons string")
    blocked = {r.event_id: r.blocked for r in U.promote(source, target, chosen("e1", "e2", "e4"), reasons, "r1").collect()}
    assert blocked == {"e1": None, "e2": "no_human", "e4": "document_missing"} and target.manifest()["number"] == 0
    U.promote(source, target, chosen("e1", "e3", "e1"), reasons, "r1")
    assert [tuple(r) for r in target.read("documents").select("document_id", "document_version", "previous_document_id").collect()] == [("d1", 1, "")]
    assert {r.event_id: r.eligible_for_customer_report for r in target.read("events").collect()} == {"e1": False, "e3": False}
    assert [r.embedding_status for r in target.read("chunks").collect()] == ["pending"] and target.read("evidence").count() == 1 and target.read("promotions").count() == 2
    again = {r.event_id: r.blocked for r in U.promote(source, target, chosen("e1"), reasons, "r1").collect()}
    assert again == {"e1": "already_promoted"} and target.manifest()["number"] == 1
    assert {r.blocked for r in U.promote(source, target, chosen("e3"), reasons, "r2").collect()} == {"known_document"}


def test_transition_rechecks_and_resets(spark, tmp_path):
    tables = source_tables(spark, tmp_path)
    chosen = lambda *ids: spark.createDataFrame([(i,) for i in ids], "document_id string")
    live = spark.createDataFrame([("d2", "ok", True)], "document_id string, new_status string, processing_allowed boolean")
    fails = spark.createDataFrame([("d2", "report_failed", True)], live.schema)
    assert {r.document_id: r.blocked for r in U.confirm_transition(tables, chosen("d1", "d2"), live, "me", "2026-01-01").collect()} == {"d1": "not_quarantined", "d2": None}
    assert [r.blocked for r in U.confirm_transition(tables, chosen("d2"), fails, "me", "2026-01-01").collect()] == ["fails_again"] and tables.manifest()["number"] == 1
    U.confirm_transition(tables, chosen("d2"), live, "me", "2026-01-01")
    assert {r.document_id: (r.record_state, r.quality_status) for r in tables.read("documents").where("is_current").collect()} == {"d1": ("active", "ok"), "d2": ("active", "ok")}
    assert {r.event_id: r.human_verified for r in tables.read("events").collect()} == {"e1": True, "e2": False, "e3": True, "e4": True}
    assert {r.evidence_id: r.verification_status for r in tables.read("evidence").collect()} == {"v1": "verified", "v2": "pending"}
    assert [(r.document_id, r.previous_state, r.previous_quality, r.confirmed_by) for r in tables.read("reevaluations").collect()] == [("d2", "quarantined", "failed", "me")]
    assert [r.blocked for r in U.confirm_transition(tables, chosen("d2"), live, "me", "2026-01-02").collect()] == ["not_quarantined"]
    assert U.confirm_transition(tables, chosen(), live, "me", "2026-01-02").collect() == []
