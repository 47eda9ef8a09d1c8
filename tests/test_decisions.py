from lodestone.operators import decisions as D


def test_decisions_with_nulls_and_refusals(spark):
    schema = "decision string, status string, new_status string, duplicate_level string, related_event_id string, source_opened boolean, facts_checked boolean"
    rows = [
        ("accept_modified", "a", " a ", None, None, True, True),
        ("accept_modified", "a", D.RESOLVED, D.DUPLICATE, None, None, False),
        ("accept_modified", "a", "", None, None, True, True),
        ("reject", None, None, D.DUPLICATE, None, None, None),
        (None, "a", None, None, None, None, None),
        ("other", "a", "b", None, None, True, True),
    ]
    got = [(r.changed, r.review_state, r.record_state, r.human_verified, r.refusals) for r in D.decided(spark.createDataFrame(rows, schema), ["status"]).collect()]
    assert got == [
        ([], "accepted", "active", True, []),
        (["status"], "modified_accepted", "active", True, ["duplicate", "no_related_event", "source_not_opened", "facts_not_checked"]),
        (["status"], "modified_accepted", "active", True, []),
        ([], "rejected", "rejected", False, []),
        ([], None, "active", False, []),
        (["status"], None, "active", False, []),
    ]


def test_phase_gate_takes_the_latest_active_run(spark):
    rows = [("a", 1, 9, 9, True), ("a", 2, 4, 1, None), ("b", 1, 4, 2, True), ("c", 5, 4, 4, False), ("d", 1, None, None, True), ("d", 1, 2, 2, True)]
    runs = spark.createDataFrame(rows, "source string, at int, discovered int, success int, active boolean")
    assert {r.source: r.passed for r in D.phase_gate(runs, "source", "at").collect()} == {"a": False, "b": True, "d": True}
    assert D.phase_gate(runs.where("false"), "source", "at").count() == 0


def test_candidates_are_not_repeated(spark):
    events = spark.createDataFrame([(1, 1, "active", "2026-01-05"), (2, 1, "active", None), (3, 2, "active", "2026-01-05"), (4, 1, None, "2026-01-05")], "event_id int, document_id int, record_state string, event_date string")
    documents = spark.createDataFrame([(1, "active", True, "ok"), (1, "active", True, "ok"), (2, "active", None, "ok")], "document_id int, record_state string, is_current boolean, quality_status string")
    events = events.withColumn("event_date", events.event_date.cast("date"))
    assert [r.event_id for r in D.period_candidates(events, documents, "2026-01-05", "2026-01-05", "ok").collect()] == [1]
