"""Decisions of reviewers and gates on what they decided: states, provenance, candidates of a period, phases, retrieval tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The state of a review by its decision, and the states of records that aren't active.
REVIEW_STATES = {"accept": "accepted", "accept_modified": "modified_accepted", "reject": "rejected", "body_issue": "body_issue", "needs_second_review": "needs_second_review"}
RECORD_STATES = {"reject": "rejected", "body_issue": "quarantined"}
DUPLICATE, RESOLVED = "高度疑似重复", "解除"


def _text(x: Column) -> Column:
    return F.trim(F.coalesce(x.cast("string"), F.lit("")))


def _chosen(x: Column, values: dict[str, str], other: Column) -> Column:
    for name, value in values.items():
        other = F.when(x == name, value).otherwise(other)
    return other


def by_independent_people(kind: Column, name: Column, at: Column, method: Column, people: list[str]) -> Column:
    """True where a review counts as one by people: of a given kind, with a name, a time and a method; null counts as empty."""
    return F.coalesce(kind, F.lit("")).isin(people) & (_text(name) != "") & (_text(at) != "") & (_text(method) != "")


def retrieval_tier(is_event: Column, human_verified: Column, evidence_verified: Column) -> Column:
    """How well a hit is backed; null flags count as false."""
    event, person, evidence = (F.coalesce(x, F.lit(False)) for x in (is_event, human_verified, evidence_verified))
    return F.when(event & evidence & person, "human_verified_event").when(event & evidence, "evidence_verified_event").otherwise("quality_document_chunk")


def period_candidates(events: DataFrame, documents: DataFrame, start: str, end: str, passed: str) -> DataFrame:
    """(event_id, event_date) of the active events of [start, end] whose document is active, current and of the quality `passed`.

    Events are filtered before the join, a semi-join: a document that stands twice doesn't repeat its events. Null dates and states are out.
    """
    good = documents.where((F.col("record_state") == "active") & F.col("is_current") & (F.col("quality_status") == passed)).select("document_id")
    rows = events.where((F.col("record_state") == "active") & F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.join(good, "document_id", "left_semi").select("event_id", "event_date")


def decided(reviews: DataFrame, fields: list[str], edit: str = "new_") -> DataFrame:
    """reviews with what their decision makes of them: changed, review_state, record_state, human_verified, requires_second_review, refusals.

    The edit of a field is the column edit + field: null leaves the field, an empty one clears it. accept_modified without a changed
    field is accept. refusals lists why an acceptance can't stand: a duplicate, a resolved event without a related one, a source
    that wasn't opened, facts that weren't checked. Unknown and null decisions have a null review_state and leave the record active.
    """
    after = {f: F.when(F.col(edit + f).isNotNull(), _text(F.col(edit + f))).otherwise(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields}
    changed = F.array_compact(F.array(*[F.when(after[f] != F.coalesce(F.col(f).cast("string"), F.lit("")), f) for f in fields]))
    decision = F.when((F.col("decision") == "accept_modified") & (F.size(changed) == 0), "accept").otherwise(F.col("decision"))
    accepted = F.coalesce(decision.isin("accept", "accept_modified"), F.lit(False))
    now = lambda f: after.get(f, F.coalesce(F.col(f).cast("string"), F.lit("")))
    why = {
        "duplicate": now("duplicate_level") == DUPLICATE,
        "no_related_event": (now("status") == RESOLVED) & (now("related_event_id") == ""),
        "source_not_opened": ~F.coalesce("source_opened", F.lit(False)),
        "facts_not_checked": ~F.coalesce("facts_checked", F.lit(False)),
    }
    return reviews.withColumns({
        "changed": changed,
        "review_state": _chosen(decision, REVIEW_STATES, F.lit(None).cast("string")),
        "record_state": _chosen(decision, RECORD_STATES, F.lit("active")),
        "human_verified": accepted,
        "requires_second_review": F.coalesce(decision == "needs_second_review", F.lit(False)),
        "refusals": F.array_compact(F.array(*[F.when(accepted & test, name) for name, test in why.items()])),
    })


def phase_gate(runs: DataFrame, source: str, at: str, share: float = 0.5) -> DataFrame:
    """(source, discovered, success, passed) of the latest run of each source, if that run was active.

    A source passes when it discovered something and at least `share` of it succeeded; null counts are 0, a null active is true.
    Of runs at the same time the one with the greatest counts is taken. An aggregate, no window: a source with many runs moves one row a task.
    """
    last = F.max(F.struct(at, F.coalesce("discovered", F.lit(0)).alias("discovered"), F.coalesce("success", F.lit(0)).alias("success"), F.coalesce("active", F.lit(True)).alias("active")))
    rows = runs.groupBy(source).agg(last.alias("x")).select(source, "x.*").where("active")
    return rows.select(source, "discovered", "success", ((F.col("discovered") > 0) & (F.col("success") >= share * F.col("discovered"))).alias("passed"))
