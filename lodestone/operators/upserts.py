"""Whole changes of several tables: versioned document upserts, promotions with lineage, quality transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.versioned import TableSet

#: Columns of the stored documents.
DOCUMENTS = "document_id string, url_key string, title string, cleaned_text string, content_hash string, fetched_at timestamp, document_version int, previous_document_id string, is_current boolean, quality_status string, record_state string"


def dispose(arrivals: DataFrame, stored: DataFrame) -> DataFrame:
    """arrivals with content_hash, url_key, disposition, document_version, previous_document_id and is_current.

    arrivals: (document_id, url, title, text, fetched_at, quality_ok); stored: DOCUMENTS. A content that is current, or that an earlier arrival
    (by fetched_at, then document_id) brings, is duplicate_content; other arrivals of a URL are its next versions in order: new where it has none, else
    updated. The last version is current. Arrivals without a URL are new each. Null texts count as empty; null times come first.
    """
    order = ["fetched_at", "document_id"]
    keyed = arrivals.withColumns({"url_key": T.normalize_url(F.coalesce("url", F.lit(""))), "cleaned_text": F.coalesce("text", F.lit("")), "content_hash": T.content_hash(F.col("text"))})
    current = stored.where("is_current")
    held = current.select("content_hash").distinct().withColumn("held", F.lit(True))
    first = keyed.groupBy("content_hash").agg(F.min(F.struct(*order)).alias("first"))  # a content may be that of a third of all arrivals
    seen = keyed.join(held, "content_hash", "left").join(first, "content_hash")
    double = F.coalesce(F.col("held"), F.lit(False)) | ~F.col("first").eqNullSafe(F.struct(*order))
    last = current.where("url_key <> ''").groupBy("url_key").agg(F.max(F.struct("document_version", "document_id")).alias("last"))
    fresh = seen.withColumn("double", double).join(last, "url_key", "left")
    chain = F.when(F.col("url_key") == "", F.col("document_id")).otherwise(F.col("url_key"))
    by_url = Window.partitionBy("double", chain).orderBy(*order)
    version = F.coalesce(F.col("last.document_version"), F.lit(0)) + F.row_number().over(by_url)
    before = F.coalesce(F.lag("document_id").over(by_url), F.col("last.document_id"), F.lit(""))
    after = F.lead("document_id").over(by_url)
    out = fresh.withColumns({"document_version": F.when(~F.col("double"), version).cast("int"), "previous_document_id": F.when(F.col("double"), "").otherwise(before), "is_current": ~F.col("double") & after.isNull()})
    return out.withColumn("disposition", F.when(F.col("double"), "duplicate_content").when(F.col("document_version") == 1, "new").otherwise("updated")).drop("held", "first", "double", "last")


def upserted(stored: DataFrame, disposed: DataFrame) -> DataFrame:
    """The stored documents with what dispose() lets in; a document whose URL has a newer version isn't current any more, and bad quality is quarantined."""
    fresh = disposed.where("disposition <> 'duplicate_content'")
    replaced = fresh.where("url_key <> ''").select("url_key").distinct().withColumn("newer", F.lit(True))
    old = stored.join(replaced, "url_key", "left").withColumn("is_current", F.col("is_current") & F.col("newer").isNull()).drop("newer")
    good = F.coalesce(F.col("quality_ok"), F.lit(False))
    rows = fresh.withColumns({"quality_status": F.when(good, "ok").otherwise("failed"), "record_state": F.when(good, "active").otherwise("quarantined")})
    names = stored.columns
    return old.select(*names).unionByName(rows.select(*names))


def store_documents(tables: TableSet, arrivals: DataFrame, run: tuple[str, int] | None = None) -> bool:
    """Upsert arrivals into the table `documents`, set the evidence of superseded documents to version_mismatch and add to the ledger `ingested` (run, disposition, n), in one commit. False if the run has been."""
    spark = arrivals.sparkSession

    def change(held: dict[str, DataFrame]) -> dict[str, DataFrame]:
        stored = held.get("documents", spark.createDataFrame([], DOCUMENTS))
        disposed = dispose(arrivals, stored)
        ledger = disposed.groupBy("disposition").agg(F.count("*").alias("n")).select(F.lit(f"{run[0]}-{run[1]}" if run else "").alias("run"), "disposition", "n")
        out = {"documents": upserted(stored, disposed), "ingested": ledger if "ingested" not in held else held["ingested"].unionByName(ledger)}
        if "evidence" in held:
            gone = stored.where("is_current").join(disposed.where("disposition = 'updated' AND url_key <> ''").select("url_key").distinct(), "url_key", "left_semi").select("document_id", F.lit(True).alias("gone"))
            state = F.when(F.col("gone"), "version_mismatch").otherwise(F.col("verification_status"))
            out["evidence"] = held["evidence"].join(gone, "document_id", "left").withColumn("verification_status", state).select(*held["evidence"].columns)
        return out

    return tables.update(change, run)


def promotion_plan(chosen: DataFrame, source: dict[str, DataFrame], target: dict[str, DataFrame], reasons: DataFrame, run: str) -> DataFrame:
    """(event_id, document_id, blocked) of the chosen events: the first of gate reasons, already promoted, URL or content known, id taken, or document missing; null if none.

    chosen: (event_id); source: events (event_id, document_id, ...), documents (DOCUMENTS); target: documents and, if there was a promotion, promotions
    (run, source_event_id, ...); reasons: (event_id, reasons), '' where the gate holds. Repeated choices count once.
    """
    docs = source["documents"].where("is_current").select("document_id", "url_key", "content_hash", F.lit(True).alias("there"))
    rows = chosen.select("event_id").distinct().join(source["events"].select("event_id", "document_id"), "event_id", "left").join(docs, "document_id", "left").join(reasons, "event_id", "left")
    marked = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    current = target["documents"].where("is_current")
    rows = rows.join(marked(current.where("url_key <> ''"), "url_key", "same_url"), "url_key", "left").join(marked(current, "content_hash", "same_text"), "content_hash", "left").join(marked(target["documents"], "document_id", "taken"), "document_id", "left")
    done = target["promotions"].where(F.col("run") == run).select(F.col("source_event_id").alias("event_id")) if target.get("promotions") is not None else chosen.select("event_id").limit(0)
    rows = rows.join(marked(done, "event_id", "done"), "event_id", "left")
    reason = (
        F.when(F.col("there").isNull(), "document_missing").when(F.coalesce("reasons", F.lit("")) != "", F.col("reasons")).when(F.col("done"), "already_promoted")
        .when(F.col("same_url") | F.col("same_text"), "known_document").when(F.col("taken"), "id_taken")
    )
    return rows.select("event_id", "document_id", reason.alias("blocked"))


def promote(source: TableSet, target: TableSet, chosen: DataFrame, reasons: DataFrame, run: str) -> DataFrame:
    """Copy the chosen events with their documents, evidence and chunks into the target in one commit, if none is blocked; the plan either way.

    Chunks wait for embedding again, documents start their chain anew, events lose their eligibility for customers, and `promotions` keeps (run, source_event_id,
    source_document_id, from_commit). An event whose document another chosen event has too brings it once.
    """
    at, seen = source.manifest(), target.manifest()
    mine = {n: source.read(n, at) for n in at["tables"]}
    theirs = {n: target.read(n, seen) for n in seen["tables"]}
    if "documents" not in theirs:
        theirs["documents"] = mine["documents"].limit(0)
    plan = promotion_plan(chosen, mine, theirs, reasons, run)
    if plan.isEmpty() or not plan.where("blocked IS NOT NULL").isEmpty():
        return plan

    def change(held: dict[str, DataFrame]) -> dict[str, DataFrame]:
        events, docs = plan.select("event_id").distinct(), plan.select("document_id").distinct()
        copies = {
            "documents": mine["documents"].where("is_current").join(docs, "document_id", "left_semi").withColumns({"document_version": F.lit(1), "previous_document_id": F.lit("")}),
            "events": mine["events"].join(events, "event_id", "left_semi").withColumn("eligible_for_customer_report", F.lit(False)),
            "promotions": plan.select(F.lit(run).alias("run"), F.col("event_id").alias("source_event_id"), F.col("document_id").alias("source_document_id"), F.lit(at["number"]).alias("from_commit")),
        }
        if "evidence" in mine:
            copies["evidence"] = mine["evidence"].join(events, "event_id", "left_semi")
        if "chunks" in mine:
            copies["chunks"] = mine["chunks"].join(docs, "document_id", "left_semi").withColumn("embedding_status", F.lit("pending"))
        return {n: held[n].unionByName(t) if n in held else t for n, t in copies.items()}

    target.update(change, at=seen)
    return plan


def confirm_transition(tables: TableSet, chosen: DataFrame, live: DataFrame, by: str, at: str) -> DataFrame:
    """Move chosen quarantined documents that pass when assessed again to review, in one commit; (document_id, blocked) of the chosen ones.

    live: (document_id, new_status, processing_allowed) as reevaluate() gives it now. Any document that isn't quarantined and current, or doesn't pass in full,
    blocks all. The evidence of their events is pending again, the events lose verification and eligibility and aren't restored; `reevaluations`
    keeps what each was, by whom and when.
    """
    seen = tables.manifest()
    documents = tables.read("documents", seen)
    fits = documents.where("is_current AND record_state = 'quarantined'").select("document_id", F.lit(True).alias("waits"))
    passes = live.where("processing_allowed AND new_status = 'ok'").select("document_id", F.lit(True).alias("passes"))
    plan = chosen.select("document_id").distinct().join(fits, "document_id", "left").join(passes, "document_id", "left")
    plan = plan.select("document_id", F.when(F.col("waits").isNull(), "not_quarantined").when(F.col("passes").isNull(), "fails_again").alias("blocked"))
    if plan.isEmpty() or not plan.where("blocked IS NOT NULL").isEmpty():
        return plan

    def change(held: dict[str, DataFrame]) -> dict[str, DataFrame]:
        mark = plan.select("document_id", F.lit(True).alias("moved"))
        reset = lambda df, key, marks, values: df.join(marks, key, "left").select(*[F.when(F.col("moved"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])
        out = {"documents": reset(held["documents"], "document_id", mark, {"quality_status": F.lit("ok"), "record_state": F.lit("active")})}
        if "events" in held:
            flags = [c for c in ("human_verified", "evidence_verified", "eligible_for_customer_report", "active_for_internal_use") if c in held["events"].columns]
            out["events"] = reset(held["events"], "document_id", mark, {c: F.lit(False) for c in flags})
            if "evidence" in held:
                theirs = held["events"].join(mark, "document_id", "left_semi").select("event_id").distinct().withColumn("moved", F.lit(True))
                out["evidence"] = reset(held["evidence"], "event_id", theirs, {"verification_status": F.lit("pending")})
        was = held["documents"].join(mark, "document_id", "left_semi").where("is_current")
        entry = was.select("document_id", F.col("record_state").alias("previous_state"), F.col("quality_status").alias("previous_quality"), F.lit(by).alias("confirmed_by"), F.lit(at).cast("timestamp").alias("confirmed_at"))
        out["reevaluations"] = held["reevaluations"].unionByName(entry) if "reevaluations" in held else entry
        return out

    tables.update(change, at=seen)
    return plan
