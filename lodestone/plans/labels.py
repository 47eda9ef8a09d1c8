"""Queries over label sheets, templates of sources, changed pages and excerpts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import labels as L
from .catalog import _quote, _read, query

_STATES = [*L.STATES, "new"]
_STATE_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {_quote(s)}" for i, s in enumerate(_STATES)) + " END"
_SHOWN_SQL = "CASE " + " ".join(f"WHEN state = {_quote(s)} THEN {_quote(t)}" for s, t in L.STATES.items()) + f" ELSE {_quote(L.UNREVIEWED)} END"


@query(f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'model' ELSE 'human' END AS reviewer, {_STATE_SQL} AS state FROM labels)
SELECT doc_id, CASE WHEN reviewer = 'human' THEN {_SHOWN_SQL} ELSE {_quote(L.UNREVIEWED)} END AS shown FROM x""")
def review_queue(spark, sf_dir):
    reviewer = F.expr("CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'model' ELSE 'human' END")
    return _read(spark, sf_dir, "labels").select("doc_id", L.review_queue_status(reviewer, F.expr(_STATE_SQL), ["human"]).alias("shown"))


@query("""SELECT l.doc_id AS document_id, l.quality, d.source AS source, e.page_id AS event_id FROM labels l
LEFT JOIN (SELECT doc_id, min(source) AS source FROM documents WHERE doc_id % 5 <> 0 GROUP BY doc_id) d ON d.doc_id = l.doc_id
LEFT JOIN (SELECT page_id // 2 AS doc_id, min(page_id) AS page_id FROM pages WHERE page_id % 3 <> 0 GROUP BY page_id // 2) e ON e.doc_id = l.doc_id""")
def label_records(spark, sf_dir):
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), "quality")
    documents = _read(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("document_id"), "source")
    events = _read(spark, sf_dir, "pages").where("page_id % 3 <> 0").select(F.expr("page_id div 2").alias("document_id"), "page_id")
    return L.label_context(labels, documents, events).select("document_id", "quality", "document.source", F.col("event.page_id").alias("event_id"))


@query("""WITH m AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey::VARCHAR END AS nation FROM supplier WHERE s_suppkey % 5 <> 0),
t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS name, s_nationkey::VARCHAR AS nation FROM supplier WHERE s_suppkey % 7 <> 0),
b AS (SELECT coalesce(m.s_suppkey, t.s_suppkey) AS s_suppkey, nullif(trim(m.name), '') AS mn, nullif(trim(t.name), '') AS tn, nullif(trim(m.nation), '') AS ma, nullif(trim(t.nation), '') AS ta, m.s_suppkey IS NULL AS fresh FROM m FULL JOIN t ON m.s_suppkey = t.s_suppkey)
SELECT s_suppkey, coalesce(mn, tn) AS name, coalesce(ma, ta) AS nation, CASE WHEN fresh THEN 'template' ELSE 'current' END AS origin,
concat_ws(',', CASE WHEN mn IS NULL AND tn IS NOT NULL THEN 'name' END, CASE WHEN ma IS NULL AND ta IS NOT NULL THEN 'nation' END) AS added,
concat_ws(',', CASE WHEN mn <> tn THEN 'name' END, CASE WHEN ma <> ta THEN 'nation' END) AS conflicting FROM b""")
def template_sync(spark, sf_dir):
    supplier = _read(spark, sf_dir, "supplier").withColumn("nation", F.col("s_nationkey").cast("string"))
    current = supplier.where("s_suppkey % 5 <> 0").select("s_suppkey", F.expr("CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE s_name END AS name"), F.expr("CASE WHEN s_suppkey % 4 <> 0 THEN nation END AS nation"))
    template = supplier.where("s_suppkey % 7 <> 0").select("s_suppkey", F.expr("CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS name"), "nation")
    out = L.filled_from_template(current, template, "s_suppkey", ["name", "nation"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("added", "conflicting")})


@query("""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS c, string_split(coalesce(lag(text) OVER (PARTITION BY source, doc_id // 8 ORDER BY doc_id), ''), chr(10)) AS p FROM documents),
x AS (SELECT doc_id, list_transform(list_filter(p, lambda x, i: list_position(p, x) = i AND NOT list_contains(c, x)), lambda x: '-' || x) AS gone, list_transform(list_filter(c, lambda x, i: list_position(c, x) = i AND NOT list_contains(p, x)), lambda x: '+' || x) AS came FROM d)
SELECT doc_id, md5(array_to_string(list_concat(gone, came)[1:12], chr(10))) AS changes_md5 FROM x""")
def text_changes(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("source", F.expr("doc_id div 8")).orderBy("doc_id"))  # 8 documents at most in a window
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", before.alias("before"))
    return docs.select("doc_id", F.md5(L.line_changes(F.col("before"), F.col("text"))).alias("changes_md5"))


@query()
def sentence_excerpts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", L.sentence_excerpt(F.col("text")).alias("excerpt"))
