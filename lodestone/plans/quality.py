"""Queries of the whole quality gate, near templates and their re-evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as QU
from ..operators import templates as TP
from .catalog import _read, query

_META = "substr(string_split(coalesce(text, ''), chr(10))[1], 1, 120) AS title, CASE WHEN n_chars % 9 > 0 THEN '2026-01-05' ELSE '' END AS published_at"


def _documents(spark, sf_dir):
    """The first line is the title; the date is missing where n_chars is divisible by 9."""
    title = F.substr(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), F.lit(1), F.lit(120))
    return _read(spark, sf_dir, "documents").select("doc_id", "source", "text", title.alias("title"), F.when(F.expr("n_chars % 9 > 0"), "2026-01-05").otherwise("").alias("published_at"))


_R = QU.LATIN_GATE
_bare = lambda c: f"length(regexp_replace({c}, '\\s+', '', 'g'))"
_times = lambda t: f"((length(text) - length(replace(text, '{t}', ''))) // {len(t)})"
_HITS = [_times(t) for t in _R.navigation]
_ATT = r"\.(pdf|docx?|xlsx?|zip|rar)\b"
ASSESSED = rf"""
d0 AS (SELECT doc_id, source, {_META}, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS body FROM documents),
d1 AS (SELECT * REPLACE (trim(title) AS title), length(body) AS text_characters, string_split_regex(text, '[。！？!?；;]+') AS sentences, regexp_replace(title || text, '\s+', '', 'g') AS sample FROM d0),
d2 AS (SELECT *, len(regexp_extract_all(sample, '[åäçÃ�]')) AS odd, greatest(1, length(sample)) AS size, title || chr(10) || text AS whole,
    greatest(len(list_filter(string_split_regex(text, '[\r\n]+'), lambda u: {_bare('u')} >= 12)), len(list_filter(sentences, lambda u: {_bare('u')} >= 12))) AS effective_paragraphs,
    len(regexp_extract_all(text, '{_ATT}', 0, 'i')) AS attachment_count, len(list_filter(sentences, lambda u: {_bare('u')} >= 18 AND NOT regexp_matches(u, '{_ATT}', 'i'))) AS factual,
    {' + '.join(_HITS)} AS navigation_hits, greatest({', '.join(_HITS)}) >= 3 AS repeated, ({' + '.join(f'{h} * {len(t)}' for h, t in zip(_HITS, _R.navigation, strict=True))}) / greatest(1, text_characters) AS navigation_ratio,
    len(regexp_extract_all(body, '[\x{{4e00}}-\x{{9fff}}A-Za-z0-9]')) / greatest(1, text_characters) AS information_density, lower(regexp_replace(title, '[\s\-_|·—]+', '', 'g')) AS title_key FROM d1),
d3 AS (SELECT *, contains(sample, '�') OR (odd >= 5 AND odd / size >= 0.012) AS broken, title_key = '' OR title_key IN ('home') OR (contains(title, 'official') AND length(title_key) <= 18) AS generic, published_at <> '' AS dated,
    list_filter([{', '.join(f"CASE WHEN len(regexp_extract_all(whole, {chr(39)}{p}{chr(39)}, 1)) > 0 THEN {chr(39)}{n}{chr(39)} END" for n, p in _R.facts.items())}], lambda x: x IS NOT NULL) AS slots FROM d2),
d4 AS (SELECT *, list_filter([CASE WHEN text_characters < 30 OR (effective_paragraphs < 2 AND text_characters < 70) THEN 'thin_body' END, CASE WHEN attachment_count >= 2 AND factual = 0 THEN 'attachments_only' END,
    CASE WHEN (navigation_hits >= 6 AND navigation_ratio >= 0.06) OR repeated THEN 'navigation_noise' END, CASE WHEN text_characters >= 80 AND information_density < 0.55 THEN 'low_density' END], lambda x: x IS NOT NULL) AS processing,
    list_filter([CASE WHEN generic THEN 'generic_title' END, CASE WHEN NOT dated THEN 'date_missing' END], lambda x: x IS NOT NULL) AS report FROM d3),
assessed AS (SELECT doc_id, CASE WHEN broken THEN 'encoding_anomaly' WHEN len(processing) > 0 THEN 'body_failed' WHEN len(report) > 0 THEN 'report_failed' ELSE 'ok' END AS status, NOT broken AND len(processing) = 0 AS processing_allowed,
    NOT broken AND len(processing) = 0 AND len(report) = 0 AS report_allowed, CASE WHEN broken THEN 'encoding_anomaly' ELSE array_to_string(processing || report, ',') END AS issues, text_characters, effective_paragraphs, attachment_count, navigation_hits,
    round_even(navigation_ratio, 4) AS navigation_ratio, round_even(information_density, 4) AS information_density, 0.0::DOUBLE AS template_similarity, 0 AS template_similarity_warning, len(slots) AS structured_fact_count,
    array_to_string(list_sort(slots), '、') AS structured_fact_fields, generic::INTEGER AS generic_title, dated::INTEGER AS date_present FROM d4)"""


@query(f"WITH {ASSESSED} SELECT * FROM assessed")
def document_assessment(spark, sf_dir):
    return QU.assess(_documents(spark, sf_dir), QU.LATIN_GATE)


@query(f"WITH {ASSESSED}, i AS (SELECT unnest(string_split(issues, ',')) AS issue FROM assessed WHERE issues <> '') SELECT issue, count(*) AS n FROM i GROUP BY 1")
def assessment_issues(spark, sf_dir):
    return QU.issue_counts(QU.assess(_documents(spark, sf_dir), QU.LATIN_GATE))


@query()
def near_templates(spark, sf_dir):
    return TP.template_similarity(_read(spark, sf_dir, "documents"))


@query()
def template_reevaluation(spark, sf_dir):
    """Documents that are near templates are quarantined for it; each is assessed again beside its siblings."""
    documents = _documents(spark, sf_dir)
    near = TP.template_similarity(documents)
    seen = documents.join(near.select("doc_id", F.col("similarity").alias("old_similarity")), "doc_id", "left").withColumn("record_state", F.when(F.col("old_similarity").isNotNull(), "quarantined").otherwise("active"))
    return QU.reevaluate(seen, near, QU.LATIN_GATE)
