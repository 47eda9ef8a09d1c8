"""Queries over single values of the given tables: URLs, dates, parsed text, questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .catalog import _quote, _read, query

_HOST = "lower(regexp_replace(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
_AUTHORITY = "regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


@query(f"""WITH u AS (SELECT page_id, trim(coalesce(CASE WHEN page_id % 9 = 1 THEN 'http://10.0.0.' || page_id % 250 || '/x' WHEN page_id % 9 = 2 THEN 'http://u:p@' || page_id || '.org/' WHEN page_id % 9 = 3 THEN 'https://a.example.org:' || page_id * 977 WHEN page_id % 9 = 4 THEN 'ftp://b.org' WHEN page_id % 9 = 5 THEN 'http://c.local/' ELSE url END, '')) AS url FROM pages),
h AS (SELECT *, {_HOST} AS host, {_AUTHORITY} AS authority FROM u)
SELECT page_id, regexp_matches(url, '^https?://[^/?#\\s][^\\s]*$') AS valid, host = 'example.org' OR ends_with(host, '.example.org') OR host = 'b.org' OR ends_with(host, '.b.org') AS allowed,
CASE WHEN url = '' OR regexp_matches(url, '\\s') THEN 'white_space' WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'scheme' WHEN host = '' THEN 'host' WHEN contains(authority, '@') THEN 'credentials'
WHEN regexp_matches(authority, ':[0-9]+$') AND NOT TRY_CAST(regexp_extract(authority, ':([0-9]{{1,9}})$', 1) AS BIGINT) BETWEEN 1 AND 65535 THEN 'port'
WHEN host = 'localhost' OR regexp_matches(host, '\\.(localhost|local|internal)$') THEN 'local_host' WHEN regexp_matches(host, '^10\\.[0-9]+\\.[0-9]+\\.[0-9]+$') THEN 'local_address' ELSE 'ok' END AS policy FROM h""")
def url_checks(spark, sf_dir):
    made = "CASE WHEN page_id % 9 = 1 THEN 'http://10.0.0.' || page_id % 250 || '/x' WHEN page_id % 9 = 2 THEN 'http://u:p@' || page_id || '.org/' WHEN page_id % 9 = 3 THEN 'https://a.example.org:' || page_id * 977 WHEN page_id % 9 = 4 THEN 'ftp://b.org' WHEN page_id % 9 = 5 THEN 'http://c.local/' ELSE url END"
    pages = _read(spark, sf_dir, "pages").select("page_id", F.expr(made).alias("url"))
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@", ""), r":\d*$", ""))
    return pages.select("page_id", V.valid_source_url(F.col("url")).alias("valid"), T.host_allowed(host, ["example.org", "b.org"]).alias("allowed"), V.url_policy(F.col("url")).alias("policy"))


@query(r"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'on 20' || (10 + doc_id % 20) || '年' || (1 + doc_id % 14) || '月' || (1 + doc_id % 33) || '日 ' WHEN doc_id % 3 = 1 THEN '2024-' || (1 + doc_id % 12) || '/' || (1 + doc_id % 28) ELSE '' END || coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract(t, '(20\d{2})[年./-](\d{1,2})[月./-](\d{1,2})', ['y', 'm', 'd']) AS p FROM x) SELECT doc_id, TRY_CAST(p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') AS DATE) AS day FROM m""")
def text_dates(spark, sf_dir):
    start = F.expr("CASE WHEN doc_id % 3 = 0 THEN 'on 20' || (10 + doc_id % 20) || '年' || (1 + doc_id % 14) || '月' || (1 + doc_id % 33) || '日 ' WHEN doc_id % 3 = 1 THEN '2024-' || (1 + doc_id % 12) || '/' || (1 + doc_id % 28) ELSE '' END")
    return _read(spark, sf_dir, "documents").select("doc_id", T.date_in(F.concat(start, F.coalesce("text", F.lit("")))).alias("day"))


@query(r"SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_zip(ts, range(1, len(ts) + 1)), lambda p: list_position(ts, p[1]) = p[2]), lambda p: p[1]), ' ') AS terms FROM (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[一-鿿]{2,}|[a-zA-Z0-9_]{2,}') AS ts FROM conversations)")
def search_terms(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.search_terms(F.col("text")), " ").alias("terms"))


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(split_part(coalesce(text, ''), chr(10), 1) || coalesce(text, ''), '\s+', '', 'g') AS t FROM documents), c AS (SELECT *, (length(t) - length(regexp_replace(t, '[åäçÃ�]', '', 'g')))::INTEGER AS count FROM s)
SELECT doc_id, contains(t, chr(65533)) OR (count >= 5 AND count / greatest(length(t), 1) >= 0.012::DOUBLE) AS bad, count, round_even(count / greatest(length(t), 1), 4) AS ratio FROM c""")
def encoding_scan(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", V.encoding_anomaly(F.substring_index("text", "\n", 1), F.col("text")).alias("x")).select("doc_id", "x.*")


@query("SELECT doc_id, " + " OR ".join(f"regexp_matches(coalesce(text, ''), {_quote(p)})" for p in V.PERSONAL) + " AS personal FROM documents")
def personal_data_scan(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", V.personal_data(F.col("text")).alias("personal"))


@query(rf"SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), {_quote(V.API_KEY)}, 'sk-****', 'g'), {_quote(V.BEARER)}, '\1****', 'g'), {_quote(V.LOCAL_PATH)}, '[path]', 'g'), 1, 300) AS shown FROM documents")
def redacted_logs(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", V.redact_log(F.col("text")).alias("shown"))


@query(r"SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[,，;；、|\n]+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> ''), '|') AS parts FROM conversations")
def value_lists(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(V.string_list(F.col("text")), "|").alias("parts"))


@query(r"""WITH n AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ' High' WHEN event_id % 5 = 1 THEN '低' ELSE props END AS x FROM events), t AS (SELECT event_id, lower(trim(coalesce(x, ''))) AS t FROM n), d AS (SELECT *, TRY_CAST(regexp_extract(t, '\d+(?:\.\d+)?') AS DOUBLE) AS d FROM t)
SELECT event_id, CASE WHEN t IN ('high', '高') THEN 0.85 WHEN t IN ('medium', '中') THEN 0.65 WHEN t IN ('low', '低') THEN 0.35 WHEN d > 1 AND d <= 100 THEN d / 100 ELSE d END::DOUBLE AS confidence FROM d""")
def confidences(spark, sf_dir):
    made = F.expr("CASE WHEN event_id % 5 = 0 THEN ' High' WHEN event_id % 5 = 1 THEN '低' ELSE props END")
    return _read(spark, sf_dir, "events").select("event_id", V.confidence(made).alias("confidence"))


_MADE = "CASE WHEN event_id % 6 = 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN event_id % 6 = 1 THEN '{\"k\": 1, \"other\": 2}' WHEN event_id % 6 = 2 THEN 'no json' ELSE props END"


@query(f"""WITH x AS (SELECT event_id, {_MADE} AS t, props FROM events) SELECT event_id, event_id % 6 NOT IN (1, 2) AND props IS NOT NULL AS ok, CASE WHEN event_id % 6 = 1 THEN 'unknown_field' WHEN event_id % 6 = 2 OR props IS NULL THEN 'not_an_object' ELSE '' END AS error,
CASE WHEN event_id % 6 NOT IN (1, 2) THEN json_extract_string(props, '$.k') END AS k FROM x""")
def strict_objects(spark, sf_dir):
    x = V.strict_object(F.expr(_MADE), ("k",))
    return _read(spark, sf_dir, "events").select("event_id", x.alias("x")).select("event_id", "x.ok", "x.error", F.col("x.data")["k"].alias("k"))


@query(r"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, t, regexp_extract(t, '[^。！？!?；;\n]{4,180}[。！？!?；;][”’"''」』]?') AS s, list_filter(list_transform(string_split(t, chr(10)), lambda p: trim(p)), lambda p: length(p) >= 4)[1] AS l FROM x)
SELECT doc_id, trim(coalesce(nullif(s, ''), substr(l, 1, 180), '')) AS sentence FROM s""")
def first_sentences(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", V.first_sentence(F.col("text")).alias("sentence"))


_CLASSES = {"permission_review": ("license", "copyright"), "manual_only": ("cookie",), "needs_adapter": ("menu", "share"), "disabled": ("heit",)}
_classes = lambda table, text, end: "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce({text}, '')), {_quote(t)})" for t in terms) + f" THEN {_quote(n)}" for n, terms in table.items()) + f" ELSE {end} END"


@query(f"SELECT doc_id, {_classes(_CLASSES, 'text', _quote('degraded'))} AS operational_status FROM documents")
def error_classes(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", V.first_class(F.col("text"), _CLASSES, "degraded").alias("operational_status"))


_BUCKETS = {"direct": ("the", "des"), "policy": ("que", "und"), "trend": ("ing",)}
_PLACES = {"1": ("ción", "tion"), "2": ("heit", "ment"), "4": ("keit",), "3": ("aire",)}


@query(f"SELECT conv_id, turn, {_classes(_BUCKETS, 'text', _quote('none'))} AS bucket, {_classes(_PLACES, 'text', _quote('5'))}::INTEGER AS geography_level FROM conversations WHERE role = 'user'")
def question_topics(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", V.first_class(F.col("text"), _BUCKETS, "none").alias("bucket"), V.first_class(F.col("text"), _PLACES, "5").cast("int").alias("geography_level"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'q' || event_id WHEN event_id % 4 = 1 THEN '需回原文核验：lost' WHEN event_id % 4 = 2 THEN 'line ' || event_id ELSE '未保存可定位证据片段，需回到原文核验。' END AS excerpt, CASE WHEN event_id % 4 = 2 THEN 'line ' || event_id ELSE '' END AS noted FROM events""")
def evidence_excerpts(spark, sf_dir):
    part = lambda i, x: F.when(F.col("event_id") % 4 == i, x)
    note = part(2, F.concat(F.lit("seen. 证据片段：line "), F.col("event_id").cast("string"), F.lit(" 重复候选：none")))
    quote = part(0, F.concat(F.lit("q"), F.col("event_id").cast("string")))
    return _read(spark, sf_dir, "events").select("event_id", V.excerpt(quote, part(1, F.lit("lost")), note).alias("excerpt"), F.array_join(V.noted_quotes(note), "|").alias("noted"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_valid(coalesce(props, '')) THEN len(json_keys(props)) ELSE 0 END::INTEGER AS n_keys FROM events")
def metadata_objects(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", V.json_object(F.col("props"), "bigint").alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.size("m").alias("n_keys"))
