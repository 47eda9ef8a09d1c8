"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, embedding_dedup, exact_dedup, hard_negatives, jaccard_join, length_buckets, line_dedup, revisits, suffix_dedup, token_packing, toxicity, url_reputation


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = token_packing.pack_tokens(_read(spark, sf_dir, "documents"))
    return packed.select("pack_id", "doc_ids", "parts", "cu_seqlens", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d"""


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the quality label of the same number: low quality is bad."""
    outcomes = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_reputation.url_filter(_read(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


_RULE_SQL = {
    "org/": "(host = 'org' OR host LIKE '%.org') AND starts_with(path, '/')",
    "com/fr/": "(host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/')",
    "com/de/": "(host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/')",
    "example.org/es/": "(host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/')",
    "example.org/en/1": "(host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1')",
}
OP3_SQL = f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
h AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY host),
s AS (SELECT *, regexp_extract(host, '(?:(?:^|\\.)(?:ac|co|com|edu|gov|net|org)\\.[^.]{{2}}|[^.]*)$') AS tail, len(string_split(host, '.')) AS parts FROM h),
u AS (SELECT host, n, bad, CASE WHEN parts >= 3 AND tail LIKE '.%' THEN tail[2:] ELSE string_split(host, '.')[-1] END AS suffix FROM s),
d AS (SELECT *, array_to_string(string_split(host, '.')[-(1 + len(string_split(suffix, '.'))):], '.') AS domain FROM u),
g AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS m FROM d),
sx AS (SELECT suffix, (sum(bad) + 2.0 * any_value(m)) / (sum(n) + 2.0) AS above FROM d, g GROUP BY suffix),
dx AS (SELECT domain, above, sum(n) AS n, sum(bad) AS bad FROM d JOIN sx USING (suffix) GROUP BY domain, suffix, above),
dw AS (SELECT 1 / greatest(0.01, least(0.5, coalesce(sum((bad - n * above) ** 2 - n * above * (1 - above)) / nullif(sum(n * (n - 1) * above * (1 - above)), 0), 0.01))) - 1 AS w FROM dx),
hx AS (SELECT host, d.n, d.bad, (dx.bad + w * dx.above) / (dx.n + w) AS above FROM d JOIN dx USING (domain), dw),
hw AS (SELECT 1 / greatest(0.01, least(0.5, coalesce(sum((bad - n * above) ** 2 - n * above * (1 - above)) / nullif(sum(n * (n - 1) * above * (1 - above)), 0), 0.01))) - 1 AS w FROM hx),
b AS (SELECT host, (bad + w * above) / (n + w) AS mean, n + w AS weight FROM hx, hw),
j AS (SELECT p.*, mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) AS lower_bound,
      CASE {" ".join(f"WHEN {w} THEN '{r}'" for r, w in sorted(_RULE_SQL.items(), key=lambda x: -len(x[0])))} END AS rule FROM p JOIN b USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN lower_bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM j"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(_read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records made from pages: a full response of each page and, 1,000 numbers later, a 304 answer that names the page's own ETag, with every seventh one stale."""
    tag = F.md5(F.coalesce("html", F.lit("")))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), tag), F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), F.col("page_id").cast("string"), F.lit("Content-Length"), F.length("html").cast("string")).alias("headers"), F.md5(F.coalesce("html", F.lit(""))).alias("payload_digest"),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") + 1000).alias("ts"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), F.when(F.col("page_id") % 7 == 0, "stale").otherwise(tag), F.lit("Date"), (F.col("page_id") + 1000).cast("string"), F.lit("Content-Length"), F.lit("0")).alias("headers"), F.lit(None).cast("string").alias("payload_digest"),
    )
    return full.unionByName(again)


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(captures(_read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select("record_id", "url_key", "refers_to", "outcome", "payload_digest", *[F.col("headers")[n].alias(n.replace("-", "_")) for n in ("etag", "date", "content-type", "content-length")])


OP7_SQL = r"""
WITH c AS (SELECT page_id, md5(coalesce(html, '')) AS tag, length(html)::VARCHAR AS size,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1)), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '/+$', '') AS base,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)', 'i'))) AS q FROM pages),
k AS (SELECT page_id, tag, size, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM c),
m AS (SELECT r.page_id, r.url_key, r.tag, f.page_id AS full_id, f.tag AS full_tag, f.size, CASE WHEN r.page_id % 7 = 0 THEN 'stale' ELSE r.tag END AS etag
      FROM k r ASOF LEFT JOIN k f ON r.url_key = f.url_key AND r.page_id + 1000 > f.page_id)
SELECT page_id * 2 + 1 AS record_id, url_key, full_id * 2 AS refers_to,
    CASE WHEN full_id IS NULL THEN 'no_earlier_response' WHEN etag = full_tag THEN 'resolved' ELSE 'validator_mismatch' END AS outcome,
    CASE WHEN etag = full_tag THEN full_tag END AS payload_digest, CASE WHEN etag = full_tag THEN etag END AS etag,
    CASE WHEN etag = full_tag THEN (page_id + 1000)::VARCHAR END AS date, CASE WHEN etag = full_tag THEN 'text/html' END AS content_type,
    CASE WHEN etag = full_tag THEN size END AS content_length FROM m"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a word takes part."""
    return line_dedup.removed_lines(_read(spark, sf_dir, "documents"))


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets.length_buckets(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7 the label is that of the next class; anchors are the rows whose vec_id is divisible by 100."""
    vectors = hard_negatives.quantised(_read(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


_FINITE_SQL = "label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
OP11_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE {_FINITE_SQL}),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> own AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(_read(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_read(spark, sf_dir, "embeddings"))


OP13_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE {_FINITE_SQL} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.w, r.root FROM r JOIN l ON l.u = r.id),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n ON n.u = vec_id JOIN c ON c.id = vec_id"""


QUERIES = {f.__name__: f for f in (op1_token_packing, op2_exact_dedup, op3_url_reputation, op4_toxicity, op5_jaccard_join, op6_decontamination, op7_revisits, op8_suffix_dedup, op9_line_dedup, op10_length_buckets, op11_hard_negatives, op12_alignment, op13_embedding_dedup)}
ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op3_url_reputation": OP3_SQL, "op7_revisits": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op13_embedding_dedup": OP13_SQL}
