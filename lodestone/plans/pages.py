"""Queries over raw pages and their addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as PG
from .catalog import _read, query

_PATHS = """u AS (SELECT lower(regexp_extract(url, '://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, string_split(regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/') AS s FROM pages WHERE url IS NOT NULL)"""


@query()
def extracted_pages(spark, sf_dir):
    return PG.extracted(_read(spark, sf_dir, "pages"))


@query()
def discovered_links(spark, sf_dir):
    return PG.discovered(_read(spark, sf_dir, "pages"))


@query(rf"""WITH {_PATHS}, h AS (SELECT host, count(*) AS n, min(len(s)) AS least, list(s) AS every FROM u WHERE host <> '' GROUP BY host),
c AS (SELECT host, n, every[1] AS first, len(list_filter(generate_series(1, least), lambda k: len(list_filter(every, lambda x: x[1:k] <> every[1][1:k])) = 0)) AS same FROM h),
p AS (SELECT host, n, CASE WHEN same <= 1 THEN '/' ELSE '/' || array_to_string(first[1:same - 1], '/') || '/' END AS prefix FROM c)
SELECT host, n, prefix, '^https?://' || regexp_replace(host, '([^\w/])', '\\\1', 'g') || regexp_replace(rtrim(prefix, '/'), '([^\w/])', '\\\1', 'g') || '/.+' AS pattern FROM p""")
def host_url_patterns(spark, sf_dir):
    return PG.url_patterns(_read(spark, sf_dir, "pages"))


@query(f"WITH {_PATHS}, d AS (SELECT host, s, unnest(generate_series(1, least(len(s), 8))) AS depth FROM u WHERE host <> '' AND s[1] <> '') SELECT host, depth::INTEGER AS depth, '/' || array_to_string(s[1:depth], '/') AS prefix, count(*) AS n FROM d GROUP BY ALL")
def url_sections(spark, sf_dir):
    return PG.path_trie(_read(spark, sf_dir, "pages"))


@query("SELECT page_id, sha256(html) AS text_sha256, CASE WHEN page_id % 3 = 0 THEN 'utf-16-be' WHEN page_id % 3 = 1 THEN 'utf-8' ELSE 'utf-16' END AS encoding FROM pages WHERE html IS NOT NULL")
def decoded_pages(spark, sf_dir):
    """Pages as bytes in three encodings, two of them declared; what comes back is the page."""
    third = F.pmod("page_id", F.lit(3))
    raw = F.when(third == 0, F.encode("html", "UTF-16BE")).when(third == 1, F.encode("html", "UTF-8")).otherwise(F.encode("html", "UTF-16"))
    kind = F.when(third == 0, "text/html; charset=UTF-16BE").when(third == 2, "text/html; charset='utf-16'")
    files = _read(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", raw.alias("content"), kind.alias("kind"))
    return PG.decoded(files, "page_id", "content", "kind").select("page_id", F.sha2("text", 256).alias("text_sha256"), "encoding")
