"""op1, op2 and op10: DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkwright.llm.exact_dedup import exact_groups
from linkwright.llm.mixing import measured, mixture_plan, planned
from linkwright.llm.url_filter import Rule, judge


def op1_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    groups = exact_groups(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), keep="largest")
    return groups.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""


def op2_mixing(spark, sf_dir):
    rows = measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return planned(rows, mixture_plan(rows)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT *, [5, 2, 1][1 + (place - 1) % 3]::BIGINT AS weight, 3 * source_size AS most FROM r),
c AS (
  SELECT *, most / weight AS level,
         sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
  FROM w),
f AS (SELECT level AS l, place AS p, rest AS fr, rest_weight AS fw FROM c WHERE rest * weight <= most * rest_weight ORDER BY level, place LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN level < l OR (level = l AND place < p) THEN most::DOUBLE
              ELSE least(fr::DOUBLE * weight / fw::DOUBLE, most::DOUBLE) END AS target
  FROM c, f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS copies FROM t),
x AS (
  SELECT d.*, source_size, target, copies, target - copies * source_size AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS n
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       size * (copies + CASE WHEN budget > 0 AND (upto <= budget OR (upto - n <= budget AND budget - (upto - n) >= n / 2)) THEN 1 ELSE 0 END) AS taken
FROM x
"""

#: Host, path and verdict of the rules.
RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


def op10_url_filter(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES).select("page_id", "host", "path", "rule", "verdict")


def _fits(r: Rule) -> str:
    return f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"


_LONGEST_FIRST = sorted(RULES, key=lambda r: (-len(r.host + r.path), r.verdict != "block"))
_RANKS = """
{0}_shares AS (SELECT {1} AS src, {2} AS dst, n / sum(n) OVER (PARTITION BY {1}) AS share FROM links),
{0}_seeds AS (SELECT host, {0}::DOUBLE / (SELECT sum(good + bad) FROM seeds) AS seed FROM seeds WHERE {0} > 0),
{0}_rounds(k, host, rank) AS (
  SELECT 0, host, seed * 0.15::DOUBLE FROM {0}_seeds
  UNION ALL
  SELECT k + 1, host, sum(x) FROM (
    SELECT k, dst AS host, rank * share * 0.85::DOUBLE AS x FROM {0}_rounds JOIN {0}_shares ON src = host
    UNION ALL SELECT k, s.host, seed * 0.15::DOUBLE FROM {0}_seeds s, (SELECT DISTINCT k FROM {0}_rounds)) WHERE k < 60 GROUP BY k, host),
{0}_ranks AS (SELECT host, rank FROM {0}_rounds WHERE k = 60)"""
OP10_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
j AS (
  SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.host}{r.path}'" for r in _LONGEST_FIRST)} END AS rule,
         CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in _LONGEST_FIRST)} END AS ruled FROM h),
seeds AS (SELECT host, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM j WHERE host <> '' GROUP BY host),
targets AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?(?:https?:)?//([^/?#"''\s<>]+)', 1)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target FROM h),
links AS (
  SELECT src, regexp_replace(target, '^[^@]*@|:\d*$', '', 'g') AS dst, count(*) AS n FROM targets
  WHERE src <> '' AND regexp_replace(target, '^[^@]*@|:\d*$', '', 'g') NOT IN ('', src) GROUP BY 1, 2),
{_RANKS.format("good", "src", "dst")},
{_RANKS.format("bad", "dst", "src")}
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN coalesce(b.rank, 0) > coalesce(g.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN good_ranks g ON g.host = j.host LEFT JOIN bad_ranks b ON b.host = j.host
"""

QUERIES = {"op1_exact_dedup": op1_exact_dedup, "op2_mixing": op2_mixing, "op10_url_filter": op10_url_filter}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op2_mixing": OP2_SQL, "op10_url_filter": OP10_SQL}
