"""Sides made of the provided tables, in Spark and in DuckDB SQL. All of them take whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators.scoring import MatchField


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _side(df: DataFrame, side: str, **fields) -> DataFrame:
    return df.select(*[F.coalesce(F.expr(e).cast("string"), F.lit("")).alias(f"{side}_{n}") for n, e in fields.items()])


def _sql_side(source: str, side: str, **fields) -> str:
    return "SELECT " + ", ".join(f"coalesce(CAST({e} AS VARCHAR), '') AS {side}_{n}" for n, e in fields.items()) + f" FROM {source}"


#: Suppliers (A) and customers (B) of a nation; one customer in seven has no nation, some share a tax number with a supplier.
SUPPLIER = {"id": "s_suppkey", "name": "s_name", "nation": "s_nationkey", "balance": "CAST(floor(s_acctbal / 500) AS BIGINT)", "tax": "concat('T', CAST(s_suppkey * 7 AS BIGINT))"}
CUSTOMER = {
    "id": "c_custkey",
    "name": "c_name",
    "nation": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END",
    "balance": "CAST(floor(c_acctbal / 500) AS BIGINT)",
    "tax": "CASE WHEN c_custkey % 3 = 0 THEN concat(' T', CAST(c_custkey AS BIGINT), ' ') ELSE '' END",
}
#: Parts against parts of the same brand and type.
PART = {"id": "lpad(CAST(p_partkey AS VARCHAR(20)), 9, '0')", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"}

PART_FIELDS = [MatchField("fuzzy", 0.5, "name", "name", "wratio"), MatchField("exact", 0.3, "size", "size"), MatchField("numeric", 0.2, "size", "size")]
AUTO, FLOOR, GAP, TOP = 0.85, 0.6, 0.05, 5

SQL = {
    "sa": _sql_side("supplier", "a", **SUPPLIER),
    "cb": _sql_side("customer", "b", **CUSTOMER),
    "pa": _sql_side("part", "a", **PART),
    "pb": _sql_side("part", "b", **PART),
}


def suppliers(spark, d):
    return _side(table(spark, d, "supplier"), "a", **SUPPLIER)


def customers(spark, d):
    return _side(table(spark, d, "customer"), "b", **CUSTOMER)


def parts(spark, d, side):
    return _side(table(spark, d, "part"), side, **PART)


def items(spark, d):
    """Benchmark items as a pool of texts."""
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("a_id"), F.col("text").alias("a_text"))


def documents(spark, d):
    """Whole documents as queries."""
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("b_id"), F.col("text").alias("b_text"))


#: LCS lengths of the pairs of strings that scoring all pairs of part names needs, and the scores: sim(x, y, ratio,
#: token_sort, partial, wratio). A row of the table is the running maximum of what the row above gives.
SIM = """
names AS (SELECT DISTINCT lower(trim(p_name)) AS n FROM part),
sorted AS (SELECT n, array_to_string(list_sort(list_filter(regexp_split_to_array(n, '\\s+'), lambda w: w <> '')), ' ') AS s FROM names),
np AS (SELECT x.n AS x, y.n AS y, x.s AS sx, y.s AS sy,
              CASE WHEN length(x.n) <= length(y.n) THEN x.n ELSE y.n END AS short,
              CASE WHEN length(x.n) <= length(y.n) THEN y.n ELSE x.n END AS long FROM sorted x, sorted y),
win AS (SELECT x, y, short, substr(long, k + 1, length(short)) AS w
        FROM (SELECT *, unnest(range(0, length(long) - length(short) + 1)) AS k FROM np)),
need AS (SELECT x AS p, y AS q FROM np UNION SELECT sx, sy FROM np UNION SELECT short, w FROM win),
lcs AS (
  SELECT p, q, list_last(list_reduce(
    list_concat([list_transform(range(0, length(q)), lambda i: 0::BIGINT)],
                list_transform(string_split(p, ''), lambda c: list_transform(string_split(q, ''), lambda d: (c = d)::BIGINT))),
    lambda old, m: list_transform(range(1, length(q) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
      CASE WHEN m[k] = 1 THEN (CASE WHEN k > 1 THEN old[k - 1] ELSE 0 END) + 1 ELSE old[k] END))))) AS l
  FROM need),
indel AS (SELECT p, q, CASE WHEN p = q THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * l / (length(p) + length(q)) END AS r FROM lcs),
part_best AS (SELECT x, y, max(r) AS r FROM win JOIN indel ON p = short AND q = w GROUP BY x, y),
sim AS (
  SELECT np.x, np.y, a.r AS ratio, b.r AS token_sort,
         CASE WHEN contains(long, short) THEN 1.0::DOUBLE ELSE part_best.r END AS partial,
         greatest(a.r, b.r, CASE WHEN contains(long, short) THEN 1.0::DOUBLE ELSE part_best.r END) AS wratio
  FROM np JOIN indel a ON a.p = np.x AND a.q = np.y JOIN indel b ON b.p = sx AND b.q = sy
  JOIN part_best ON part_best.x = np.x AND part_best.y = np.y)
"""
SCORED = (
    SIM
    + f""",
pa AS ({SQL["pa"]}), pb AS ({SQL["pb"]}),
pairs AS (SELECT b_id, a_id, a_name, b_name, a_size, b_size FROM pa JOIN pb ON lower(a_brand) = lower(b_brand) AND lower(a_type) = lower(b_type) WHERE a_id <> b_id),
scored AS (
  SELECT b_id, a_id, wratio AS name_score, (a_size = b_size)::INT::DOUBLE AS size_score,
         greatest(0, least(1, 0.0::DOUBLE + wratio * 0.5::DOUBLE + (a_size = b_size)::INT::DOUBLE * 0.3::DOUBLE + (a_size = b_size)::INT::DOUBLE * 0.2::DOUBLE)) AS score
  FROM pairs JOIN sim ON x = lower(trim(a_name)) AND y = lower(trim(b_name))),
placed AS (
  SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM scored WINDOW w AS (PARTITION BY b_id ORDER BY score DESC, a_id)),
ranks AS (
  SELECT b_id, a_id, score, name_score, size_score, least(place, 255)::INT AS rank,
         CASE WHEN place = 1 AND score >= {AUTO} AND score - second < {GAP} THEN 'downgraded' ELSE 'top_scoring' END AS reason,
         CASE WHEN place = 1 AND score >= {AUTO} AND score - second < {GAP} THEN 'review' WHEN score >= {AUTO} THEN 'auto' WHEN score >= {FLOOR} THEN 'review' ELSE 'no_match' END AS classification
  FROM placed WHERE place <= {TOP})"""
)
