"""Writers: result tables as CSV, Parquet and managed tables, pair files, logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, columns and conditions of the views that users of the result tables know.
VIEWS = {
    "confirmed_matches": "SELECT * FROM relationships WHERE relationship_type = 'match'",
    "scored_matches": "SELECT * FROM relationships WHERE relationship_type = 'match' AND reason = 'top_scoring'",
    "asserted_matches": "SELECT * FROM relationships WHERE relationship_type = 'match' AND reason NOT IN ('top_scoring', 'downgraded')",
    "review_queue": "SELECT * FROM relationships WHERE relationship_type = 'review'",
    "near_misses": "SELECT * FROM relationships WHERE relationship_type = 'candidate' AND rank = 1",
    "runner_ups": "SELECT * FROM relationships WHERE rank > 1",
    "unmatched_a": "SELECT a.* FROM a_records a LEFT ANTI JOIN (SELECT a_id FROM relationships WHERE relationship_type IN ('match', 'review')) r ON a.id = r.a_id",
    "unmatched_b": "SELECT b.* FROM b_records b LEFT ANTI JOIN (SELECT b_id FROM relationships WHERE relationship_type IN ('match', 'review')) r ON b.id = r.b_id",
    "broken_matches": "SELECT * FROM relationships WHERE relationship_type = 'broken'",
    "summary": "SELECT relationship_type, reason, count(*) AS count, avg(score) AS avg_score, min(score) AS min_score, max(score) AS max_score FROM relationships GROUP BY relationship_type, reason",
    "relationship_detail": (
        "SELECT r.a_id, r.b_id, r.score AS composite_score, r.relationship_type, r.reason, r.rank, f.field_a, f.field_b, f.method, f.score AS field_score, f.weight "
        "FROM relationships r LEFT JOIN field_scores f ON r.a_id = f.a_id AND r.b_id = f.b_id"
    ),
}


def create_views(relationships: DataFrame, a: DataFrame, b: DataFrame, field_scores: DataFrame) -> None:
    """The result tables and the views over them, as temporary views of the session."""
    for name, df in (("relationships", relationships), ("a_records", a.withColumnRenamed("a_id", "id")), ("b_records", b.withColumnRenamed("b_id", "id")), ("field_scores", field_scores)):
        df.createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        relationships.sparkSession.sql(sql).createOrReplaceTempView(name)


def four(c: str):
    return F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).alias(c)


def relationship_rows(relationships: DataFrame, a: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Matches and reviews with the fields of their A record, renamed as asked."""
    fields = {c: (mapping or {}).get(c.removeprefix("a_"), c.removeprefix("a_")) for c in a.columns if c != "a_id"}
    rows = relationships.where(F.col("relationship_type").isin("match", "review")).join(a, "a_id", "left")
    return rows.select("b_id", "a_id", "score", "relationship_type", "reason", "rank", *[F.col(c).alias(n) for c, n in fields.items() if n not in ("score", "rank", "reason")])


def unmatched_rows(b: DataFrame, relationships: DataFrame) -> DataFrame:
    """B records without a match or review, with the best score and candidate that they had."""
    taken = relationships.where(F.col("relationship_type").isin("match", "review")).select("b_id")
    best = relationships.where("relationship_type = 'no_match'").groupBy("b_id").agg(F.max("score").alias("best_score"), F.max_by("a_id", F.coalesce("score", F.lit(0.0))).alias("best_a_id"))
    return b.join(taken, "b_id", "left_anti").join(best, "b_id", "left")


def direct_rows(relationships: DataFrame, field_scores: DataFrame) -> DataFrame:
    """One row per pair with its class and a column <field_a>_<field_b>_score per compared pair of fields."""
    named = field_scores.withColumn("name", F.concat_ws("_", "field_a", "field_b", F.lit("score")))
    wide = named.groupBy("a_id", "b_id").pivot("name").agg(F.first("score"))
    return relationships.select("a_id", "b_id", "score", F.col("relationship_type").alias("classification")).join(wide, ["a_id", "b_id"], "left")


def write_csv(df: DataFrame, path: str, sort: list[str], single: bool = False) -> None:
    """A CSV folder of sorted parts, each of which continues the one before; scores have four decimals. `single` puts
    small results that people open into one part."""
    df = df.select(*[four(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
    df = df.orderBy(*sort)
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_tables(tables: dict[str, DataFrame], database: str) -> None:
    """Managed tables of a database."""
    spark = next(iter(tables.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def recovered(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at path, after an exchange that a crash cut short has been finished or taken back.

    A new table is complete once its folder has the name <path>.new, which is given to it by one rename. From then on
    it is the table, whether or not the old one has been moved away yet.
    """
    target, fs = _path(spark, path)
    new, _ = _path(spark, f"{path}.new")
    old, _ = _path(spark, f"{path}.old")
    if fs.exists(new):
        if fs.exists(target):
            fs.delete(old, True)
            fs.rename(target, old)
        fs.rename(new, target)
    elif not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)
    fs.delete(old, True)
    return fs.exists(target)


def replace_table(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write to a folder beside `path` and exchange it for what is there; readers call `recovered` first, so that a crash
    at any point leaves them the old table or the new one, never none."""
    recovered(spark, path)
    staged, fs = _path(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    write(staged.toString())
    fs.rename(staged, _path(spark, f"{path}.new")[0])
    recovered(spark, path)


def write_pairs(pairs: DataFrame, path: str, a_field: str, b_field: str) -> None:
    """A pair table (cross-map, exclusions) as CSV, a_id before b_id, replaced as a whole."""
    out = pairs.select(F.col("a_id").alias(a_field), F.col("b_id").alias(b_field)).distinct()
    replace_table(pairs.sparkSession, path, lambda p: write_csv(out, p, [a_field, b_field]))


def append_match_log(events: DataFrame, path: str, run_id: str | None = None) -> None:
    (events.withColumn("run_id", F.lit(run_id)) if run_id else events).write.mode("append").json(path)


def append_scoring_log(ranks: DataFrame, path: str, run_id: str | None = None) -> None:
    """One row per query with its ranked candidates and their field scores; queries without candidates are not logged."""
    nested = ranks.groupBy("b_id").agg(F.array_sort(F.collect_list(F.struct("rank", "a_id", "score", "classification", "reason", "field_scores"))).alias("candidates"))
    nested.withColumn("run_id", F.lit(run_id).cast("string")).write.mode("append").parquet(path)


def compact_match_log(spark: SparkSession, path: str) -> None:
    """Replace a match log by its compaction."""
    from linkwright.sources.readers import match_log
    from linkwright.streaming.events import compacted

    log = compacted(match_log(spark, path))
    replace_table(spark, path, lambda p: log.write.json(p))
