"""The match log: its schema, its compaction, and the state that its events add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of an event; those that its type does not use are null. seq orders the log.
SCHEMA = "seq long, ts timestamp, type string, side string, id string, record map<string,string>, a_id string, b_id string, candidate_id string, score double, rank int, reason string"
TYPES = ("upsert_record", "remove_record", "crossmap_confirm", "crossmap_break", "review_match", "no_match_below", "exclude", "unexclude")


def compacted(log: DataFrame) -> DataFrame:
    """The log without what later events supersede: of each record's upserts and removals only a last upsert stays;
    other events stay, in order of seq."""
    about = F.col("type").isin("upsert_record", "remove_record")
    last = Window.partitionBy("side", "id").orderBy(F.desc("seq"))
    records = log.where(about).withColumn("_n", F.row_number().over(last)).where("_n = 1 and type = 'upsert_record'").drop("_n")
    return records.unionByName(log.where(~about | F.col("type").isNull()))


def records_of(log: DataFrame) -> DataFrame:
    """The records (side, id, record, ...) that are left."""
    return compacted(log).where("type = 'upsert_record'")


def crossmap_of(log: DataFrame) -> DataFrame:
    """The pairs (a_id, b_id) that are confirmed: a pair ends when either id is confirmed with another partner, when it
    is broken or excluded, or when one of its records is removed or, having been matched, comes in anew.

    Every event is brought to the ids that it touches, so the last event of either id decides, without going through
    the log one by one.
    """
    if "side" not in log.columns:
        log = log.withColumns({"side": F.lit(None).cast("string"), "id": F.lit(None).cast("string")})
    confirm = log.where("type = 'crossmap_confirm'").select("seq", "a_id", "b_id")
    last_a = confirm.groupBy("a_id").agg(F.max("seq").alias("seq"))
    last_b = confirm.groupBy("b_id").agg(F.max("seq").alias("seq"))
    held = confirm.join(last_a, ["a_id", "seq"]).join(last_b, ["b_id", "seq"])
    ended = log.where("type in ('crossmap_break', 'exclude')").groupBy(F.col("a_id").alias("ea"), F.col("b_id").alias("eb")).agg(F.max("seq").alias("es"))
    gone = log.where("type in ('remove_record', 'upsert_record')").groupBy("side", "id").agg(F.max("seq").alias("gs"))
    held = held.join(ended, (F.col("a_id") == F.col("ea")) & (F.col("b_id") == F.col("eb")) & (F.col("es") > F.col("seq")), "left_anti")
    for side in "ab":
        g = gone.where(F.col("side") == side).select(F.col("id").alias("gid"), "gs")
        held = held.join(g, (F.col(f"{side}_id") == F.col("gid")) & (F.col("gs") > F.col("seq")), "left_anti")
    return held.select("a_id", "b_id")


def exclusions_of(log: DataFrame) -> DataFrame:
    """Pairs whose last exclude or unexclude is an exclude."""
    last = Window.partitionBy("a_id", "b_id").orderBy(F.desc("seq"))
    rows = log.where("type in ('exclude', 'unexclude')").withColumn("_n", F.row_number().over(last))
    return rows.where("_n = 1 and type = 'exclude'").select("a_id", "b_id")


def reviews_of(log: DataFrame) -> DataFrame:
    """Open reviews (side, id, candidate_id, score, rank, reason): gone once either record is confirmed, removed or comes
    in anew, or their pair is excluded."""
    first = Window.partitionBy("side", "id", "candidate_id").orderBy(F.desc("seq"))
    open_ = log.where("type = 'review_match'").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("seq", "side", "id", "candidate_id", "score", "rank", "reason")
    open_ = open_.withColumn("ra", F.when(F.col("side") == "a", F.col("id")).otherwise(F.col("candidate_id"))).withColumn("rb", F.when(F.col("side") == "a", F.col("candidate_id")).otherwise(F.col("id")))
    for side in "ab":
        done = log.where("type = 'crossmap_confirm'").select(F.col(f"{side}_id").alias("gid"), "seq").union(
            log.where("type in ('remove_record', 'upsert_record')").where(F.col("side") == side).select(F.col("id"), "seq")
        )
        done = done.groupBy("gid").agg(F.max("seq").alias("gs"))
        open_ = open_.join(done, (F.col(f"r{side}") == F.col("gid")) & (F.col("gs") > F.col("seq")), "left_anti")
    out = log.where("type = 'exclude'").groupBy(F.col("a_id").alias("xa"), F.col("b_id").alias("xb")).agg(F.max("seq").alias("xs"))
    open_ = open_.join(out, (F.col("ra") == F.col("xa")) & (F.col("rb") == F.col("xb")) & (F.col("xs") > F.col("seq")), "left_anti")
    return open_.drop("ra", "rb", "seq")
