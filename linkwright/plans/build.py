"""Result tables from a match log and a scoring log, without matching anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators.tables import latest
from linkwright.plans.config import Config
from linkwright.sources import readers, sinks

PAIR = ["a_id", "b_id"]


@dataclass
class Built:
    relationships: DataFrame  # a_id, b_id, score, rank, relationship_type (match, review, broken, candidate), reason
    unmatched: DataFrame  # B records without match or review, with best_score and best_a_id
    candidates: DataFrame  # b_id, rank, a_id, score of ranks from 2
    field_scores: DataFrame


def relationships_of(log: DataFrame) -> DataFrame:
    """The pairs that a log knows: the last confirm or review of a pair tells what it is, and a later break that it is broken.

    Each event is brought to its pair and the last one per pair decides, with aggregations made before the shuffle.
    """
    b_asks = F.col("side") == "b"
    review = log.where("type = 'review_match'").select(
        F.when(b_asks, F.col("candidate_id")).otherwise(F.col("id")).alias("a_id"), F.when(b_asks, F.col("id")).otherwise(F.col("candidate_id")).alias("b_id"),
        "seq", F.lit("review").alias("relationship_type"), "score", "rank", "reason",
    )
    confirm = log.where("type = 'crossmap_confirm'").select(*PAIR, "seq", F.lit("match").alias("relationship_type"), "score", "rank", "reason")
    said = confirm.unionByName(review).groupBy(*PAIR).agg(F.max(F.struct("seq", "relationship_type", "score", "rank", "reason")).alias("x")).select(*PAIR, "x.*")
    ended = log.where("type = 'crossmap_break'").groupBy(*PAIR).agg(F.max("seq").alias("broken"))
    kind = F.when(F.col("broken") > F.col("seq"), F.lit("broken")).otherwise(F.col("relationship_type"))
    return said.join(ended, PAIR, "left").select(*PAIR, "score", "rank", kind.alias("relationship_type"), "reason")


def no_match_of(log: DataFrame) -> DataFrame:
    """(b_id, best_score, best_a_id) of B records whose last verdict is no match."""
    b = log.where("side = 'b'")
    none = b.where("type = 'no_match_below'").select(F.col("id").alias("b_id"), "seq", F.col("score").alias("best_score"), F.col("candidate_id").alias("best_a_id"))
    none = none.groupBy("b_id").agg(F.max(F.struct("seq", "best_score", "best_a_id")).alias("x")).select("b_id", "x.*")
    other = log.where("type in ('crossmap_confirm', 'review_match') or type = 'remove_record' and side = 'b'")
    other = other.select(F.when(F.col("type") == "crossmap_confirm", F.col("b_id")).when((F.col("type") == "review_match") & (F.col("side") == "a"), F.col("candidate_id")).otherwise(F.col("id")).alias("b_id"), F.col("seq").alias("later"))
    other = other.groupBy("b_id").agg(F.max("later").alias("later"))
    return none.join(other, "b_id", "left").where("later is null or later < seq").select("b_id", "best_score", "best_a_id")


def scored_of(scoring_log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, field_scores) of a scoring log; of a pair that was scored several times one row."""
    each = scoring_log.select("b_id", F.explode("candidates").alias("c")).select("b_id", "c.*")
    fields = each.select(*PAIR, F.explode("field_scores").alias("f")).select(*PAIR, "f.*")
    return each.select("b_id", "rank", "a_id", "score").dropDuplicates(["b_id", "a_id"]), fields.dropDuplicates([*PAIR, "field_a", "field_b", "method"])


def build(log: DataFrame, b: DataFrame, scoring_log: DataFrame | None = None) -> Built:
    """log: events of one run, ordered by seq. b (b_id, ...): the records of side B; those the log removed are left out.

    Candidates of rank 1 that neither matched nor went to review are kept as such, to be listed as near misses.
    """
    spark = log.sparkSession
    known = relationships_of(log)
    taken = known.where("relationship_type in ('match', 'review')").select("b_id").distinct()
    gone = latest(log.where("type in ('remove_record', 'upsert_record') and side = 'b'").select("id", "type", "seq"), ["id"]).where("type = 'remove_record'").select(F.col("id").alias("b_id"))
    unmatched = b.join(gone, "b_id", "left_anti").join(taken, "b_id", "left_anti").join(no_match_of(log), "b_id", "left")
    if scoring_log is None:
        candidates = spark.createDataFrame([], "b_id string, rank int, a_id string, score double")
        fields = spark.createDataFrame([], "a_id string, b_id string, field_a string, field_b string, method string, score double, weight double")
    else:
        candidates, fields = scored_of(scoring_log)
    more = candidates.join(known, PAIR, "left_anti").select(*PAIR, "score", "rank", F.lit("candidate").alias("relationship_type"), F.lit(None).cast("string").alias("reason"))
    return Built(known.unionByName(more), unmatched, candidates.where("rank > 1"), fields)


def last_run(spark: SparkSession, path: str) -> str | None:
    """The run that was logged last; a log keeps the events of each run apart."""
    last = readers.match_log(spark, path).where("run_id is not null").groupBy("run_id").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "run_id").head()
    return last["run_id"] if last else None


def export(spark: SparkSession, c: Config, run_id: str | None = None) -> Built:
    """Write the CSV and Parquet tables of a logged run (by default the last) again. Nothing is matched, and neither the
    cross-map nor the logs are touched."""
    from linkwright.plans.job import load_sides

    base = c.output["path"]
    run_id = run_id or last_run(spark, f"{base}/match_log")
    a, b = load_sides(spark, c)
    scored = readers.scoring_log(spark, f"{base}/scoring_log") if c.scoring_log and sinks.recovered(spark, f"{base}/scoring_log") else None
    if scored is not None and "run_id" in scored.columns:
        scored = scored.where(F.col("run_id") == run_id)
    made = build(readers.match_log(spark, f"{base}/match_log", run_id), b, scored)
    rows = sinks.relationship_rows(made.relationships, a, c.output_mapping)
    folder = c.output.get("csv_dir") or base
    sinks.write_csv(rows, f"{folder}/relationships.csv", ["b_id", "a_id"])
    sinks.write_csv(made.unmatched, f"{folder}/unmatched.csv", ["b_id"])
    sinks.write_csv(made.candidates, f"{folder}/candidates.csv", ["b_id", "rank"])
    unmatched_a = a.join(made.relationships.where("relationship_type in ('match', 'review')").select("a_id"), "a_id", "left_anti")
    sinks.write_csv(unmatched_a, f"{folder}/unmatched_a.csv", ["a_id"])
    if folder := c.output.get("parquet_dir"):
        for name, df in (("relationships", rows), ("unmatched", made.unmatched), ("candidates", made.candidates), ("field_scores", made.field_scores)):
            sinks.write_parquet(df, f"{folder}/{name}.parquet")
    return made
