"""Ranking, the gap check, classification, and the one-to-one claim."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwright.functions.scalar import classify
from linkwright.operators.settle import settled


def best_first():
    return Window.partitionBy("b_id").orderBy(F.desc("score"), "a_id")


def ranked(pairs: DataFrame, auto: float, floor: float, min_gap: float = 0.0, top_n: int = 0) -> DataFrame:
    """pairs (b_id, a_id, score) with rank (1 is best, at most 255), classification and reason, cut to top_n.

    If the best is an auto match and leads the second by less than min_gap, it is only up for review, as downgraded.
    Ranks and gaps are settled before the cut.
    """
    second = F.lead("score").over(best_first())
    close = (F.col("rank") == 1) & (F.col("score") >= auto) & (F.col("score") - F.col("_second") < min_gap)
    out = (
        pairs.withColumn("_place", F.row_number().over(best_first()))
        .withColumn("_second", second)
        .withColumn("rank", F.least("_place", F.lit(255)).cast("int"))
        .withColumn("reason", F.when(F.coalesce(close, F.lit(False)), "downgraded").otherwise("top_scoring"))
        .withColumn("classification", F.when(F.col("reason") == "downgraded", "review").otherwise(classify(F.col("score"), auto, floor)))
    )
    return (out.where(F.col("_place") <= top_n) if top_n else out).drop("_second", "_place")


def claim(ranks: DataFrame, auto: float, mapped: DataFrame | None = None, small: int = 200_000) -> DataFrame:
    """(b_id, a_id, score, rank, reason) of the pairs that are confirmed, one to one.

    The outcome is that of going through the queries by b_id, each taking its best auto match (by score, then a_id; rank is
    only shown) that is still free. All records of A rank the queries alike, by b_id, so deferred acceptance gives just
    that: in each round every query without a holder proposes to its best candidate that does not hold a smaller b_id, and
    a candidate holds the smallest that has proposed to it. At most `small` contested edges are settled in one task on the
    driver; beyond that in rounds whose tables are checkpointed.
    """
    edges = ranks.where(F.col("score") >= auto).select("b_id", "a_id", "score", "rank", "reason")
    if mapped is not None:
        edges = edges.join(mapped.select("a_id"), "a_id", "left_anti").join(mapped.select("b_id"), "b_id", "left_anti")
    spark = ranks.sparkSession
    edges = settled(edges)
    pairs = edges.limit(small + 1).select("b_id", "a_id", "score").collect()
    if len(pairs) <= small:
        won = _serial(spark, edges, pairs)
    else:
        won = _rounds(edges)
    return edges.join(won, ["b_id", "a_id"])


def _serial(spark: SparkSession, edges: DataFrame, pairs: list) -> DataFrame:
    taken: set = set()
    done: set = set()
    won = []
    for r in sorted(pairs, key=lambda r: (r["b_id"], -r["score"], r["a_id"])):
        if r["b_id"] not in done and r["a_id"] not in taken:
            done.add(r["b_id"])
            taken.add(r["a_id"])
            won.append((r["b_id"], r["a_id"]))
    return spark.createDataFrame(won, edges.select("b_id", "a_id").schema)


def _rounds(edges: DataFrame) -> DataFrame:
    """Deferred acceptance: the pairs that are held when nobody is left to propose.

    Only queries that were turned down or displaced ask again, further down their lists, and they pass over candidates
    that hold a smaller b_id already, since those would turn them down.
    """
    lists = settled(edges.withColumn("place", F.row_number().over(best_first())).select("b_id", "a_id", "place"))
    held = lists.limit(0)
    asking = lists.select("b_id").distinct().withColumn("from", F.lit(1))
    while True:
        left = lists.join(asking, "b_id").where(F.col("place") >= F.col("from")).join(held.select("a_id", F.col("b_id").alias("holder")), "a_id", "left")
        proposals = left.where("holder is null or b_id < holder").groupBy("b_id").agg(F.min(F.struct("place", "a_id")).alias("x")).select("b_id", "x.a_id", "x.place")
        every = settled(held.unionByName(proposals))
        first = every.groupBy("a_id").agg(F.min("b_id").alias("holder"))
        judged = settled(every.join(first, "a_id"))
        held = judged.where("b_id = holder").select("b_id", "a_id", "place")
        lost = judged.where("b_id <> holder")
        if not lost.head(1):
            return held.select("b_id", "a_id")
        asking = lost.select("b_id", (F.col("place") + 1).alias("from"))


def outcomes(ranks: DataFrame, claims: DataFrame, queries: DataFrame, auto: float, floor: float) -> DataFrame:
    """One row per query (b_id): relationship_type (match, review, no_match), a_id, score, rank, reason.

    A query without a claim gets its first candidate below auto: review if it reaches the floor, else no_match; if
    all its candidates were auto matches taken by others, no_match with its best score.
    """
    lost, order = ranks.join(claims.select("b_id"), "b_id", "left_anti"), F.struct(-F.col("score"), "a_id")
    found = F.struct("a_id", "score", "rank", "reason")
    firsts = lost.groupBy("b_id").agg(F.min_by(found, F.when(F.col("score") < auto, order)).alias("x"), F.min_by(found, order).alias("y"))
    other = queries.select("b_id").join(claims.select("b_id"), "b_id", "left_anti").join(firsts, "b_id", "left")
    review = F.col("x.score") >= floor
    pick = F.coalesce(F.col("x"), F.col("y"))
    rest = other.select("b_id", F.when(review, "review").otherwise("no_match").alias("relationship_type"), pick["a_id"].alias("a_id"), pick["score"].alias("score"), pick["rank"].alias("rank"), F.when(review, pick["reason"]).otherwise(F.lit("below_floor")).alias("reason"))
    return claims.select("b_id", F.lit("match").alias("relationship_type"), "a_id", "score", "rank", "reason").unionByName(rest)
