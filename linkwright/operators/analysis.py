"""Statistics of results: outcome counts, score populations, accuracy, histograms, overlap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome_counts(outcomes: DataFrame, skipped: int = 0) -> DataFrame:
    """One row: total, auto, review, no_match, skipped."""
    n = lambda t: F.count_if(F.col("relationship_type") == t)
    return outcomes.agg(F.count(F.lit(1)).alias("total"), n("match").alias("auto"), n("review").alias("review"), n("no_match").alias("no_match"), F.lit(skipped).cast("long").alias("skipped"))


def coverage(a: DataFrame, b: DataFrame, crossmap: DataFrame) -> DataFrame:
    """One row: records, matched and unmatched of either side, and the matched share."""
    na = a.join(crossmap.select("a_id", F.lit(1).alias("m")), "a_id", "left").agg(F.count(F.lit(1)).alias("a_total"), F.count("m").alias("a_matched"))
    nb = b.join(crossmap.select("b_id", F.lit(1).alias("m")), "b_id", "left").agg(F.count(F.lit(1)).alias("b_total"), F.count("m").alias("b_matched"))
    share = lambda s: F.when(F.col(f"{s}_total") > 0, F.col(f"{s}_matched") / F.col(f"{s}_total")).otherwise(F.lit(0.0))
    return na.crossJoin(nb).select(
        *[c for s in "ab" for c in (F.col(f"{s}_total"), F.col(f"{s}_matched"), (F.col(f"{s}_total") - F.col(f"{s}_matched")).alias(f"{s}_unmatched"), share(s).alias(f"{s}_coverage"))]
    )


def summary(relationships: DataFrame) -> DataFrame:
    return relationships.groupBy("relationship_type", "reason").agg(
        F.count(F.lit(1)).alias("count"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score")
    )


def populations(outcomes: DataFrame, truth: DataFrame) -> DataFrame:
    """outcomes with population (match or nonmatch) and verdict (auto_tp, auto_fp, review_tp, review_fp, fn, tn) by the
    true pairs (b_id, true_a_id). A query without any score counts as 0."""
    known = outcomes.join(truth.select("b_id", "true_a_id"), "b_id", "left")
    right = F.coalesce(F.col("a_id") == F.col("true_a_id"), F.lit(False))
    kind = F.col("relationship_type")
    verdict = (
        F.when(kind == "match", F.when(right, "auto_tp").otherwise("auto_fp"))
        .when(kind == "review", F.when(right, "review_tp").otherwise("review_fp"))
        .otherwise(F.when(F.col("true_a_id").isNotNull(), "fn").otherwise("tn"))
    )
    out = known.withColumn("verdict", verdict).withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.withColumn("population", F.when(F.col("verdict").isin("auto_tp", "review_tp", "fn"), "match").otherwise("nonmatch"))


def accuracy(judged: DataFrame) -> DataFrame:
    """One row: the verdicts' counts, precision, recall of auto matches and combined with reviews (null without a base)."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    counts = judged.agg(*[n(v).alias(v) for v in ("auto_tp", "auto_fp", "review_tp", "review_fp", "fn", "tn")])
    true = F.col("auto_tp") + F.col("review_tp") + F.col("fn")
    over = lambda x, y: F.when(y > 0, x / y)
    return counts.withColumn("precision", over(F.col("auto_tp"), F.col("auto_tp") + F.col("auto_fp"))).withColumn("recall_auto", over(F.col("auto_tp"), true)).withColumn("recall_combined", over(F.col("auto_tp") + F.col("review_tp"), true))


def bucket(score: Column, width: float) -> Column:
    """The histogram bucket of a score; one more than fit into [0, 1] takes what is beyond."""
    return F.least(F.floor(score / F.lit(width)), F.lit(math.ceil(1 / width))).cast("int")


def histogram(scores: DataFrame, width: float = 0.04, by: str | None = None) -> DataFrame:
    """(bucket, low, n), by population if asked; empty buckets have no row."""
    keys = [bucket(F.col("score"), width).alias("bucket")] + ([F.col(by)] if by else [])
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("low", F.col("bucket") * F.lit(width))


def overlap_coefficient(judged: DataFrame, width: float = 0.02) -> DataFrame:
    """One row, overlap: the shared area of the two populations' normalised histograms."""
    m = lambda p: F.count_if(F.col("population") == p)
    each = judged.groupBy(bucket(F.col("score"), width).alias("bucket")).agg(m("match").alias("m"), m("nonmatch").alias("u"))
    total = judged.agg(F.greatest(m("match"), F.lit(1)).alias("mt"), F.greatest(m("nonmatch"), F.lit(1)).alias("ut"))
    return each.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(F.least(F.col("m") / F.col("mt"), F.col("u") / F.col("ut"))), F.lit(0.0)).alias("overlap"))


def field_stats(scores: DataFrame) -> DataFrame:
    """scores (field_a, field_b, method, score, population) -> per field: n, min, max, mean, median, stddev, the means of
    either population, their gap and its label."""
    mean = lambda p: F.avg(F.when(F.col("population") == p, F.col("score")))
    out = scores.groupBy("field_a", "field_b", "method").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("min"), F.max("score").alias("max"), F.avg("score").alias("mean"),
        F.percentile("score", F.lit(0.5)).alias("median"), F.stddev_pop("score").alias("stddev"), mean("match").alias("match_mean"), mean("nonmatch").alias("nonmatch_mean"),
    )
    gap = F.col("match_mean") - F.col("nonmatch_mean")
    return out.withColumn("gap", gap).withColumn("label", F.when(gap < 0.05, "weak").when(gap < 0.15, "moderate").when(gap.isNotNull(), "strong"))


def overlap_zone(judged: DataFrame, floor: float) -> DataFrame:
    """Rows worth a look: reviews, split by the truth, and misses whose best score came within a fifth of the floor."""
    near = (F.col("verdict") == "fn") & (F.col("score") >= 0.8 * floor)
    zone = F.when(F.col("verdict") == "review_tp", "review_match").when(F.col("verdict") == "review_fp", "review_nonmatch").when(near, "missed_near_floor")
    return judged.withColumn("zone", zone).where("zone is not null")


def evaluation(judged: DataFrame, reachable: DataFrame) -> DataFrame:
    """One row: true pairs, those that blocking or prefilter can reach (b_id), and precision and recall against that ceiling."""
    with_ = judged.join(reachable.select("b_id", F.lit(True).alias("in_reach")).distinct(), "b_id", "left")
    has = F.col("true_a_id").isNotNull()
    counts = with_.agg(
        F.count_if(has).alias("true_pairs"), F.count_if(has & F.coalesce("in_reach", F.lit(False))).alias("ceiling"),
        F.count_if(F.col("verdict") == "auto_tp").alias("tp"), F.count_if(F.col("verdict") == "auto_fp").alias("fp"), F.count_if(F.col("verdict") == "fn").alias("missed"),
    )
    return counts.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))).withColumn("ceiling_recall", F.when(F.col("ceiling") > 0, F.col("tp") / F.col("ceiling")))


def round_evaluation(outcomes: DataFrame, truth: DataFrame, reachable: DataFrame) -> DataFrame:
    """One row of a tuning round's counts. truth (b_id, match_type, true_a_id): matched records have a true partner,
    ambiguous ones cannot be told, unmatched ones have none.

    False positives are split into wrong (another partner was true), ambiguous and unmatched; recall is taken against the
    true pairs that blocking can reach (b_id) and against all.
    """
    each = truth.join(outcomes.select("b_id", "relationship_type", "a_id"), "b_id", "left").join(reachable.select("b_id", F.lit(True).alias("in_reach")).distinct(), "b_id", "left")
    kind, auto, review = F.col("match_type"), F.col("relationship_type") == "match", F.col("relationship_type") == "review"
    right, matched = (kind == "matched") & (F.col("a_id") == F.col("true_a_id")), kind == "matched"
    unseen = ~F.coalesce(auto | review, F.lit(False))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = {"auto": n(auto), "review": n(review), "total": n(matched), "ceiling": n(matched & F.col("in_reach")), "fn": n(matched & unseen), "fn_ambiguous": n((kind == "ambiguous") & unseen), "tn": n((kind == "unmatched") & unseen)}
    for name, seen in (("auto", auto), ("review", review)):
        counts |= {f"{name}_tp": n(seen & right), f"{name}_fp_wrong": n(seen & matched & ~right), f"{name}_fp_ambiguous": n(seen & (kind == "ambiguous")), f"{name}_fp_unmatched": n(seen & (kind == "unmatched"))}
    over = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    out = each.agg(*[c.alias(k) for k, c in counts.items()])
    return out.withColumns({
        "precision": over(F.col("auto_tp"), F.col("auto")), "recall_ceiling": over(F.col("auto_tp"), F.col("ceiling")),
        "recall_total": over(F.col("auto_tp"), F.col("total")), "combined_recall": over(F.col("auto_tp") + F.col("review_tp"), F.col("total")),
    })


def typed_overlap(outcomes: DataFrame, truth: DataFrame, width: float = 0.02) -> DataFrame:
    """One row, overlap: as overlap_coefficient, but ambiguous records count as matched, and of matched ones that were
    paired only those with their true partner do; records without a score count as 0."""
    each = outcomes.join(truth, "b_id", "left")
    paired = F.col("relationship_type").isin("match", "review")
    same = ((F.col("match_type") == "matched") & (~paired | (F.col("a_id") == F.col("true_a_id")))) | (F.col("match_type") == "ambiguous")
    judged = each.select(F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.coalesce(same, F.lit(False)), "match").otherwise("nonmatch").alias("population"))
    return overlap_coefficient(judged, width)


def training_pairs(judged: DataFrame, ambiguous: DataFrame, block: DataFrame, middle: float = 0.87) -> DataFrame:
    """Labelled pairs (b_id, a_id, label) for tuning an encoder, each pair once, with the highest of its labels.

    1.0 for true pairs, `middle` for pairs that cannot be told apart (ambiguous: b_id, a_id), 0.0 for confirmed wrong ones,
    and for other queries with a truth one other candidate of the block (the smallest id).
    """
    label = lambda df, x: df.select("b_id", "a_id", F.lit(x).alias("label"))
    right = label(judged.where("true_a_id is not null").select("b_id", F.col("true_a_id").alias("a_id")), 1.0)
    wrong = label(judged.where("verdict in ('auto_fp', 'review_fp')"), 0.0)
    others = judged.where("verdict not in ('auto_fp', 'review_fp') and true_a_id is not null").select("b_id", "true_a_id").join(block, "b_id").where("a_id <> true_a_id")
    sampled = label(others.groupBy("b_id").agg(F.min("a_id").alias("a_id")), 0.0)
    every = right.unionByName(label(ambiguous, middle)).unionByName(wrong).unionByName(sampled)
    return every.groupBy("b_id", "a_id").agg(F.max("label").alias("label"))
