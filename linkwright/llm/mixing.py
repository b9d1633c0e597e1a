"""Mixing sources to target weights by nested thresholds on a hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.shared import save, small

#: Bits of a row's hash, and bits resolved by each histogram.
BITS, STEP = 60, 10


def words(text: Column) -> Column:
    """The number of words, runs of anything but the six ASCII spaces; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text: the same on every run and in any SQL engine."""
    joined = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """sizes (source, source_size), one row per source, with its target.

    Sources by code point, null last, have the weights in turn and share the sum of all sizes. A target stops at `cap`
    times its source's size; the excess is shared anew. In ascending order of cap per weight, the sources before the
    first that stays below its cap are those that reach it.
    """
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("level", F.col("most") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("below", F.col("left") * F.col("weight") <= F.col("most") * F.col("left_weight"))
    )
    first = F.min_by(F.struct("left", "left_weight", "level", "place"), F.when(F.col("below"), F.struct("level", "place"))).over(Window.partitionBy())
    return ranked.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(F.struct("level", "place") < F.struct("first.level", "first.place"), F.col("most").cast("double"))
        .otherwise(F.least(F.col("first.left").cast("double") * F.col("weight") / F.col("first.left_weight"), F.col("most").cast("double")))
        .alias("target"),
    )


def mixture_plan(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """rows (source, size, h) -> per source: source_size, target, copies, bound.

    A row is taken `copies` times, and once more if h < bound. Each histogram sums sizes by source and the next STEP
    bits of h within the source's boundary bucket; the bucket in which the running sum crosses the budget is refined
    by the next one, until it holds one hash value, which is taken if that comes nearer to the budget. Rows that share
    a hash (the same id and text) are thus taken together. Everything between rows and result is a few rows a source.
    """
    sizes = save(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    ratio = F.col("target") / F.col("source_size")
    state = (
        targets(sizes, weights, cap)
        .withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.floor(ratio), F.lit(cap))).otherwise(F.lit(0)).cast("long"))
        .withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("taken", F.lit(0).cast("long"))
        .withColumn("bound", F.when(F.col("budget") <= 0, F.lit(0)).cast("long"))
    )
    state = save(state, "mix-state")
    for shift in range(BITS - STEP, -1, -STEP):
        if not state.where("bound is null").head(1):
            break
        open_ = state.where("bound is null").select(F.col("source").alias("s"), "prefix", "taken", "budget")
        inside = rows.join(small(open_), F.col("source").eqNullSafe(F.col("s"))).where(F.shiftright("h", shift + STEP) == F.col("prefix"))
        counted = inside.groupBy("s", "taken", "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        running = counted.withColumn("upto", F.col("taken") + F.sum("n").over(Window.partitionBy("s").orderBy("bucket")))
        edge = running.where("upto > budget and upto - n <= budget").select(F.col("s").alias("es"), "bucket", "n", "low", "high", (F.col("upto") - F.col("n")).alias("below"))
        more = F.col("budget") - F.col("below") >= F.col("n") / 2
        found = (
            F.when(F.col("state.bound").isNotNull(), F.col("state.bound"))
            .when(F.col("bucket").isNull(), F.lit(1 << BITS))
            .when(F.col("low") == F.col("high"), F.col("low") + more.cast("long"))
        )
        state = save(
            state.alias("state")
            .join(edge, F.col("source").eqNullSafe(F.col("es")) & F.col("bound").isNull(), "left")
            .select("source", "source_size", "target", "copies", "budget", F.coalesce("bucket", "prefix").alias("prefix"), F.coalesce("below", "taken").alias("taken"), found.alias("bound")),
            "mix-state",
        )
    return state.select(F.col("source").alias("plan_source"), "source_size", "target", "copies", "bound")


def planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, h, ...) joined to their source's plan, with `times` that each is taken."""
    joined = rows.join(small(plan), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    return joined.withColumn("times", F.col("copies") + (F.col("h") < F.col("bound")).cast("long"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: each input row as many times as it is taken, with the input's own columns.

    Null texts have no words: they follow their hash like others and weigh nothing. The null source is a source.
    """
    doc_id, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    plan = mixture_plan(measured(docs, id_col, text_col, source_col), weights, cap)
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("source"), row_hash(doc_id, text).alias("h"))
    return planned(carried, plan).where("times > 0").select(F.explode(F.array_repeat("row", F.col("times").cast("int"))).alias("row")).select("row.*")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The narrow table (doc_id, source, size, h) on which mixtures are planned, saved since each histogram reads it."""
    doc_id, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    return save(docs.select(doc_id.alias("doc_id"), source.alias("source"), words(text).alias("size"), row_hash(doc_id, text).alias("h")), "measured")
