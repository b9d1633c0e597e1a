"""Exact deduplication by sorting contents.

Spark samples splitters for a range partitioning on the first bytes of the normalised text and its hash, each
partition is sorted externally by them and the whole text, and neighbours of equal text form a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.shared import save, small


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda c: c,
    keep: str = "smallest",
    hot_fraction: float = 1e-5,
    hot_rows: int = 500,
    salts: int = 64,
) -> DataFrame:
    """One row per input row: `row` (a struct of all input columns), keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the row with the smallest (or largest) id stays; null ids come last.
    Of rows with the same id and text exactly one stays. Input columns may have any names, as they travel in a struct.

    A text that makes up hot_fraction of all rows (and hot_rows at least) is spread over `salts` runs by the hash of
    its id. At most 1 / hot_fraction texts can be that frequent, which bounds both tables that may be broadcast here; their
    groups are put together from sums made before the shuffle. Texts are shuffled once, within their rows.
    """
    largest = keep == "largest"
    best = F.max if largest else F.min
    text = lambda c: normalise(F.coalesce(c, F.lit("")))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), text(F.col(f"`{text_col}`")).alias("t"))
    base = base.withColumn("h", F.xxhash64("t"))
    most = max(hot_rows, int(docs.count() * hot_fraction))
    hot = save(base.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).select("h"), "hot-texts")
    whole = base.join(small(hot), "h", "left_semi").groupBy("t").agg(best("id").alias("hot_id"), F.count(F.lit(1)).alias("hot_size"))
    whole = save(whole.select(F.sha2("t", 256).alias("hot_sha"), "hot_id", "hot_size"), "hot-groups")
    dealt = (
        base.join(small(hot.withColumn("hot", F.lit(True))), "h", "left")
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(0)))
        .select("row", "id", "h", "salt", F.substring(F.encode("t", "utf-8"), 1, 16).alias("head"))
        .repartitionByRange("head", "h", "salt")
        .withColumn("t", text(F.col("row").getField(text_col)))
    )
    run = Window.partitionBy("head", "h", "salt", "t")
    order = F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()
    runs = dealt.select(
        "row",
        "id",
        F.row_number().over(run.orderBy(order)).alias("place"),
        best("id").over(run).alias("run_id"),
        F.count(F.lit(1)).over(run).alias("run_size"),
        F.sha2("t", 256).alias("text_sha256"),
    )
    keep_id = F.when(F.col("hot_size").isNull(), F.col("run_id")).otherwise(F.col("hot_id"))
    return runs.join(small(whole), F.col("text_sha256") == F.col("hot_sha"), "left").select(
        "row",
        keep_id.alias("keep_id"),
        F.coalesce("hot_size", "run_size").alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the input's own columns."""
    return exact_groups(docs, **options).where("kept").select("row.*")
