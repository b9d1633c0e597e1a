"""Tables in the folder that all executors share, and connected components."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many narrow rows may be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder below spark.checkpoint.dir, deleted when the application ends.

    Where neither the setting nor a checkpoint folder exists, a local session gets a temporary one; on a cluster, whose
    executors would not share it, that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        option = sc._jsc.sc().getCheckpointDir()
        if option.isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="linkwright-"))
            option = sc._jsc.sc().getCheckpointDir()
        root = option.get()
    path = f"{root.rstrip('/')}/linkwright-{sc.applicationId}"
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows. Call it on saved tables, whose count comes from file footers."""
    return F.broadcast(df) if df.count() <= most else df


def _joined(edges: pa.Table) -> pa.Table:
    """Edges (u, v) of longs -> (node, root), in memory."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for u, v in zip(edges["u"].to_pylist(), edges["v"].to_pylist()):
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    return pa.table({"node": pa.array(list(up), pa.int64()), "root": pa.array([find(x) for x in up], pa.int64())})


def components(edges: DataFrame, name: str = "components", few: int = 0) -> DataFrame:
    """Connected components of edges (u, v): one row (node, root) per node, root being the smallest node reachable.

    Alternates the large-star and small-star steps, which need a logarithmic number of rounds. Each step is a
    pre-aggregated minimum and a join in which one side is unique per key, so that skewed centres can be split.
    Null ends and loops are dropped. Up to `few` edges, of longs, are joined on the driver instead, without any shuffle.
    """
    e = save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), name)
    if few and e.count() <= few:
        return e.sparkSession.createDataFrame(_joined(e.toArrow()), "node long, root long")
    before = None
    while True:
        sign = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == before or sign[0] == 0:
            break
        before = sign
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = save(least.select("u", F.col("m").alias("v")).union(moved).distinct(), name)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
