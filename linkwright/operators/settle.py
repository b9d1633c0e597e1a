"""Results that several later stages read, kept as files with a plan of their own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, set for checkpoints. Only a local session gets a temporary one where none is set:
    on a cluster executors would not share it."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isEmpty():
        return known.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="linkwright-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a table in the scratch folder: later plans start at its files, know their true size, and
    survive lost executors. (A checkpoint would carry estimates of sizes on, which multiply from join to join.)"""
    path = scratch(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, deleted when the application ends."""
    sc = spark.sparkContext
    base = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/scratch-{sc.applicationId}")
    base.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(base)
    return f"{base.toString()}/{uuid.uuid4().hex[:12]}/{name}"
