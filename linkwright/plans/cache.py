"""Vectors by the hash of the text that they encode, kept between jobs and micro-batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.functions.scalar import text_hash
from linkwright.sources.sinks import _path, recovered, replace_table

SCHEMA = "hash string, vector array<double>, model string"


def folder(path: str, model: str) -> str:
    """A model's folder; vectors of different models are never mixed."""
    kept = "".join(x if x.isalnum() else "_" for x in model)[-60:]
    return f"{path.rstrip('/')}/{kept}-{zlib.crc32(model.encode()):08x}"


def stored(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(hash, vector) of what the cache has."""
    at = folder(path, model)
    if not recovered(spark, at):
        return spark.createDataFrame([], SCHEMA).select("hash", "vector")
    return spark.read.schema(SCHEMA).parquet(at).where(F.col("model") == model).dropDuplicates(["hash"]).select("hash", "vector")


def missing(df: DataFrame, text: Column, path: str, model: str) -> DataFrame:
    """(hash, text) of the different texts of df that the cache lacks."""
    wanted = df.select(text_hash(text).alias("hash"), text.alias("text")).dropDuplicates(["hash"])
    return wanted.join(stored(df.sparkSession, path, model).select("hash"), "hash", "left_anti")


def extend(df: DataFrame, text: Column, encode: Callable[[Column], Column], path: str, model: str) -> None:
    """Encode what the cache lacks and append it. Two writers may add the same text; readers take one of them."""
    new = missing(df, text, path, model).select("hash", encode(F.col("text")).alias("vector"), F.lit(model).alias("model"))
    new.write.mode("append").parquet(folder(path, model))


def with_cached(df: DataFrame, text: Column, name: str, encode: Callable[[Column], Column], path: str, model: str) -> DataFrame:
    """df with the vectors of a text column, of which only texts that are new to the cache are encoded."""
    extend(df, text, encode, path, model)
    found = stored(df.sparkSession, path, model).select(F.col("hash").alias("_hash"), F.col("vector").alias(name))
    return df.withColumn("_hash", text_hash(text)).join(found, "_hash", "left").drop("_hash")


def status(spark: SparkSession, path: str) -> DataFrame:
    """(model, texts, dim) of each model in the cache."""
    root, fs = _path(spark, path)
    parts = [spark.read.schema(SCHEMA).parquet(f.getPath().toString()) for f in (fs.listStatus(root) if fs.exists(root) else []) if f.isDirectory()]
    rows = spark.createDataFrame([], SCHEMA)
    for p in parts:
        rows = rows.unionByName(p)
    return rows.dropDuplicates(["model", "hash"]).groupBy("model").agg(F.count(F.lit(1)).alias("texts"), F.max(F.size("vector")).alias("dim"))


def keep(spark: SparkSession, path: str, model: str, hashes: DataFrame) -> None:
    """Drop vectors whose texts are no longer wanted (hash)."""
    left = stored(spark, path, model).join(hashes.select("hash").distinct(), "hash", "left_semi").withColumn("model", F.lit(model))
    replace_table(spark, folder(path, model), lambda p: left.write.parquet(p))


def clear(spark: SparkSession, path: str, model: str | None = None) -> bool:
    """Delete the cache, or a model's part of it."""
    at, fs = _path(spark, folder(path, model) if model else path)
    return fs.delete(at, True)
