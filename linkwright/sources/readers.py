"""Readers: datasets of strings, pair tables, dictionaries, logs."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators.tables import synonym_groups
from linkwright.plans.config import FORMATS
from linkwright.sources.sinks import _path as sinks_path
from linkwright.sources.sinks import recovered
from linkwright.streaming.events import SCHEMA


def format_of(path: str, format: str | None = None) -> str:
    """The given format, or the one that the extension tells."""
    kind = format or FORMATS.get(path.rstrip("/").rsplit(".", 1)[-1].lower())
    if kind not in ("csv", "parquet", "jsonl"):
        raise ValueError(f"unknown format of {path}")
    return kind


def scan(spark: SparkSession, path: str, format: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """All columns of a dataset as strings, null as empty. Headers are trimmed, CSV values stay as they are; JSON scalars
    become text, arrays and objects JSON text, a line that is no object is an error."""
    kind = format_of(path, format)
    if kind == "csv":
        sep = "\t" if path.lower().endswith(".tsv") else ","
        df = spark.read.csv(path, header=True, inferSchema=False, sep=sep, encoding=encoding, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        df = df.toDF(*[c.strip() for c in df.columns])
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        names = spark.read.json(path, primitivesAsString=True, mode="FAILFAST", encoding=encoding).columns
        df = spark.read.schema(", ".join(f"`{n}` string" for n in names)).json(path, mode="FAILFAST", encoding=encoding)
    nested = {n for n, t in df.dtypes if t.startswith(("struct", "array", "map"))}
    return df.select(*[F.coalesce(F.to_json(f"`{c}`") if c in nested else F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def load(spark: SparkSession, path: str, id_field: str, side: str, required: Sequence[str] = (), format: str | None = None, encoding: str = "utf-8", check: bool = True) -> DataFrame:
    """A side of a job: <side>_id, trimmed, and its required fields as <side>_<field>; missing ones are empty.

    With `check`, an empty or repeated id is an error, found by one aggregation over the ids.
    """
    df = scan(spark, path, format, encoding)
    if id_field not in df.columns:
        raise ValueError(f"{path} has no column {id_field}")
    fields = [n for n in (required or df.columns) if n != id_field]
    out = df.select(
        F.trim(F.col(f"`{id_field}`")).alias(f"{side}_id"),
        *[(F.col(f"`{n}`") if n in df.columns else F.lit("")).alias(f"{side}_{n}") for n in fields],
        *([F.trim(F.col(f"`{id_field}`")).alias(f"{side}_{id_field}")] if id_field in required and id_field != "id" else []),
    )
    if check:
        bad = out.groupBy(f"{side}_id").count().where(F.col("count") > 1).unionByName(out.where(F.col(f"{side}_id") == "").select(f"{side}_id", F.lit(1).cast("long").alias("count")).limit(1)).head()
        if bad is not None:
            raise ValueError(f"{path}: id {bad[0]!r} is {'empty' if not bad[0] else 'repeated'}")
    return out


def row_count(spark: SparkSession, path: str, format: str | None = None) -> int:
    return scan(spark, path, format).count()


def fingerprint(spark: SparkSession, path: str) -> str:
    """Length and time of change of a file, or of a folder's files: what tells that a source is as it was."""
    at, fs = sinks_path(spark, path)
    total = fs.getContentSummary(at).getLength()
    files = [f.getModificationTime() for f in fs.listStatus(at)]
    return f"{total}:{max(files, default=0)}"


def pairs(spark: SparkSession, path: str | None, a_field: str, b_field: str) -> DataFrame:
    """(a_id, b_id) of a pair table; a missing file or column gives none, blank ids are skipped."""
    empty = spark.createDataFrame([], "a_id string, b_id string")
    if not path or not recovered(spark, path):
        return empty
    df = scan(spark, path, FORMATS.get(path.rstrip("/").rsplit(".", 1)[-1].lower(), "csv"))
    if a_field not in df.columns or b_field not in df.columns:
        return empty
    out = df.select(F.trim(F.col(f"`{a_field}`")).alias("a_id"), F.trim(F.col(f"`{b_field}`")).alias("b_id"))
    return out.where("a_id <> '' and b_id <> ''").distinct()


def dictionary(spark: SparkSession, path: str | None, most: int = 1_000_000) -> DataFrame | None:
    """(term, group_id) of a headerless CSV file whose rows are groups of equivalent terms. Groups are merged on the driver;
    a file of more than `most` rows is an error, not a reason to fill its memory."""
    if not path:
        return None
    lines = [r["value"] for r in spark.read.text(path).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"{path} has more than {most} rows")
    return synonym_groups(spark, csv.reader(lines))


def match_log(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """A match log, of one run if asked; lines that are no events are left out."""
    recovered(spark, path)
    df = spark.read.schema(SCHEMA + ", run_id string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    df = df.where(F.col("_bad").isNull() & F.col("type").isNotNull()).drop("_bad")
    return df.where(F.col("run_id") == run_id) if run_id else df


def scoring_log(spark: SparkSession, path: str) -> DataFrame:
    """(b_id, candidates) of what was scored: Parquet, or JSON lines, compressed or not, of type `scored`."""
    if format_of(path, "parquet" if not path.endswith((".json", ".ndjson", ".jsonl", ".zst", ".gz")) else "jsonl") == "parquet":
        return spark.read.parquet(path)
    return spark.read.json(path).where("type = 'scored'")


def match_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The match log as a stream of events."""
    return spark.readStream.schema(SCHEMA).json(path)
