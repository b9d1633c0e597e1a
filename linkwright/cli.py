"""Command line: validate, run, tune, export, crossmap, cache, enroll, serve."""

from __future__ import annotations

import argparse
import sys

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkwright.operators import analysis, tables
from linkwright.operators.settle import checkpoint_dir
from linkwright.plans import build, cache, job
from linkwright.plans import config as cfg
from linkwright.sources import readers, sinks
from linkwright.streaming import enroll
from linkwright.streaming import events as ev
from linkwright.streaming.hooks import HookWriter
from linkwright.streaming.live import LiveSession


def session() -> SparkSession:
    """The session of the cluster that submits the command; refused if it has no checkpoint folder that executors share."""
    spark = (
        SparkSession.builder.appName("linkwright")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    checkpoint_dir(spark)
    return spark


def tune(spark: SparkSession, c: cfg.Config) -> dict:
    """Scores without what is known, judged by the common identifiers."""
    a, b = job.load_sides(spark, c)
    result = job.match(c, a, b, spark.createDataFrame([], "a_id string, b_id string"), None, readers.dictionary(spark, c.dictionary), prematching=False)
    if not (c.a.common_id_field and c.b.common_id_field):
        return {"histogram": analysis.histogram(result.relationships.fillna(0.0, ["score"]))}
    judged = analysis.populations(result.relationships, job.truth(c, a, b)).persist()
    fields = result.field_scores.join(judged.select("b_id", "a_id", "population"), ["b_id", "a_id"])
    return {
        "histogram": analysis.histogram(judged, by="population"),
        "overlap": analysis.overlap_coefficient(judged),
        "accuracy": analysis.accuracy(judged),
        "fields": analysis.field_stats(fields),
        "zone": analysis.overlap_zone(judged, c.floor).limit(50),
    }


def crossmap(spark: SparkSession, c: cfg.Config, action: str, file: str | None) -> None:
    pairs = readers.pairs(spark, c.crossmap_path, c.crossmap_a, c.crossmap_b)
    if action == "stats":
        tables.crossmap_stats(pairs, *job.load_sides(spark, c)).show()
    elif action == "export":
        sinks.write_pairs(pairs, file, c.crossmap_a, c.crossmap_b)
    else:
        more = readers.pairs(spark, file, c.crossmap_a, c.crossmap_b)
        sinks.write_pairs(tables.crossmap_add(pairs, more), c.crossmap_path, c.crossmap_a, c.crossmap_b)


def vectors(spark: SparkSession, c: cfg.Config, action: str) -> None:
    """The cache of vectors of embeddings.cache_dir."""
    path = c.encoder.get("cache_dir")
    if not path:
        raise cfg.ConfigError("embeddings.cache_dir is missing")
    if action == "clear":
        cache.clear(spark, path, job.model_of(c))
        return
    if action == "build":
        for side, df in zip("ab", job.load_sides(spark, c)):
            job.with_vectors(c, df, side)  # encodes what the cache lacks
    cache.status(spark, path).show(truncate=False)


def enrolment(spark: SparkSession, raw: dict, out: str) -> None:
    """The edges of a pool in order of its ids, as Parquet."""
    c = cfg.enroll_from_dict(raw)
    fields = [f.field_a for f in c["fields"]]
    pool = readers.load(spark, c["path"], c["id_field"], "a", [*fields, *c["blocks"]])
    pool = pool.select(F.col("a_id").alias("id"), F.col("a_id").alias("seq"), *[F.col(f"a_{f}").alias(f) for f in dict.fromkeys([*fields, *c["blocks"]])])
    sinks.write_parquet(enroll.edges(pool, c["blocks"], c["fields"], c["floor"], c["top_n"]), out)


def serve(spark: SparkSession, c: cfg.Config, events: str, state: str, checkpoint: str, once: bool) -> None:
    """Apply the JSON events that appear in a folder, a few files at a time, and write the outputs at the end."""
    live = LiveSession(spark, c, state, HookWriter(c.hooks.split()) if c.hooks else None, readers.dictionary(spark, c.dictionary))
    stream = spark.readStream.schema(ev.SCHEMA).option("maxFilesPerTrigger", 10).json(events)
    try:
        live.start(stream, checkpoint, once).awaitTermination()
    finally:
        live.flush()


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="linkwright", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    command = {name: sub.add_parser(name) for name in ("validate", "run", "tune", "export", "crossmap", "cache", "enroll", "serve")}
    command["crossmap"].add_argument("action", choices=["stats", "export", "import"])
    command["cache"].add_argument("action", choices=["build", "status", "clear"])
    for x in command.values():
        x.add_argument("config")
    command["crossmap"].add_argument("--file")
    command["export"].add_argument("--run-id")
    command["enroll"].add_argument("--out", required=True)
    for name in ("--events", "--state", "--checkpoint"):
        command["serve"].add_argument(name, required=True)
    command["serve"].add_argument("--once", action="store_true")
    a = p.parse_args(args)
    try:
        if a.command == "enroll":
            with open(a.config, encoding="utf-8") as f:
                raw = yaml.safe_load(f)
            cfg.enroll_from_dict(raw)
        else:
            c = cfg.load(a.config)
    except (cfg.ConfigError, OSError, yaml.YAMLError) as e:
        print(f"invalid: {e}", file=sys.stderr)
        return 1
    if a.command == "validate":
        print(f"valid: {c.name}")
        return 0
    spark = session()
    if a.command == "run":
        analysis.outcome_counts(job.run(spark, c).relationships).show()
    elif a.command == "export":
        made = build.export(spark, c, a.run_id)
        made.relationships.groupBy("relationship_type").count().show()
    elif a.command == "tune":
        for name, df in tune(spark, c).items():
            print(name)
            df.show(100, truncate=False)
    elif a.command == "crossmap":
        crossmap(spark, c, a.action, a.file)
    elif a.command == "cache":
        vectors(spark, c, a.action)
    elif a.command == "enroll":
        enrolment(spark, raw, a.out)
    else:
        serve(spark, c, a.events, a.state, a.checkpoint, a.once)
    return 0


if __name__ == "__main__":
    sys.exit(main())
