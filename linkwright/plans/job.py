"""The batch job: from two datasets to relationships, as a chain of DataFrame stages."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.functions.encoder import Remote, encoded, onnx_encoder
from linkwright.functions.scalar import combined, cosine, joined
from linkwright.operators import candidates as gen
from linkwright.operators import prematch, ranking, scoring, tables
from linkwright.operators.best import BY_VALUE, best_candidates
from linkwright.operators.settle import settled
from linkwright.plans import cache as vector_cache
from linkwright.plans.config import Config
from linkwright.sources import readers, sinks


@dataclass
class Result:
    relationships: DataFrame  # a_id, b_id, score, rank, relationship_type, reason
    ranks: DataFrame  # all scored candidates within top_n, with field_scores
    crossmap: DataFrame
    a: DataFrame
    b: DataFrame

    @property
    def field_scores(self) -> DataFrame:
        each = self.ranks.select("a_id", "b_id", F.explode("field_scores").alias("f"))
        return each.select("a_id", "b_id", "f.*")


def _encoder_column(c: Config, text):
    if c.encoder.get("remote_encoder_cmd"):
        command = c.encoder["remote_encoder_cmd"]
        command = command if isinstance(command, list) else command.split()
        return encoded(text, lambda: Remote(command, timeout=c.encoder_timeout).encode)
    model = c.encoder.get("model") or "hashed"
    if model == "hashed":
        return encoded(text)
    return encoded(text, lambda: onnx_encoder(f"{model}/model.onnx", f"{model}/tokenizer.json"))


def with_vectors(c: Config, df: DataFrame, side: str, cache: str | None = None) -> DataFrame:
    """df with a vector column vec_<field> for each embedded field, and their weighted combination <side>_vector. With a
    cache folder (by default the configuration's cache_dir) texts that it has are not encoded again."""
    fields, cache = [f for f in c.fields if f.method == "embedding"], cache or c.encoder.get("cache_dir")
    for f in fields:
        name = getattr(f, f"field_{side}")
        text, vector = F.trim(F.col(f"{side}_{name}")), f"vec_{side}_{name}"
        if cache:
            df = vector_cache.with_cached(df, text, vector, lambda x: _encoder_column(c, x), cache, model_of(c))
        else:
            df = df.withColumn(vector, _encoder_column(c, text))
    if fields:
        df = df.withColumn(f"{side}_vector", combined([(F.col(f"vec_{side}_{getattr(f, f'field_{side}')}"), f.weight) for f in fields]))
    return df


def model_of(c: Config) -> str:
    """What a cached vector depends on besides its text."""
    command = c.encoder.get("remote_encoder_cmd")
    return " ".join(command) if isinstance(command, list) else command or c.encoder.get("model") or "hashed"


def candidate_pairs(c: Config, a: DataFrame, b: DataFrame, groups: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The pairs to score, and the BM25 scores of those that BM25 found."""
    named = [(f"b_{y}", f"a_{x}") for x, y in c.blocking]
    methods = {f.method for f in c.fields}
    sources, bm25 = {}, None
    if c.candidates == "blocked":  # asked for explicitly: without blocking fields that is every pair
        sources["blocked"] = gen.block_pairs(b, a, named) if named else b.select("b_id").crossJoin(a.select("a_id"))
    if "embedding" in methods:
        sources["ann"] = gen.nearest_vectors(b, a, c.ann_candidates, named).select("b_id", "a_id")
    if "bm25" in methods:
        qa = a.withColumn("a_text", joined(*[F.col(f"a_{x}") for x, _ in c.bm25_fields]))
        qb = b.withColumn("b_text", joined(*[F.col(f"b_{y}") for _, y in c.bm25_fields]))
        bm25 = gen.bm25_top(qb, qa, c.bm25_candidates, named).select("b_id", "a_id", "bm25")
        bm25 = settled(bm25)
        sources["bm25"] = bm25.select("b_id", "a_id")
    if "synonym" in methods:
        found = None
        for x, y, least in c.synonym_fields:
            one = gen.synonym_pairs(b, a, f"b_{y}", f"a_{x}", least, groups)
            found = one if found is None else found.unionByName(one)
        if named:  # a query with an empty block has no candidates at all
            found = found.join(gen.with_block(b, a, named), "b_id", "left_semi")
        sources["synonym"] = found.distinct()
    if not sources:
        return b.sparkSession.createDataFrame([], "b_id string, a_id string"), bm25
    return gen.union_candidates(**sources).select("b_id", "a_id"), bm25


def score_pairs(c: Config, pairs: DataFrame, a: DataFrame, b: DataFrame, bm25: DataFrame | None, groups: DataFrame | None) -> DataFrame:
    full = pairs.join(b, "b_id").join(a, "a_id")
    if any(f.method == "bm25" for f in c.fields):
        full = full.join(bm25, ["b_id", "a_id"], "left")
    for f in c.fields:
        if f.method == "embedding":
            full = full.withColumn(f"emb_{f.field_a}_{f.field_b}", cosine(F.col(f"vec_a_{f.field_a}"), F.col(f"vec_b_{f.field_b}")))
        if f.method == "synonym":
            for side in "ab":
                name = getattr(f, f"field_{side}")
                if groups is None:
                    full = full.withColumn(f"group_{side}_{name}", F.lit(None).cast("int"))
                else:
                    g = groups.select(F.col("term").alias("_t"), F.col("group_id").alias(f"group_{side}_{name}"))
                    full = full.join(g, F.upper(F.trim(F.col(f"{side}_{name}"))) == F.col("_t"), "left").drop("_t")
    return scoring.scored(full, c.fields).select("b_id", "a_id", "score", "field_scores")


def best_scores(c: Config, a: DataFrame, b: DataFrame, exclusions: DataFrame | None = None, groups: DataFrame | None = None, earlier: bool = False) -> DataFrame | None:
    """The scores of what ranks to top_n need, where whole blocks are candidates and scores depend on values alone: found by
    classes of equal values, without the pairs of blocks. None for other jobs. Records with exclusions are compared pair by
    pair. With `earlier` (seq_a, seq_b) only pairs whose seq_a is smaller count."""
    if c.candidates != "blocked" or not c.top_n or not {f.method for f in c.fields} <= BY_VALUE:
        return None
    named = [(f"b_{y}", f"a_{x}") for x, y in c.blocking]
    find = lambda b: best_candidates(b, a, named, c.fields, max(2, c.top_n), earlier=earlier)  # noqa: E731  (the gap is to the second)
    if exclusions is None:
        return find(b)
    marked = exclusions.select(F.col("b_id")).union(exclusions.select(F.col("a_id"))).distinct()
    some = b.join(marked, "b_id", "left_semi")
    pairs = candidate_pairs(c, a, some, groups)[0]
    if earlier:
        pairs = pairs.join(a.select("a_id", "seq_a"), "a_id").join(b.select("b_id", "seq_b"), "b_id").where("seq_a < seq_b").select("b_id", "a_id")
    rest = score_pairs(c, gen.without_excluded(pairs, exclusions).select("b_id", "a_id"), a, b, None, groups)
    return find(b.join(marked, "b_id", "left_anti")).unionByName(rest)


def load_sides(spark: SparkSession, c: Config) -> tuple[DataFrame, DataFrame]:
    return tuple(readers.load(spark, d.path, d.id_field, s, c.required(s), d.kind, d.encoding) for s, d in (("a", c.a), ("b", c.b)))


def match(c: Config, a: DataFrame, b: DataFrame, crossmap: DataFrame, exclusions: DataFrame | None = None, groups: DataFrame | None = None, prematching: bool = True) -> Result:
    """The stages of a job over loaded sides. Analysis leaves out what is known (prematching=False): pairs that share an
    identifier then get real scores."""
    spark = a.sparkSession
    if c.limit:
        b = b.orderBy("b_id").limit(c.limit)
    empty = spark.createDataFrame([], "a_id string, b_id string, score double, reason string")
    mapped, known = crossmap.select("a_id", "b_id"), empty
    if prematching:
        known = mapped.join(b.select("b_id"), "b_id", "left_semi").select("a_id", "b_id", F.lit(1.0).alias("score"), F.lit("crossmap").alias("reason"))
        if c.a.common_id_field and c.b.common_id_field:
            common = prematch.common_id_match(a, b, f"a_{c.a.common_id_field}", f"b_{c.b.common_id_field}", mapped)
            known, mapped = known.unionByName(common), mapped.unionByName(common.select("a_id", "b_id"))
        if c.prefilter:
            same = prematch.exact_prefilter(a, b, [(f"a_{x}", f"b_{y}") for x, y in c.prefilter], mapped)
            known, mapped = known.unionByName(same), mapped.unionByName(same.select("a_id", "b_id"))
        known, mapped = settled(known), settled(mapped)
    work = b.join(mapped.select("b_id"), "b_id", "left_anti") if prematching else b
    # what several generators read is kept: vectors are encoded once, and each phase is a plan of its own
    va, vb = settled(with_vectors(c, a, "a")), settled(with_vectors(c, work, "b"))
    exclusions = exclusions if prematching else None
    scores = best_scores(c, va, vb, exclusions, groups)
    if scores is None:
        pairs, bm25 = candidate_pairs(c, va, vb, groups)
        pairs = settled(pairs)
        if exclusions is not None:
            pairs = gen.without_excluded(pairs, exclusions)
        scores = score_pairs(c, pairs, va, vb, bm25, groups)
    ranks = ranking.ranked(scores, c.auto, c.floor, c.min_gap, c.top_n)
    ranks = settled(ranks)
    claims = ranking.claim(ranks, c.auto, mapped if prematching else None)
    found = ranking.outcomes(ranks, claims, work, c.auto, c.floor)
    sure = known.select("b_id", F.lit("match").alias("relationship_type"), "a_id", "score", F.lit(None).cast("int").alias("rank"), "reason")
    relationships = settled(sure.unionByName(found))
    confirmed = relationships.where("relationship_type = 'match'").select("a_id", "b_id")
    return Result(relationships, ranks, tables.crossmap_add(mapped, confirmed), a, b)


def truth(c: Config, a: DataFrame, b: DataFrame) -> DataFrame:
    """The true A record (b_id, true_a_id) of each B record that shares its common identifier."""
    key = lambda s, d: F.trim(F.col(f"{s}_{d.common_id_field}"))
    left = a.select(key("a", c.a).alias("k"), "a_id").where("k <> ''").groupBy("k").agg(F.max("a_id").alias("true_a_id"))
    return b.select(key("b", c.b).alias("k"), "b_id").where("k <> ''").join(left, "k").select("b_id", "true_a_id")


def run(spark: SparkSession, c: Config) -> Result:
    """Load, match, write what the configuration asks for."""
    a, b = load_sides(spark, c)
    crossmap = readers.pairs(spark, c.crossmap_path, c.crossmap_a, c.crossmap_b)
    exclusions = readers.pairs(spark, c.exclusions_path, c.exclusions_a, c.exclusions_b) if c.exclusions_path else None
    result = match(c, a, b, crossmap, exclusions, readers.dictionary(spark, c.dictionary))
    write(spark, c, result)
    return result


def log_events(result: Result) -> DataFrame:
    """The events of a run, in order of b_id: ids made from partition and place rise along a sort by ranges."""
    r, null = result.relationships.orderBy("b_id"), lambda t: F.lit(None).cast(t)
    kind = F.when(F.col("relationship_type") == "match", "crossmap_confirm").when(F.col("relationship_type") == "review", "review_match").otherwise("no_match_below")
    return r.select(
        F.monotonically_increasing_id().alias("seq"), F.current_timestamp().alias("ts"), kind.alias("type"), F.lit("b").alias("side"), F.col("b_id").alias("id"), null("map<string,string>").alias("record"),
        "a_id", "b_id", F.col("a_id").alias("candidate_id"), "score", "rank", "reason",
    )


def write(spark: SparkSession, c: Config, result: Result) -> None:
    """The outputs: match log, scoring log, CSV and Parquet tables, a database, the cross-map."""
    out = c.output
    rows = sinks.relationship_rows(result.relationships, result.a, c.output_mapping)
    rest = sinks.unmatched_rows(result.b, result.relationships)
    others = result.ranks.where("rank > 1").select("b_id", "rank", "a_id", "score")
    near = result.relationships.where("relationship_type = 'no_match' and a_id is not null").withColumn("relationship_type", F.lit("candidate"))
    runners = others.withColumn("relationship_type", F.lit("candidate")).withColumn("reason", F.lit("top_scoring"))
    listed = result.relationships.where("relationship_type <> 'no_match'").unionByName(near).unionByName(runners.select(*result.relationships.columns))
    listed = listed.dropDuplicates(["a_id", "b_id", "relationship_type"])
    if out.get("path"):
        run_id = uuid.uuid4().hex
        sinks.append_match_log(log_events(result), f"{out['path']}/match_log", run_id)
        if c.scoring_log:
            sinks.append_scoring_log(result.ranks, f"{out['path']}/scoring_log", run_id)
        if c.cleanup_match_log:
            sinks.compact_match_log(spark, f"{out['path']}/match_log")
    if folder := out.get("csv_dir") or out.get("path"):
        sinks.write_csv(rows, f"{folder}/relationships.csv", ["b_id", "a_id"])
        sinks.write_csv(rest, f"{folder}/unmatched.csv", ["b_id"])
        sinks.write_csv(others, f"{folder}/candidates.csv", ["b_id", "rank"])
    if folder := out.get("parquet_dir"):
        for name, df in (("relationships", rows), ("unmatched", rest), ("candidates", others), ("field_scores", result.field_scores)):
            sinks.write_parquet(df, f"{folder}/{name}.parquet")
    if out.get("results_path"):
        sinks.write_csv(sinks.direct_rows(result.relationships, result.field_scores), out["results_path"], ["b_id", "a_id"])
    sinks.create_views(listed, result.a, result.b, result.field_scores)
    if out.get("database"):
        meta = spark.createDataFrame([("job", c.name), ("auto_match", str(c.auto)), ("review_floor", str(c.floor))], "key string, value string")
        named = {"relationships": listed, "a_records": result.a.withColumnRenamed("a_id", "id"), "b_records": result.b.withColumnRenamed("b_id", "id"), "field_scores": result.field_scores, "metadata": meta}
        sinks.write_tables(named, out["database"])
    if c.crossmap_path:
        sinks.write_pairs(result.crossmap, c.crossmap_path, c.crossmap_a, c.crossmap_b)
