"""Named queries of sources, sinks, state tables and reports, with the DuckDB SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.functions import acronyms as acr
from linkwright.functions import scalar
from linkwright.functions.encoder import encoded
from linkwright.operators import analysis, candidates, tables
from linkwright.operators.settle import scratch, settled
from linkwright.plans import build, datasets, job
from linkwright.plans import cache as vector_cache
from linkwright.plans import config as cfg
from linkwright.plans import fixtures as fx
from linkwright.plans.catalogue import CLAIMED, COMMON, JUDGED, PART_BLOCKS, SA, TRUTH, _common, _judged, _outcomes, _part_ranks, query, r4
from linkwright.plans.catalogue import CB as CUSTOMERS
from linkwright.plans.fixtures import AUTO, FLOOR, GAP, SCORED, SQL, TOP
from linkwright.sources import readers, sinks
from linkwright.streaming import events
from linkwright.streaming.hooks import hook_of

# --- sources: a table is written in a format and read back as a side of a job ---

SIDE = "trim(doc_id::VARCHAR) AS a_id, coalesce(md5(text), md5('')) AS a_text, coalesce(source, '') AS a_source, coalesce(n_chars::VARCHAR, '') AS a_n_chars"


def _read_back(spark: SparkSession, d: str, name: str) -> DataFrame:
    docs, path = fx.table(spark, d, "documents"), scratch(spark, name)
    if name.endswith(("csv", "tsv")):
        # headers and ids with spaces around, texts with quotes and line ends
        out = docs.select(F.concat(F.lit(" "), F.col("doc_id"), F.lit(" ")).alias("doc_id "), "text", "source", F.col("n_chars").alias(" n_chars"))
        out.write.csv(path, header=True, sep="\t" if name.endswith("tsv") else ",", quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif name.endswith("jsonl"):
        docs.write.json(path)
    else:
        docs.write.parquet(path)
    return readers.load(spark, path, "doc_id", "a", ["text", "source", "n_chars"]).withColumn("a_text", F.md5("a_text"))


@query(f"SELECT {SIDE} FROM documents")
def read_csv(spark, d):
    return _read_back(spark, d, "documents.csv")


@query(f"SELECT {SIDE} FROM documents")
def read_tsv(spark, d):
    return _read_back(spark, d, "documents.tsv")


@query(f"SELECT {SIDE} FROM documents")
def read_jsonl(spark, d):
    return _read_back(spark, d, "documents.jsonl")


@query(f"SELECT {SIDE} FROM documents")
def read_parquet(spark, d):
    return _read_back(spark, d, "documents.parquet")


@query("SELECT f AS format, (SELECT count(*) FROM part) AS rows FROM (SELECT unnest(['csv', 'jsonl', 'parquet']) AS f)")
def row_count(spark, d):
    part, counts = fx.table(spark, d, "part"), []
    for kind in ("csv", "jsonl", "parquet"):
        path = scratch(spark, f"part.{kind}")
        part.write.csv(path, header=True) if kind == "csv" else part.write.json(path) if kind == "jsonl" else part.write.parquet(path)
        counts.append((kind, readers.row_count(spark, path)))
    return spark.createDataFrame(counts, "format string, rows long")


@query(f"SELECT a_id, b_id FROM ({COMMON})")
def crossmap_csv(spark, d):
    path = scratch(spark, "crossmap.csv")
    sinks.write_pairs(_common(spark, d).limit(0), path, "supplier", "customer")
    sinks.write_pairs(_common(spark, d), path, "supplier", "customer")  # replaced as a whole
    return readers.pairs(spark, path, "supplier", "customer")


@query("SELECT 's' || s_suppkey AS a_id, 'c' || c_custkey AS b_id FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def exclusions_csv(spark, d):
    """Half of the rows are written the wrong way round."""
    s, c, path = fx.table(spark, d, "supplier"), fx.table(spark, d, "customer"), scratch(spark, "exclusions.csv")
    pairs = s.join(c, F.col("s_nationkey") == F.col("c_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("c"), "c_custkey").alias("b"))
    turned = F.crc32(F.concat("a", "b")) % 2 == 0
    sinks.write_pairs(pairs.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a_id"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b_id")), path, "left", "right")
    return tables.exclusion_pairs(readers.pairs(spark, path, "left", "right"), s.select(F.concat(F.lit("s"), "s_suppkey").alias("a_id")))


GROUPS = """g AS (SELECT r_name AS name, r_regionkey AS k FROM region UNION ALL SELECT n_name, n_regionkey FROM nation),
lows AS (SELECT upper(trim(name)) AS term, min(upper(trim(name))) OVER (PARTITION BY k) AS low, count(*) OVER (PARTITION BY k) AS n FROM g),
t AS (SELECT term, (dense_rank() OVER (ORDER BY low) - 1)::INT AS group_id FROM lows WHERE n > 1)"""


def _dictionary(spark, d):
    """A file with a row for each nation and its region: regions join the rows."""
    path = scratch(spark, "dictionary.csv")
    n, r = fx.table(spark, d, "nation"), fx.table(spark, d, "region")
    n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(",", F.lower("n_name"), "r_name")).write.text(path)
    return readers.dictionary(spark, path)


@query(f"WITH {GROUPS} SELECT term, group_id FROM t")
def dictionary_file(spark, d):
    return _dictionary(spark, d)


LOGGED = "SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'crossmap_break' WHEN 'purchase' THEN 'crossmap_confirm' WHEN 'view' THEN 'exclude' WHEN 'signup' THEN 'unexclude' ELSE 'review_match' END AS type, user_id::VARCHAR AS a_id, json_extract_string(props, '$.k') AS b_id, value AS score FROM events"


def _log(spark, d):
    """All events as pair events: confirms, breaks, exclusions and reviews of users and their k."""
    e = fx.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "crossmap_break").when(F.col("event_type") == "purchase", "crossmap_confirm").when(F.col("event_type") == "view", "exclude").when(F.col("event_type") == "signup", "unexclude").otherwise("review_match")
    a, b = F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts"), kind.alias("type"), F.lit("b").alias("side"), b.alias("id"), F.lit(None).cast("map<string,string>").alias("record"),
        a.alias("a_id"), b.alias("b_id"), a.alias("candidate_id"), F.col("value").alias("score"), F.lit(1).alias("rank"), F.col("event_type").alias("reason"),
    )


@query(f"WITH l AS ({LOGGED}) SELECT * FROM l")
def match_log_replay(spark, d):
    """Two runs are appended, with lines that are no events between; one run is read."""
    path = scratch(spark, "match_log")
    sinks.append_match_log(_log(spark, d), path, "r1")
    sinks.append_match_log(_log(spark, d).limit(5), path, "r2")
    spark.createDataFrame([("not json",), ("{}",)], "value string").write.mode("append").text(path)
    return readers.match_log(spark, path, "r1").select("seq", "type", "a_id", "b_id", "score")


@query(f"WITH {SCORED} SELECT b_id, a_id, rank, round(score, 4) AS score, classification, 3 AS fields FROM ranks")
def scoring_log_read(spark, d):
    path = scratch(spark, "scoring_log")
    sinks.append_scoring_log(_part_ranks(spark, d), path, "r1")
    each = readers.scoring_log(spark, path).where("run_id = 'r1'").select("b_id", F.explode("candidates").alias("c"))
    return each.select("b_id", "c.a_id", "c.rank", r4("score", F.col("c.score")), "c.classification", F.size("c.field_scores").alias("fields"))


@query("SELECT unnest(['balance', 'id', 'name', 'nation', 'tax']) AS field")
def required_fields(spark, d):
    c = cfg.from_dict(CONFIG | {"datasets": {s: {"path": f"{s}.csv", "id_field": "id", "common_id_field": "tax"} for s in "ab"}, "match_fields": [{"method": "fuzzy", "field_a": "name", "field_b": "name", "weight": 0.6}, {"method": "exact", "field_a": "balance", "field_b": "balance", "weight": 0.4}], "output_mapping": [{"from": "name", "to": "supplier"}]})
    return spark.createDataFrame([(f,) for f in c.required("a")], "field string")


# --- sinks: results are written and read back ---


def _written(spark, d, write, name: str) -> DataFrame:
    path = scratch(spark, name)
    write(path)
    return spark.read.csv(path, header=True) if name.endswith("csv") else spark.read.parquet(path)


@query(f"WITH {CLAIMED} SELECT b_id, rel.a_id, printf('%.4f', score) AS score, relationship_type, reason, rank::VARCHAR AS rank, a_name AS part FROM rel JOIN pa ON pa.a_id = rel.a_id WHERE relationship_type <> 'no_match'")
def relationships_csv(spark, d):
    rows = sinks.relationship_rows(_outcomes(spark, d), fx.parts(spark, d, "a").select("a_id", "a_name"), {"name": "part"})
    return _written(spark, d, lambda p: sinks.write_csv(rows, p, ["b_id", "a_id"]), "relationships.csv")


@query(f"WITH {CLAIMED} SELECT b_id, b_name, printf('%.4f', score) AS best_score, a_id AS best_a_id FROM rel JOIN pb USING (b_id) WHERE relationship_type = 'no_match'")
def unmatched_csv(spark, d):
    rows = sinks.unmatched_rows(fx.parts(spark, d, "b").select("b_id", "b_name"), _outcomes(spark, d))
    return _written(spark, d, lambda p: sinks.write_csv(rows, p, ["b_id"]), "unmatched.csv")


@query(f"WITH {SCORED} SELECT b_id, rank::VARCHAR AS rank, a_id, printf('%.4f', score) AS score FROM ranks WHERE rank > 1")
def candidates_csv(spark, d):
    rows = _part_ranks(spark, d).where("rank > 1").select("b_id", "rank", "a_id", "score")
    return _written(spark, d, lambda p: sinks.write_csv(rows, p, ["b_id", "rank"]), "candidates.csv")


@query(f"WITH {CLAIMED} SELECT b_id, rel.a_id, round(score, 4) AS score, relationship_type, reason, rank, a_name AS name FROM rel JOIN pa ON pa.a_id = rel.a_id WHERE relationship_type <> 'no_match'")
def relationships_parquet(spark, d):
    rows = sinks.relationship_rows(_outcomes(spark, d), fx.parts(spark, d, "a").select("a_id", "a_name"))
    return _written(spark, d, lambda p: sinks.write_parquet(rows, p), "relationships.parquet").withColumn("score", F.round("score", 4))


@query(f"WITH {CLAIMED} SELECT a_id, b_id, printf('%.4f', score) AS score, relationship_type AS classification, printf('%.4f', name_score) AS name_name_score, printf('%.4f', size_score) AS size_size_score FROM rel LEFT JOIN (SELECT a_id, b_id, name_score, size_score FROM ranks) USING (a_id, b_id)")
def direct_csv(spark, d):
    ranks = settled(_part_ranks(spark, d))
    fields = ranks.select("a_id", "b_id", F.explode("field_scores").alias("f")).select("a_id", "b_id", "f.*").where("method <> 'numeric'")
    rows = sinks.direct_rows(_outcomes(spark, d, ranks), fields)
    return _written(spark, d, lambda p: sinks.write_csv(rows, p, ["b_id", "a_id"]), "direct.csv")


VIEW_ROWS = "confirmed_matches: relationship_type = 'match'; scored_matches: relationship_type = 'match' AND reason = 'top_scoring'; asserted_matches: relationship_type = 'match' AND reason NOT IN ('top_scoring', 'downgraded'); review_queue: relationship_type = 'review'; near_misses: relationship_type = 'candidate' AND rank = 1; runner_ups: rank > 1; broken_matches: relationship_type = 'broken'"
LISTED = f"""{CLAIMED}, listed AS (
  SELECT b_id, a_id, score, rank, CASE WHEN relationship_type = 'match' AND right(b_id, 1) = '7' THEN 'broken' ELSE relationship_type END AS relationship_type, reason
  FROM rel WHERE relationship_type <> 'no_match'
  UNION ALL SELECT r.b_id, r.a_id, r.score, r.rank, 'candidate', NULL FROM ranks r WHERE NOT EXISTS (SELECT 1 FROM rel x WHERE x.a_id = r.a_id AND x.b_id = r.b_id AND x.relationship_type <> 'no_match'))"""


def _built(spark, d):
    """What a log and a scoring log of matched parts build, after the matches of some records have been broken."""
    ranks, path = settled(_part_ranks(spark, d)), scratch(spark, "match_log")
    found = _outcomes(spark, d, ranks)
    result = job.Result(found, ranks, None, None, None)
    log = job.log_events(result)
    sinks.append_match_log(log, path, "r")
    breaks = log.where("type = 'crossmap_confirm' and right(b_id, 1) = '7'").withColumn("type", F.lit("crossmap_break")).withColumn("seq", F.col("seq") + (1 << 50))
    sinks.append_match_log(breaks, path, "r")
    sinks.append_scoring_log(ranks, scoring := scratch(spark, "scoring_log"), "r")
    return build.build(readers.match_log(spark, path, "r"), fx.parts(spark, d, "b").select("b_id", "b_name"), readers.scoring_log(spark, scoring))


@query(f"WITH {LISTED} SELECT a_id, b_id, round(score, 4) AS score, rank, relationship_type, reason FROM listed")
def build_relationships(spark, d):
    return _built(spark, d).relationships.select("a_id", "b_id", r4("score"), "rank", "relationship_type", "reason")


@query(f"""WITH {LISTED} SELECT pb.b_id, b_name, round(CASE WHEN rel.relationship_type = 'no_match' THEN score END, 4) AS best_score, CASE WHEN rel.relationship_type = 'no_match' THEN rel.a_id END AS best_a_id
    FROM pb JOIN rel USING (b_id) WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.b_id = pb.b_id AND l.relationship_type IN ('match', 'review'))""")
def build_unmatched(spark, d):
    return _built(spark, d).unmatched.select("b_id", "b_name", r4("best_score"), "best_a_id")


@query(f"WITH {SCORED} SELECT b_id, rank, a_id, round(score, 4) AS score FROM ranks WHERE rank > 1")
def build_candidates(spark, d):
    return _built(spark, d).candidates.select("b_id", "rank", "a_id", r4("score"))


@query(f"WITH {SCORED} SELECT a_id, b_id, unnest(['name', 'size', 'size']) AS field_a, unnest(['fuzzy', 'exact', 'numeric']) AS method, round(unnest([name_score, size_score, size_score]), 4) AS score, unnest([0.5, 0.3, 0.2])::DOUBLE AS weight FROM ranks")
def build_field_scores(spark, d):
    return _built(spark, d).field_scores.select("a_id", "b_id", "field_a", "method", r4("score"), "weight")


@query(
    "WITH " + LISTED + " " + " UNION ALL ".join(f"SELECT '{v.split(': ')[0]}' AS view, count(*) AS rows, round(sum(score), 2) AS score FROM listed WHERE {v.split(': ')[1]}" for v in VIEW_ROWS.split("; "))
    + " UNION ALL SELECT 'unmatched_b', count(*), NULL FROM pb WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.b_id = pb.b_id AND l.relationship_type IN ('match', 'review'))"
    + " UNION ALL SELECT 'unmatched_a', count(*), NULL FROM pa WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.a_id = pa.a_id AND l.relationship_type IN ('match', 'review'))"
)
def result_views(spark, d):
    made = _built(spark, d)
    sinks.create_views(settled(made.relationships), fx.parts(spark, d, "a"), fx.parts(spark, d, "b"), made.field_scores)
    names = [v.split(": ")[0] for v in VIEW_ROWS.split("; ")]
    out = [spark.table(n).agg(F.lit(n).alias("view"), F.count(F.lit(1)).alias("rows"), F.round(F.sum("score"), 2).alias("score")) for n in names]
    out += [spark.table(n).agg(F.lit(n).alias("view"), F.count(F.lit(1)).alias("rows"), F.lit(None).cast("double").alias("score")) for n in ("unmatched_b", "unmatched_a")]
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows


@query("SELECT name, rows FROM (SELECT 'a_records' AS name, count(*) AS rows FROM supplier UNION ALL SELECT 'b_records', count(*) FROM customer UNION ALL SELECT 'metadata', 2)")
def output_database(spark, d):
    meta = spark.createDataFrame([("job", "t"), ("auto_match", "0.85")], "key string, value string")
    named = {"a_records": fx.suppliers(spark, d).withColumnRenamed("a_id", "id"), "b_records": fx.customers(spark, d).withColumnRenamed("b_id", "id"), "metadata": meta}
    sinks.write_tables(named, "linkwright_output")
    return tables.index({n: spark.table(f"linkwright_output.{n}") for n in named}).select("name", "rows")


# --- whole jobs: files in, files out, from a configuration ---

CONFIG = {
    "job": {"name": "parts"},
    "datasets": {"a": {"path": "a.parquet", "id_field": "id"}, "b": {"path": "b.parquet", "id_field": "id"}},
    "blocking": {"enabled": True, "fields": [{"field_a": "nation", "field_b": "nation"}]},
    "match_fields": [{"method": "exact", "field_a": "name", "field_b": "name", "weight": 1.0}],
    "thresholds": {"auto_match": AUTO, "review_floor": FLOOR, "min_score_gap": GAP},
    "top_n": TOP,
    "candidates": "blocked",
    "output": {"path": "out"},
}
#: Odd parts are matched with even ones.
ODD, EVEN = SQL["pa"] + " WHERE p_partkey % 2 = 1", SQL["pb"] + " WHERE p_partkey % 2 = 0"
JOB = CLAIMED.replace(f"pa AS ({SQL['pa']})", f"pa AS ({ODD})").replace(f"pb AS ({SQL['pb']})", f"pb AS ({EVEN})")


def _job(spark, d) -> tuple[cfg.Config, str]:
    """The parts as two Parquet datasets, and a job over them whose outputs and logs are files."""
    folder = scratch(spark, "job")
    for side, rest in (("a", 1), ("b", 0)):
        rows = fx.parts(spark, d, side).where(F.col(f"{side}_id").cast("long") % 2 == rest)
        rows.toDF(*[c[2:] for c in rows.columns]).write.parquet(f"{folder}/{side}.parquet")
    fields = [{"method": f.method, "field_a": f.field_a, "field_b": f.field_b, "scorer": f.scorer, "weight": f.weight} for f in fx.PART_FIELDS]
    raw = CONFIG | {
        "datasets": {s: {"path": f"{folder}/{s}.parquet", "id_field": "id"} for s in "ab"}, "match_fields": fields,
        "blocking": {"enabled": True, "fields": [{"field_a": f, "field_b": f} for f in ("brand", "type")]}, "output": {"path": f"{folder}/out"}, "scoring_log": {"enabled": True},
    }
    return cfg.from_dict(raw), folder


JOB_SQL = f"WITH {JOB} SELECT b_id, a_id, printf('%.4f', score) AS score, relationship_type, reason, rank::VARCHAR AS rank FROM rel WHERE relationship_type <> 'no_match'"


@query(JOB_SQL)
def job_run(spark, d):
    c, folder = _job(spark, d)
    job.run(spark, c)
    return spark.read.csv(f"{folder}/out/relationships.csv", header=True).select("b_id", "a_id", "score", "relationship_type", "reason", "rank")


@query(JOB_SQL)
def export_from_log(spark, d):
    """The job's files are overwritten, then made again from its logs alone."""
    c, folder = _job(spark, d)
    job.run(spark, c)
    for name in ("relationships", "unmatched", "candidates"):
        spark.range(1).write.mode("overwrite").csv(f"{folder}/out/{name}.csv", header=True)
    build.export(spark, c)
    return spark.read.csv(f"{folder}/out/relationships.csv", header=True).select("b_id", "a_id", "score", "relationship_type", "reason", "rank")


@query(f"""SELECT c.b_id, CASE WHEN m.a_id IS NULL THEN 'no_match' ELSE 'match' END AS relationship_type, m.a_id, CASE WHEN m.a_id IS NULL THEN 'below_floor' ELSE 'crossmap' END AS reason
    FROM ({CUSTOMERS}) c LEFT JOIN ({COMMON}) m USING (b_id)""")
def skip_mapped(spark, d):
    """What the cross-map has is reported again and not scored."""
    c = cfg.from_dict(CONFIG | {"candidates": "generators"})
    got = job.match(c, fx.suppliers(spark, d), fx.customers(spark, d), _common(spark, d).select("a_id", "b_id")).relationships
    return got.select("b_id", "relationship_type", "a_id", "reason")


@query(f"SELECT b_id FROM ({CUSTOMERS}) ORDER BY b_id LIMIT 100")
def record_limit(spark, d):
    """The first hundred records by id, as a job's limit asks."""
    c = cfg.from_dict(CONFIG | {"candidates": "generators", "batch": {"limit": 100}})
    return job.match(c, fx.suppliers(spark, d), fx.customers(spark, d), _common(spark, d).select("a_id", "b_id").limit(0)).relationships.select("b_id")


@query(f"SELECT b_id, a_id AS true_a_id FROM (SELECT trim(a_tax) AS k, max(a_id) AS a_id FROM ({SA}) WHERE trim(a_tax) <> '' GROUP BY 1) JOIN ({CUSTOMERS}) c ON trim(c.b_tax) = k")
def ground_truth(spark, d):
    c = cfg.from_dict(CONFIG | {"datasets": {s: {"path": f"{s}.csv", "id_field": "id", "common_id_field": "tax"} for s in "ab"}})
    return job.truth(c, fx.suppliers(spark, d), fx.customers(spark, d))


@query(f"WITH m AS ({COMMON}) SELECT s.* FROM ({SA}) s WHERE a_id NOT IN (SELECT a_id FROM m) ORDER BY a_id LIMIT 25")
def page_unmatched(spark, d):
    return tables.page_unmatched(fx.suppliers(spark, d).join(_common(spark, d).select("a_id"), "a_id", "left_anti"), "a_id", limit=25)


@query(f"WITH m AS ({COMMON}) SELECT a_id FROM ({SA}) s WHERE a_id NOT IN (SELECT a_id FROM m) AND a_id > '5' ORDER BY a_id LIMIT 10")
def page_unmatched_ids(spark, d):
    return tables.page_unmatched(fx.suppliers(spark, d).join(_common(spark, d).select("a_id"), "a_id", "left_anti"), "a_id", "5", 10, with_record=False)


OPEN = "SELECT 'b' AS side, json_extract_string(props, '$.k') AS id, user_id::VARCHAR AS candidate_id, max(value) AS score FROM events WHERE event_type = 'click' GROUP BY 2, 3"


def _open(spark, d):
    e = fx.table(spark, d, "events").where("event_type = 'click'")
    return e.groupBy(F.get_json_object("props", "$.k").alias("id"), F.col("user_id").cast("string").alias("candidate_id")).agg(F.max("value").alias("score")).withColumn("side", F.lit("b"))


@query(f"WITH o AS ({OPEN}), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, id, candidate_id) AS n FROM o) SELECT side, id, candidate_id, score FROM n WHERE n BETWEEN 31 AND 60")
def page_reviews(spark, d):
    """The second page: its cursor is the last row of the first."""
    reviews = settled(_open(spark, d))
    last = tables.page_reviews(reviews, None, 30).tail(1)[0]
    return tables.page_reviews(reviews, tables.review_cursor(last), 30).select("side", "id", "candidate_id", "score")


# --- state tables ---

OLD = "old AS (SELECT user_id::VARCHAR AS a_id, 'k' || user_id AS b_id FROM events GROUP BY user_id)"
NEW = "new AS (SELECT user_id::VARCHAR AS a_id, 'k' || CASE WHEN user_id % 2 = 0 THEN user_id ELSE (user_id * 7 + 3) % 200 END AS b_id FROM events WHERE user_id % 3 = 0 GROUP BY user_id)"


def _old(spark, d):
    u = fx.table(spark, d, "events").select("user_id").distinct()
    return u.select(F.col("user_id").cast("string").alias("a_id"), F.concat(F.lit("k"), "user_id").alias("b_id"))


def _new(spark, d):
    u = fx.table(spark, d, "events").select("user_id").distinct().where("user_id % 3 = 0")
    return u.select(F.col("user_id").cast("string").alias("a_id"), F.concat(F.lit("k"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).otherwise((F.col("user_id") * 7 + 3) % 200)).alias("b_id"))


ONCE = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY b_id DESC) AS n FROM new) WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY a_id DESC) = 1)"


@query(f"WITH {OLD}, {NEW}, {ONCE} SELECT a_id, b_id FROM one UNION ALL SELECT a_id, b_id FROM old WHERE a_id NOT IN (SELECT a_id FROM one) AND b_id NOT IN (SELECT b_id FROM one)")
def crossmap_add(spark, d):
    """Also what an import does: new pairs displace old ones."""
    return tables.crossmap_add(_old(spark, d), _new(spark, d))


@query(f"WITH {OLD}, {NEW} SELECT DISTINCT o.a_id, o.b_id FROM old o WHERE (o.a_id IN (SELECT a_id FROM new) OR o.b_id IN (SELECT b_id FROM new)) AND NOT EXISTS (SELECT 1 FROM new n WHERE n.a_id = o.a_id AND n.b_id = o.b_id)")
def crossmap_confirm_displaced(spark, d):
    return tables.crossmap_displaced(_old(spark, d), _new(spark, d))


@query(f"WITH {OLD}, {NEW} SELECT a_id, b_id FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.a_id = o.a_id AND n.b_id = o.b_id)")
def crossmap_remove(spark, d):
    return tables.crossmap_remove(_old(spark, d), _new(spark, d))


@query(f"WITH {OLD}, {NEW} SELECT a_id, b_id, b_id IN (SELECT b_id FROM new) AS taken FROM old")
def crossmap_take(spark, d):
    left, taken = tables.crossmap_take(_old(spark, d), _new(spark, d).select("b_id"), "b")
    return left.withColumn("taken", F.lit(False)).unionByName(taken.withColumn("taken", F.lit(True)))


FREE = "few AS (SELECT * FROM old WHERE a_id::INT % 2 = 0), free AS (SELECT * FROM new WHERE a_id NOT IN (SELECT a_id FROM few) AND b_id NOT IN (SELECT b_id FROM few)), won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY a_id) AS n FROM free) WHERE n = 1)"


@query(f"WITH {OLD}, {NEW}, {FREE} SELECT a_id, b_id FROM few UNION ALL SELECT a_id, b_id FROM won")
def crossmap_claim(spark, d):
    return tables.crossmap_claim(_old(spark, d).where("cast(a_id as int) % 2 = 0"), _new(spark, d))


@query(f"WITH m AS ({COMMON}) SELECT (SELECT count(*) FROM m) AS pairs, (SELECT count(*) FROM supplier) AS a_total, (SELECT count(*) FROM customer) AS b_total, round(100.0 * (SELECT count(*) FROM m) / (SELECT count(*) FROM supplier), 4)::DOUBLE AS a_share, round(100.0 * (SELECT count(*) FROM m) / (SELECT count(*) FROM customer), 4)::DOUBLE AS b_share")
def crossmap_stats(spark, d):
    out = tables.crossmap_stats(_common(spark, d), fx.suppliers(spark, d), fx.customers(spark, d))
    return out.select("pairs", "a_total", "b_total", r4("a_share"), r4("b_share"))


@query(f"WITH m AS ({COMMON}) SELECT a_id, b_id, score, s.a_name, c.b_name FROM m JOIN ({SA}) s USING (a_id) JOIN ({CUSTOMERS}) c USING (b_id) WHERE a_id IN (SELECT s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 2 = 0)")
def crossmap_lookup(spark, d):
    """The partners of some records, with the fields of both."""
    ids = fx.table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("a_id"))
    return tables.partners(_common(spark, d).drop("reason"), ids, "a").join(fx.suppliers(spark, d).select("a_id", "a_name"), "a_id").join(fx.customers(spark, d).select("b_id", "b_name"), "b_id")


@query(f"WITH l AS ({LOGGED}) SELECT a_id, b_id FROM l WHERE type IN ('exclude', 'unexclude') QUALIFY row_number() OVER (PARTITION BY a_id, b_id ORDER BY seq DESC) = 1 AND type = 'exclude'")
def exclusion_fold(spark, d):
    return events.exclusions_of(_log(spark, d))


@query(f"""WITH l AS ({LOGGED}), r AS (SELECT *, max(seq) OVER (PARTITION BY a_id, b_id) AS latest FROM l WHERE type = 'review_match')
    SELECT b_id AS id, a_id AS candidate_id, score FROM r WHERE seq = latest
    AND NOT EXISTS (SELECT 1 FROM l c WHERE c.type = 'crossmap_confirm' AND c.a_id = r.a_id AND c.seq > r.seq) AND NOT EXISTS (SELECT 1 FROM l c WHERE c.type = 'crossmap_confirm' AND c.b_id = r.b_id AND c.seq > r.seq)
    AND NOT EXISTS (SELECT 1 FROM l x WHERE x.type = 'exclude' AND x.a_id = r.a_id AND x.b_id = r.b_id AND x.seq > r.seq)""")
def review_fold(spark, d):
    return events.reviews_of(_log(spark, d)).select("id", "candidate_id", "score")


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def record_latest(spark, d):
    return tables.latest(fx.table(spark, d, "events"), ["user_id"], "event_id").select("user_id", "event_type", "value")


@query("SELECT CASE event_type WHEN 'error' THEN 'on_break' WHEN 'purchase' THEN 'on_confirm' WHEN 'view' THEN 'on_exclude' ELSE 'on_review' END AS hook, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1")
def hook_events(spark, d):
    """How many events each hook is sent."""
    return _log(spark, d).select(hook_of(F.col("type")).alias("hook")).where("hook is not null").groupBy("hook").agg(F.count(F.lit(1)).alias("n"))


# --- functions ---


@query(r"SELECT doc_id, array_to_string(list_filter([trim(coalesce(source, '')), trim(coalesce(lang, '')), CASE WHEN doc_id % 3 = 0 THEN '' ELSE doc_id::VARCHAR END], lambda t: t <> ''), ' ') AS joined FROM documents")
def concat_fields(spark, d):
    third = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.col("doc_id").cast("string"))
    return fx.table(spark, d, "documents").select("doc_id", scalar.joined(F.concat(F.lit(" "), "source"), F.col("lang"), third).alias("joined"))


@query(f"WITH {GROUPS} SELECT n_name AS x, r_name AS y, (a.group_id = b.group_id AND a.term <> b.term)::INT::DOUBLE AS score FROM nation, region JOIN t b ON b.term = r_name JOIN t a ON a.term = n_name")
def synonym_dictionary_score(spark, d):
    g = _dictionary(spark, d)
    n, r = fx.table(spark, d, "nation").select(F.col("n_name").alias("x")), fx.table(spark, d, "region").select(F.col("r_name").alias("y"))
    both = n.join(g.select(F.col("term").alias("x"), F.col("group_id").alias("gx")), "x").crossJoin(F.broadcast(r.join(g.select(F.col("term").alias("y"), F.col("group_id").alias("gy")), "y")))
    return both.select("x", "y", acr.synonym_score(F.lower("x"), F.col("y"), F.col("gx"), F.col("gy")).alias("score"))


@query(f"WITH {GROUPS} SELECT DISTINCT n_name AS b_id, t.term AS key FROM nation JOIN t a ON a.term = n_name JOIN t USING (group_id)")
def dictionary_expand(spark, d):
    n = fx.table(spark, d, "nation").select(F.col("n_name").alias("b_id"), F.col("n_name").alias("name"))
    return candidates.synonym_keys(n, "b_id", F.lower("name"), 3, _dictionary(spark, d), query=True)


FNV = """list_reduce(list_transform(regexp_extract_all({0}, '..'), lambda x: ('0x' || x)::UHUGEINT),
    lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"""


@query(f"SELECT p_partkey, lower(to_base(({FNV.format('hex(encode(p_name))')} % 4294967296)::BIGINT, 16, 8)) AS hash FROM part")
def fnv_hash(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", scalar.fnv1a_8(F.col("p_name")).alias("hash"))


HASHED = "hex(encode(trim(c_name))) || 'FF' || hex(encode(trim(c_mktsegment))) || 'FF'"


@query(f"SELECT c_custkey, lower(to_base(({FNV.format(HASHED)} // 4294967296)::BIGINT, 16, 8)) AS high FROM customer")
def text_hash(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", F.substring(scalar.text_hash(F.concat(F.lit(" "), "c_name"), F.col("c_mktsegment")), 1, 8).alias("high"))


@query("SELECT count(DISTINCT p_name) AS encoded, (SELECT count(DISTINCT trim(c_mktsegment)) FROM customer) AS more, count(*) AS rows, 0::BIGINT AS without FROM part")
def vector_cache_hits(spark, d):
    """How many texts two jobs encode: the second only those that the first did not have."""
    path, part = scratch(spark, "vectors"), fx.table(spark, d, "part").select(F.col("p_name").alias("text"))
    first = vector_cache.missing(part, F.col("text"), path, "hashed").count()
    with_ = vector_cache.with_cached(part, F.col("text"), "v", encoded, path, "hashed")
    done = with_.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("without")).first()
    both = part.union(fx.table(spark, d, "customer").select(F.trim("c_mktsegment")))
    more = vector_cache.missing(both, F.col("text"), path, "hashed").count()
    return spark.createDataFrame([(first, more, done["rows"], done["without"])], "encoded long, more long, rows long, without long")


# --- reports ---


@query(f"WITH {CLAIMED} SELECT count(*) AS total, count(*) FILTER (relationship_type = 'match') AS auto, count(*) FILTER (relationship_type = 'review') AS review, count(*) FILTER (relationship_type = 'no_match') AS no_match, 0::BIGINT AS skipped FROM rel")
def batch_stats(spark, d):
    return analysis.outcome_counts(_outcomes(spark, d))


@query(f"""WITH {JUDGED}, s AS (SELECT f AS field_a, m AS method, v, population FROM (SELECT b_id, a_id, unnest(['name', 'size']) AS f, unnest(['fuzzy', 'exact']) AS m, unnest([name_score, size_score]) AS v FROM ranks) JOIN popd USING (b_id, a_id)),
    g AS (SELECT field_a, method, count(*) AS n, avg(v) FILTER (population = 'match') AS m, avg(v) FILTER (population = 'nonmatch') AS u FROM s GROUP BY 1, 2)
    SELECT field_a, method, n, round(m, 4) AS match_mean, round(u, 4) AS nonmatch_mean, round(m - u, 4) AS gap, CASE WHEN m - u < 0.05 THEN 'weak' WHEN m - u < 0.15 THEN 'moderate' WHEN m - u IS NOT NULL THEN 'strong' END AS label FROM g""")
def field_gap(spark, d):
    ranks = settled(_part_ranks(spark, d))
    each = ranks.select("b_id", "a_id", F.explode("field_scores").alias("f")).select("b_id", "a_id", "f.*").where("method <> 'numeric'")
    out = analysis.field_stats(each.join(_judged(spark, d, ranks).select("b_id", "a_id", "population"), ["b_id", "a_id"]))
    return out.select("field_a", "method", "n", r4("match_mean"), r4("nonmatch_mean"), r4("gap"), "label")


@query(f"""WITH {JUDGED} SELECT b_id, verdict, round(s, 4) AS score, CASE WHEN verdict = 'review_tp' THEN 'review_match' WHEN verdict = 'review_fp' THEN 'review_nonmatch' ELSE 'missed_near_floor' END AS zone
    FROM popd WHERE verdict IN ('review_tp', 'review_fp') OR (verdict = 'fn' AND s >= 0.8::DOUBLE * {FLOOR}::DOUBLE)""")
def overlap_zone(spark, d):
    return analysis.overlap_zone(_judged(spark, d), FLOOR).select("b_id", "verdict", r4("score"), "zone")


REACH = "reach AS (SELECT DISTINCT b_id FROM scored)"


def _reach(spark, d):
    """Of each part's block the first parts: those that reach any other, and a candidate besides itself and its truth."""
    a, b = fx.parts(spark, d, "a"), fx.parts(spark, d, "b")
    return candidates.without_self(candidates.first_of_block(b, a, PART_BLOCKS, 3, all_if_keyless=False))


@query(f"""WITH {JUDGED}, {REACH}, c AS (SELECT count(*) FILTER (true_a_id IS NOT NULL) AS true_pairs, count(*) FILTER (true_a_id IS NOT NULL AND b_id IN (SELECT b_id FROM reach)) AS ceiling,
      count(*) FILTER (verdict = 'auto_tp') AS tp, count(*) FILTER (verdict = 'auto_fp') AS fp, count(*) FILTER (verdict = 'fn') AS missed FROM popd)
    SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(ceiling, 0), 4) AS ceiling_recall FROM c""")
def accuracy_evaluation(spark, d):
    out = analysis.evaluation(_judged(spark, d), _reach(spark, d))
    return out.select("true_pairs", "ceiling", "tp", "fp", "missed", r4("precision"), r4("ceiling_recall"))


#: Of a part's truth: one in five is told to be ambiguous; parts without a twin are unmatched.
KINDS = "kinds AS (SELECT b.b_id, CASE WHEN right(b.b_id, 1) IN ('0', '5') THEN 'ambiguous' WHEN true_a_id IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS match_type, true_a_id FROM pb b LEFT JOIN truth USING (b_id))"


def _kinds(spark, d, judged):
    kind = F.when(F.right("b_id", F.lit(1)).isin("0", "5"), "ambiguous").when(F.col("true_a_id").isNotNull(), "matched").otherwise("unmatched")
    return judged.select("b_id", kind.alias("match_type"), "true_a_id")


@query(f"""WITH {CLAIMED}, {TRUTH}, {KINDS}, {REACH},
    e AS (SELECT *, relationship_type = 'match' AS au, relationship_type = 'review' AS re, coalesce(match_type = 'matched' AND a_id = true_a_id, false) AS ok FROM kinds LEFT JOIN rel USING (b_id)),
    c AS (SELECT count(*) FILTER (au) AS auto, count(*) FILTER (re) AS review, count(*) FILTER (match_type = 'matched') AS total, count(*) FILTER (match_type = 'matched' AND b_id IN (SELECT b_id FROM reach)) AS ceiling,
      count(*) FILTER (match_type = 'matched' AND NOT au AND NOT re) AS fn, count(*) FILTER (match_type = 'ambiguous' AND NOT au AND NOT re) AS fn_ambiguous, count(*) FILTER (match_type = 'unmatched' AND NOT au AND NOT re) AS tn,
      count(*) FILTER (au AND ok) AS auto_tp, count(*) FILTER (au AND match_type = 'matched' AND NOT ok) AS auto_fp_wrong, count(*) FILTER (au AND match_type = 'ambiguous') AS auto_fp_ambiguous, count(*) FILTER (au AND match_type = 'unmatched') AS auto_fp_unmatched,
      count(*) FILTER (re AND ok) AS review_tp, count(*) FILTER (re AND match_type = 'matched' AND NOT ok) AS review_fp_wrong, count(*) FILTER (re AND match_type = 'ambiguous') AS review_fp_ambiguous, count(*) FILTER (re AND match_type = 'unmatched') AS review_fp_unmatched FROM e)
    SELECT *, round(CASE WHEN auto > 0 THEN auto_tp / auto ELSE 0 END, 4) AS precision, round(CASE WHEN ceiling > 0 THEN auto_tp / ceiling ELSE 0 END, 4) AS recall_ceiling,
      round(CASE WHEN total > 0 THEN auto_tp / total ELSE 0 END, 4) AS recall_total, round(CASE WHEN total > 0 THEN (auto_tp + review_tp) / total ELSE 0 END, 4) AS combined_recall FROM c""")
def round_evaluation(spark, d):
    judged = settled(_judged(spark, d))
    out = analysis.round_evaluation(judged, _kinds(spark, d, judged), _reach(spark, d))
    return out.select(*[r4(c) if t == "double" else c for c, t in out.dtypes])


@query(f"""WITH {CLAIMED}, {TRUTH}, {KINDS},
    j AS (SELECT least(floor(round(coalesce(score, 0), 6) / 0.02::DOUBLE), 50) AS bucket, coalesce((match_type = 'matched' AND (relationship_type NOT IN ('match', 'review') OR a_id = true_a_id)) OR match_type = 'ambiguous', false) AS same FROM rel JOIN kinds USING (b_id)),
    h AS (SELECT bucket, count(*) FILTER (same) AS m, count(*) FILTER (NOT same) AS u FROM j GROUP BY 1)
    SELECT round(sum(least(m / (SELECT greatest(sum(m), 1) FROM h), u / (SELECT greatest(sum(u), 1) FROM h))), 4) AS overlap FROM h""")
def overlap_by_type(spark, d):
    judged = settled(_judged(spark, d))
    rounded = judged.select("b_id", "a_id", "relationship_type", F.round("score", 6).alias("score"))
    return analysis.typed_overlap(rounded, _kinds(spark, d, judged)).select(r4("overlap"))


@query(f"""WITH {JUDGED}, amb AS (SELECT b_id, a_id FROM rel WHERE relationship_type = 'review' AND right(b_id, 1) = '5'),
    smp AS (SELECT p.b_id, min(s.a_id) AS a_id FROM popd p JOIN scored s ON s.b_id = p.b_id WHERE p.verdict NOT IN ('auto_fp', 'review_fp') AND p.true_a_id IS NOT NULL AND s.a_id <> p.true_a_id GROUP BY p.b_id),
    x AS (SELECT b_id, true_a_id AS a_id, 1.0::DOUBLE AS label FROM popd WHERE true_a_id IS NOT NULL UNION ALL SELECT b_id, a_id, 0.87 FROM amb
          UNION ALL SELECT b_id, a_id, 0.0 FROM popd WHERE verdict IN ('auto_fp', 'review_fp') UNION ALL SELECT b_id, a_id, 0.0 FROM smp)
    SELECT b_id, a_id, max(label) AS label FROM x GROUP BY 1, 2""")
def training_pairs(spark, d):
    judged = settled(_judged(spark, d))
    unsure = judged.where("relationship_type = 'review' and right(b_id, 1) = '5'").select("b_id", "a_id")
    return analysis.training_pairs(judged, unsure, _reach(spark, d))


@query("SELECT 'customer' AS name, (SELECT count(*) FROM customer) AS rows, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns UNION ALL SELECT 'region', (SELECT count(*) FROM region), 'r_regionkey,r_name'")
def view_index(spark, d):
    return tables.index({n: fx.table(spark, d, n) for n in ("customer", "region")})


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '1') ORDER BY c_name DESC, c_custkey LIMIT 20 OFFSET 20")
def view_page(spark, d):
    c = fx.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return tables.browse(c, {"c_mktsegment": "BUILDING", "c_name": "1", "unknown": "x"}, ["c_mktsegment"], "c_name", True, 1, 20)[0]


@query("SELECT 'c_mktsegment' AS column, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*) FROM customer GROUP BY 2")
def view_choices(spark, d):
    return tables.choices(fx.table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])


@query("SELECT kind, n, CASE WHEN kind = 'unmatched' THEN 0 ELSE n END AS with_truth FROM (SELECT unnest(['ambiguous', 'matched', 'unmatched']) AS kind, unnest([100, 700, 200]::BIGINT[]) AS n)")
def generated_dataset(spark, d):
    """Counts of a generated test dataset: the kinds of its incoming records, and how many have a true partner."""
    a, b = datasets.generate(spark, 1000)
    true = b.join(a.select(F.col("entity_id").alias("_true_a_id"), F.lit(1).alias("is")), "_true_a_id", "left")
    return true.groupBy(F.col("_match_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count("is").alias("with_truth"))
