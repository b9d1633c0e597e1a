"""Named queries of live sessions, with the DuckDB SQL that each must equal."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.functions.encoder import encoded
from linkwright.operators.settle import scratch
from linkwright.plans import config as cfg
from linkwright.plans import fixtures as fx
from linkwright.plans.catalogue import CB, COMMON, ORACLES, SA, query, r4
from linkwright.sources.sinks import append_match_log
from linkwright.streaming import enroll
from linkwright.streaming import events as ev
from linkwright.streaming.live import LiveSession

CONFIG = {
    "job": {"name": "live"},
    "datasets": {s: {"path": f"{s}.csv", "id_field": "id", "common_id_field": "tax"} for s in "ab"},
    "candidates": "blocked",
    "blocking": {"enabled": True, "fields": [{"field_a": "nation", "field_b": "nation"}]},
    "match_fields": [{"method": "exact", "field_a": "nation", "field_b": "nation", "weight": 0.7}, {"method": "exact", "field_a": "name", "field_b": "name", "weight": 0.3}],
    "thresholds": {"auto_match": 0.85, "review_floor": 0.6},
}
FIELDS = ("id", "name", "nation", "tax")
_MADE: dict[tuple[str, str, str], str] = {}


def _events(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers, then all customers, as upserts in order of their numbers."""
    parts = []
    for side, df, rank in (("a", fx.suppliers(spark, d), 0), ("b", fx.customers(spark, d), 1)):
        record = F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*[F.col(f"{side}_{f}") for f in FIELDS]))
        parts.append(df.select((F.col(f"{side}_id").cast("long") + rank * 10**12).alias("seq"), F.lit("upsert_record").alias("type"), F.lit(side).alias("side"), F.col(f"{side}_id").alias("id"), record.alias("record")))
    return parts[0].unionByName(parts[1])


def _new(spark: SparkSession, path: str | None = None) -> LiveSession:
    path = path or scratch(spark, "live")
    return LiveSession(spark, cfg.from_dict(CONFIG | {"output": {"path": path}}), path)


def _session(spark: SparkSession, d: str) -> LiveSession:
    """A session that has taken all suppliers and customers in one micro-batch; made once for an application and folder."""
    key = (spark.sparkContext.applicationId, d, "upserts")
    s = _new(spark, _MADE.get(key))
    if key not in _MADE:
        s.process(_events(spark, d).withColumns({"a_id": F.lit(None).cast("string"), "b_id": F.lit(None).cast("string")}), 0)
        _MADE[key] = s.path
    return s


PAIRS = f"SELECT a_id, b_id FROM ({COMMON})"


@query(PAIRS)
def live_crossmap(spark, d):
    """Records that share an identifier are pairs at once."""
    return _session(spark, d).crossmap()


@query(f"SELECT c.b_id, b_name FROM ({CB}) c WHERE c.b_id NOT IN (SELECT b_id FROM ({COMMON}))")
def live_unmatched(spark, d):
    return _session(spark, d).unmatched("b").select("b_id", "b_name")


REVIEWS = f"""m AS ({COMMON}), best AS (SELECT b_id, min(a_id) AS candidate_id FROM ({CB}) c JOIN ({SA}) s ON b_nation = a_nation WHERE b_nation <> '' AND b_id NOT IN (SELECT b_id FROM m) GROUP BY b_id),
open AS (SELECT b_id AS id, candidate_id, 0.7::DOUBLE AS score FROM best r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.a_id = r.candidate_id AND m.b_id::BIGINT > r.b_id::BIGINT))"""


@query(f"WITH {REVIEWS} SELECT id, candidate_id, score FROM open")
def live_reviews(spark, d):
    """Reviews with the best candidate of the nation, but for those whose candidate was confirmed with another later."""
    return _session(spark, d).reviews().select("id", "candidate_id", r4("score"))


@query(f"WITH {REVIEWS} SELECT (SELECT count(*) FROM supplier) AS a, (SELECT count(*) FROM customer) AS b, (SELECT count(*) FROM m) AS pairs, (SELECT count(*) FROM open) AS reviews, 0::BIGINT AS exclusions")
def live_status(spark, d):
    return spark.createDataFrame([_session(spark, d).status()], "a long, b long, pairs long, reviews long, exclusions long")


@query(f"""WITH m AS ({COMMON}), q AS (SELECT * FROM ({CB}) c WHERE b_id::BIGINT % 15 = 1),
    s AS (SELECT b_id, s.a_id, (b_nation <> '')::INT * 0.7::DOUBLE AS score, row_number() OVER (PARTITION BY b_id ORDER BY s.a_id) AS n FROM q JOIN ({SA}) s ON b_nation = '' OR b_nation = a_nation WHERE b_id NOT IN (SELECT b_id FROM m))
    SELECT b_id, a_id, score FROM s WHERE n <= 5 UNION ALL SELECT b_id, a_id, 1.0 FROM q JOIN m USING (b_id)""")
def live_match_batch(spark, d):
    """What an upsert of some customers would find; nothing is stored."""
    rows = fx.customers(spark, d).where("cast(b_id as long) % 15 = 1").collect()
    found = _session(spark, d).match_all("b", [{f: r[f"b_{f}"] for f in FIELDS} for r in rows])
    out = [(x["id"], m["candidate_id"], float(m["score"])) for x in found for m in x["matches"]]
    return spark.createDataFrame(out, "b_id string, a_id string, score double")


def _manual(spark: SparkSession, d: str) -> LiveSession:
    """The session after confirms, breaks, exclusions and removals of suppliers by the last digit of their number."""
    key = (spark.sparkContext.applicationId, d, "manual")
    base = _session(spark, d)
    s = _new(spark, _MADE.get(key))
    if key not in _MADE:
        append_match_log(base.log(), f"{s.path}/log")
        pairs = sorted((r["a_id"], r["b_id"]) for r in base.crossmap().collect())
        steps = [{"type": {"1": "crossmap_break", "2": "exclude", "4": "exclude"}[a[-1]], "a_id": a, "b_id": b} for a, b in pairs if a[-1] in "124"]
        steps += [{"type": "unexclude", "a_id": a, "b_id": b} for a, b in pairs if a[-1] == "4"]
        steps += [{"type": "crossmap_confirm", "a_id": a, "b_id": str(int(a) + 1)} for a in sorted(r["a_id"] for r in fx.suppliers(spark, d).collect()) if a[-1] == "3"]
        steps += [{"type": "remove_record", "side": "a", "id": a} for a, _ in pairs if a[-1] == "6"]
        s.process(spark.createDataFrame([(10**14 + k, *(x.get(c) for c in ("type", "side", "id", "a_id", "b_id"))) for k, x in enumerate(steps)], "seq long, type string, side string, id string, a_id string, b_id string").withColumn("record", F.lit(None).cast("map<string,string>")), 1)
        _MADE[key] = s.path
    return s


@query(f"""WITH m AS ({COMMON}), n AS (SELECT s_suppkey::VARCHAR AS a_id, (s_suppkey + 1)::VARCHAR AS b_id FROM supplier WHERE s_suppkey % 10 = 3 AND s_suppkey + 1 IN (SELECT c_custkey FROM customer))
    SELECT a_id, b_id FROM n UNION ALL SELECT a_id, b_id FROM m WHERE right(a_id, 1) NOT IN ('1', '2', '4', '6') AND a_id NOT IN (SELECT a_id FROM n) AND b_id NOT IN (SELECT b_id FROM n)""")
def live_manual_pairs(spark, d):
    """Confirms displace partners, breaks, exclusions and removals end pairs."""
    return _manual(spark, d).crossmap()


@query(f"SELECT a_id, b_id FROM ({COMMON}) WHERE right(a_id, 1) = '2'")
def live_exclusions(spark, d):
    return _manual(spark, d).exclusions()


@query(f"SELECT a_id FROM ({SA}) WHERE NOT (right(a_id, 1) = '6' AND a_id IN (SELECT a_id FROM ({COMMON})))")
def live_records(spark, d):
    """The records that removals have left."""
    return _manual(spark, d).records("a").select("a_id")


@query(f"""WITH m AS ({COMMON}) SELECT a_id, b_id, CASE WHEN right(a_id, 1) IN ('1', '2', '4', '6') THEN 'broken' ELSE 'match' END AS relationship_type FROM m WHERE right(a_id, 1) <> '3' AND b_id NOT IN (SELECT (s_suppkey + 1)::VARCHAR FROM supplier WHERE s_suppkey % 10 = 3)""")
def live_flush(spark, d):
    """The result tables as a shutdown writes them: pairs that share an identifier, and which of them were broken."""
    made = _manual(spark, d).flush()
    mine = fx.table(spark, d, "supplier").where("s_suppkey % 10 = 3").select((F.col("s_suppkey") + 1).cast("string").alias("b_id"))
    out = made.relationships.where("reason = 'canonical' and right(a_id, 1) <> '3'").join(mine, "b_id", "left_anti")
    return out.select("a_id", "b_id", "relationship_type")


@query(PAIRS)
def live_stream(spark, d):
    """The upserts as a stream of files, with a restart that finds nothing new."""
    folder = scratch(spark, "stream")
    _events(spark, d).repartition(1).write.json(f"{folder}/in")
    s = _new(spark, f"{folder}/state")
    for _ in range(2):
        s.start(spark.readStream.schema(ev.SCHEMA).json(f"{folder}/in"), f"{folder}/checkpoint", once=True).awaitTermination()
    return s.crossmap()


@query(PAIRS)
def live_initial_pass(spark, d):
    """What is found in a log of records that were only loaded."""
    s = _new(spark)
    append_match_log(_events(spark, d), f"{s.path}/log")
    s.initial_pass()
    return s.crossmap()


@query(PAIRS)
def live_compacted(spark, d):
    """A log that was compacted folds to the same pairs."""
    base = _session(spark, d)
    s = _new(spark)
    append_match_log(base.log(), f"{s.path}/log")
    s.compact()
    return s.crossmap()


@query(ORACLES["enroll_edges"])
def enroll_configured(spark, d):
    """Enrolment as a configuration asks for it."""
    c = cfg.enroll_from_dict(json.loads(json.dumps({
        "id_field": "id", "blocking": {"fields": [{"field": "brand"}]}, "thresholds": {"review_floor": 0.8}, "top_n": 5,
        "match_fields": [{"method": "fuzzy", "field": "name", "weight": 0.6, "scorer": "wratio"}, {"method": "exact", "field": "type", "weight": 0.4}],
    })))
    pool = fx.parts(spark, d, "a")
    pool = pool.select(F.col("a_id").alias("id"), F.col("a_id").alias("seq"), *[F.col(f"a_{f}").alias(f) for f in ("name", "brand", "type")])
    return enroll.edges(pool, c["blocks"], c["fields"], c["floor"], c["top_n"]).select("enrolled_id", "matched_id", r4("score"), "rank")


@query("SELECT p_name AS text, 64 AS dim, 1.0::DOUBLE AS length FROM (SELECT DISTINCT p_name FROM part)")
def encode_texts(spark, d):
    """The built-in encoder: vectors of unit length, equal ones for equal texts."""
    part = fx.table(spark, d, "part").select(F.col("p_name").alias("text"))
    v = part.withColumn("v", encoded(F.col("text"))).distinct()
    return v.select("text", F.size("v").alias("dim"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"))
