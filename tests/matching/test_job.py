import csv
import json

import pytest
from pyspark.sql import functions as F

from linkwright import cli
from linkwright.cli import tune
from linkwright.plans import build, cache, job
from linkwright.plans import config as cfg
from linkwright.sources import readers, sinks

A = [
    ("ENT-1", "Quillfeather, Ostrom and Velde BV", "NL", "LEI1", "1 Canal St"),
    ("ENT-2", "Acme Corporation", "US", "LEI2", "5 Main Rd"),
    ("ENT-3", "Global Trade Partners", "US", "", "9 Harbour Way"),
    ("ENT-4", "Northern Lights Energy", "NO", "LEI4", ""),
    ("ENT-5", "Acme Holdings", "US", "", "7 Main Rd"),
]
B = [
    ("CP-1", "QOV", "NL", "", ""),
    ("CP-2", "ACME Corp.", "us", "LEI2", "5 Main Road"),
    ("CP-3", "Global Trade Partners", "US", "", "9 Harbour Way"),
    ("CP-4", "Something Else", "DE", "", ""),
    ("CP-5", "Acme Holdings", "US", "", "7 Main Rd"),
    ("CP-6", "Acme Holding", "US", "", "7 Main Rd"),
]


def raw(base, **more):
    return {
        "job": {"name": "t"},
        "datasets": {"a": {"path": f"{base}/a.csv", "id_field": "entity_id", "common_id_field": "lei"}, "b": {"path": f"{base}/b.csv", "id_field": "counterparty_id", "common_id_field": "lei_code"}},
        "blocking": {"enabled": True, "fields": [{"field_a": "country", "field_b": "domicile"}]},
        "match_fields": [
            {"method": "embedding", "field_a": "legal_name", "field_b": "name", "weight": 0.4},
            {"method": "fuzzy", "field_a": "legal_name", "field_b": "name", "scorer": "wratio", "weight": 0.3},
            {"method": "bm25", "weight": 0.2},
            {"method": "exact", "field_a": "country", "field_b": "domicile", "weight": 0.1},
            {"method": "synonym", "field_a": "legal_name", "field_b": "name", "weight": 0.5},
        ],
        "embeddings": {"model": "hashed"},
        "thresholds": {"auto_match": 0.85, "review_floor": 0.5},
        "cross_map": {"backend": "local", "path": f"{base}/crossmap", "a_id_field": "entity_id", "b_id_field": "counterparty_id"},
        "output": {"path": f"{base}/out", "parquet_dir": f"{base}/parquet", "results_path": f"{base}/direct"},
        "scoring_log": {"enabled": True},
    } | more


@pytest.fixture
def base(tmp_path):
    for name, head, rows in (("a", ["entity_id ", "legal_name", "country", "lei", "address"], A), ("b", ["counterparty_id", "name", "domicile", "lei_code", "address"], B)):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            csv.writer(f).writerows([head, *rows])
    return str(tmp_path)


def test_run(spark, base):
    c = cfg.from_dict(raw(base))
    assert c.required("a") == ["country", "entity_id", "legal_name", "lei"]
    r = job.run(spark, c)
    got = {x["b_id"]: (x["relationship_type"], x["a_id"], x["reason"]) for x in r.relationships.collect()}
    assert got["CP-2"] == ("match", "ENT-2", "canonical") and got["CP-3"][:2] == got["CP-5"][:1] + ("ENT-3",) == ("match", "ENT-3")
    assert got["CP-5"][1] == "ENT-5" and got["CP-1"][1] == "ENT-1" and got["CP-4"][0] == "no_match" and got["CP-6"][0] != "match"
    assert {x["counterparty_id"] for x in spark.read.csv(f"{base}/crossmap", header=True).collect()} >= {"CP-2", "CP-3", "CP-5"}
    again = job.match(c, r.a, r.b, readers.pairs(spark, c.crossmap_path, "entity_id", "counterparty_id"))
    assert {x["reason"] for x in again.relationships.where("b_id = 'CP-2'").collect()} == {"crossmap"}
    rows = spark.read.csv(f"{base}/out/relationships.csv", header=True).collect()
    assert {x["score"] for x in rows if x["reason"] == "canonical"} == {"1.0000"} and "legal_name" in rows[0].asDict()
    assert [x["b_id"] for x in spark.read.csv(f"{base}/out/unmatched.csv", header=True).collect()][0] == "CP-4"
    assert spark.table("confirmed_matches").count() == sum(t == "match" for t, _, _ in got.values())
    assert spark.table("unmatched_b").count() == sum(t == "no_match" for t, _, _ in got.values())
    assert spark.table("relationship_detail").where("method = 'bm25'").count() > 0 and spark.table("summary").count() >= 2
    log = readers.match_log(spark, f"{base}/out/match_log")
    assert log.count() == len(B) and log.where("type = 'crossmap_confirm'").count() == spark.table("confirmed_matches").count()
    assert readers.scoring_log(spark, f"{base}/out/scoring_log").count() >= 3
    assert "legal_name_name_score" in spark.read.csv(f"{base}/direct", header=True).columns
    assert spark.read.parquet(f"{base}/parquet/field_scores.parquet").columns == ["a_id", "b_id", "field_a", "field_b", "method", "score", "weight"]


def test_export_makes_the_outputs_again(spark, base):
    c = cfg.from_dict(raw(base))
    job.run(spark, c)
    read = lambda name: sorted(map(tuple, spark.read.csv(f"{base}/out/{name}.csv", header=True).collect()), key=str)
    before = {n: read(n) for n in ("relationships", "unmatched", "candidates")}
    crossmap = sorted(map(tuple, spark.read.csv(f"{base}/crossmap", header=True).collect()))
    n = readers.match_log(spark, f"{base}/out/match_log").count()
    for name in before:
        spark.range(1).write.mode("overwrite").csv(f"{base}/out/{name}.csv", header=True)
    made = build.export(spark, c)
    assert {name: read(name) for name in before} == before
    assert readers.match_log(spark, f"{base}/out/match_log").count() == n and sorted(map(tuple, spark.read.csv(f"{base}/crossmap", header=True).collect())) == crossmap
    assert {x["relationship_type"] for x in made.relationships.collect()} <= {"match", "review", "candidate"}
    job.run(spark, c)  # a second run is a run of its own: all B records are known from the cross-map or scored again
    assert build.export(spark, c).relationships.where("reason = 'crossmap'").count() == len(crossmap)


def test_vectors_are_encoded_once(spark, base):
    c = cfg.from_dict(raw(base, embeddings={"model": "hashed", "cache_dir": f"{base}/vectors"}))
    r = job.run(spark, c)
    a, b = r.a, r.b
    plain = job.match(cfg.from_dict(raw(base)), a, b, spark.createDataFrame([], "a_id string, b_id string"))
    cached = job.match(c, a, b, spark.createDataFrame([], "a_id string, b_id string"))
    rows = lambda x: sorted((y["b_id"], y["a_id"] or "", y["score"] or 0) for y in x.relationships.collect())
    assert rows(plain) == rows(cached)
    names = a.select(F.trim("a_legal_name").alias("t"))
    assert cache.missing(names, F.col("t"), f"{base}/vectors", "hashed").count() == 0
    more = names.union(spark.createDataFrame([("New Name",), (" New Name ",)], "t string"))
    assert [x["text"] for x in cache.missing(more, F.trim("t"), f"{base}/vectors", "hashed").collect()] == ["New Name"]
    assert cache.status(spark, f"{base}/vectors").first()["dim"] == 64
    cache.keep(spark, f"{base}/vectors", "hashed", spark.createDataFrame([], "hash string"))
    assert cache.stored(spark, f"{base}/vectors", "hashed").count() == 0 and cache.clear(spark, f"{base}/vectors")


def test_an_exchange_that_a_crash_cuts_short(spark, tmp_path):
    """At each point between two renames a reader finds the old table or the new one."""
    path = str(tmp_path / "t")
    count = lambda: spark.read.parquet(path).count() if sinks.recovered(spark, path) else None
    assert count() is None
    sinks.replace_table(spark, path, lambda p: spark.range(3).write.parquet(p))
    spark.range(5).write.parquet(f"{path}.new")  # complete, not yet in place
    assert count() == 5
    (tmp_path / "t").rename(tmp_path / "t.old")  # moved away, the new one not yet moved in
    assert count() == 5
    spark.range(7).write.parquet(f"{path}.new")
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert count() == 7 and not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()
    spark.range(9).write.parquet(f"{path}.abcd")  # not complete: it never counts
    assert count() == 7


def test_command_line(spark, base, capsys):
    import yaml

    c = raw(base, embeddings={"model": "hashed", "cache_dir": f"{base}/vectors"}, live={"crossmap_flush_secs": 1})
    with open(f"{base}/c.yaml", "w") as f:
        yaml.safe_dump(c, f)
    with open(f"{base}/e.yaml", "w") as f:
        yaml.safe_dump({"id_field": "entity_id", "dataset": {"path": f"{base}/a.csv"}, "match_fields": [{"method": "fuzzy", "field": "legal_name", "weight": 1.0}], "blocking": {"fields": [{"field": "country"}]}, "thresholds": {"review_floor": 0.3}}, f)
    assert cli.main(["validate", f"{base}/c.yaml"]) == 0 and cli.main(["validate", f"{base}/none.yaml"]) == 1
    for args in (["run"], ["export"], ["crossmap", "stats"], ["cache", "build"], ["cache", "clear"]):
        assert cli.main([*args, f"{base}/c.yaml"]) == 0
    assert cli.main(["enroll", f"{base}/e.yaml", "--out", f"{base}/edges"]) == 0 and spark.read.parquet(f"{base}/edges").count() >= 1
    (tmp := __import__("pathlib").Path(base) / "events").mkdir()
    (tmp / "1.json").write_text(json.dumps({"seq": 0, "type": "upsert_record", "side": "a", "id": "1", "record": {"entity_id": "1", "legal_name": "x", "country": "us"}}))
    assert cli.main(["serve", f"{base}/c.yaml", "--events", str(tmp), "--state", f"{base}/state", "--checkpoint", f"{base}/cp", "--once"]) == 0
    assert readers.match_log(spark, f"{base}/state/log").where("type = 'upsert_record'").count() == 1


def test_exclusions_prefilter_and_modes(spark, base):
    with open(f"{base}/ex.csv", "w") as f:
        f.write("entity_id,counterparty_id\nENT-3,CP-3\nCP-5,ENT-5\n")
    c = cfg.from_dict(raw(base, exclusions={"path": f"{base}/ex.csv", "a_id_field": "entity_id", "b_id_field": "counterparty_id"}, exact_prefilter={"enabled": True, "fields": [{"field_a": "legal_name", "field_b": "name"}]}))
    a, b = job.load_sides(spark, c)
    none = spark.createDataFrame([], "a_id string, b_id string")
    ex = readers.pairs(spark, c.exclusions_path, "entity_id", "counterparty_id")
    known = {x["b_id"]: x["reason"] for x in job.match(c, a, b, none, ex).relationships.where("relationship_type = 'match'").collect()}
    assert known["CP-3"] == "exact" and known["CP-2"] == "canonical"
    c.prefilter = []
    pairs = {(x["a_id"], x["b_id"]) for x in job.match(c, a, b, none, ex).ranks.collect()}
    assert ("ENT-3", "CP-3") not in pairs and ("ENT-5", "CP-5") not in pairs and ("ENT-5", "CP-6") in pairs
    only = raw(base, match_fields=[{"method": "exact", "field_a": "legal_name", "field_b": "name", "weight": 1.0}])
    c = cfg.from_dict(only)
    assert job.match(c, a, b, none).ranks.count() == 0
    assert job.match(cfg.from_dict(only | {"candidates": "blocked"}), a, b, none).ranks.count() > 0


def test_tune(spark, base):
    out = tune(spark, cfg.from_dict(raw(base)))
    acc = out["accuracy"].first()
    assert acc["auto_tp"] + acc["review_tp"] + acc["fn"] == 1 and out["fields"].count() == 5 and out["overlap"].first()["overlap"] >= 0


def test_formats(spark, tmp_path):
    with open(tmp_path / "x.jsonl", "w") as f:
        f.write('{"id": " 1 ", "n": 5, "t": null, "l": [1, 2]}\n\n{"id": "2", "n": true}\n')
    with open(tmp_path / "x.tsv", "w") as f:
        f.write("id\tn\n1\t a \n")
    got = {r["a_id"]: r for r in readers.load(spark, str(tmp_path / "x.jsonl"), "id", "a", ["n", "t", "l", "gone"]).collect()}
    assert got["1"]["a_n"] == "5" and got["1"]["a_t"] == "" and got["1"]["a_l"].replace(" ", "") == "[1,2]" and got["2"]["a_n"] == "true" and got["2"]["a_gone"] == ""
    assert readers.load(spark, str(tmp_path / "x.tsv"), "id", "b").first()["b_n"] == " a "
    spark.range(3).selectExpr("id", "id / 2 AS half", "CAST(null AS int) AS none").write.parquet(str(tmp_path / "x.parquet"))
    assert readers.load(spark, str(tmp_path / "x.parquet"), "id", "a").where("a_id = '1'").first()["a_half"] == "0.5"
    assert readers.row_count(spark, str(tmp_path / "x.jsonl")) == 2
    with open(tmp_path / "d.csv", "w") as f:
        f.write("id,n\n1,a\n1,b\n")
    with pytest.raises(ValueError, match="repeated"):
        readers.load(spark, str(tmp_path / "d.csv"), "id", "a")
    with pytest.raises(ValueError, match="no column"):
        readers.load(spark, str(tmp_path / "d.csv"), "key", "a")
    assert readers.pairs(spark, str(tmp_path / "missing.csv"), "a", "b").count() == 0
    with open(tmp_path / "syn.csv", "w") as f:
        f.write('IBM,"Big Blue, Inc"\nbig blue, inc\nalone\n')
    assert readers.dictionary(spark, str(tmp_path / "syn.csv")).count() == 4


def test_log_and_compaction(spark, tmp_path):
    path = str(tmp_path / "log")
    with open(tmp_path / "seed.json", "w") as f:
        for k, e in enumerate([{"type": "upsert_record", "side": "a", "id": "1", "record": {"x": "1"}}, {"type": "upsert_record", "side": "a", "id": "1", "record": {"x": "2"}}, {"type": "exclude", "a_id": "1", "b_id": "2"}, {"type": "upsert_record", "side": "b", "id": "2"}, {"type": "remove_record", "side": "b", "id": "2"}]):
            f.write(json.dumps({"seq": k, **e}) + "\n")
        f.write("not json\n")
    log = readers.match_log(spark, str(tmp_path / "seed.json"))
    assert log.count() == 5
    sinks.append_match_log(log.drop("run_id"), path, "r1")
    sinks.compact_match_log(spark, path)
    left = readers.match_log(spark, path, "r1").collect()
    assert sorted((r["type"], (r["record"] or {}).get("x")) for r in left) == [("exclude", None), ("upsert_record", "2")]


BAD = [
    ({"job": {}}, "job.name"),
    ({"match_fields": []}, "match_fields"),
    ({"thresholds": {"auto_match": 0.5, "review_floor": 0.6}}, "above review_floor"),
    ({"thresholds": {"auto_match": 1.5}}, "auto_match"),
    ({"thresholds": {"auto_match": 0.85, "review_floor": 0.5, "min_score_gap": 1}}, "min_score_gap"),
    ({"output": {}}, "destination"),
    ({"cross_map": {"backend": "redis", "path": "x"}}, "cross_map"),
    ({"embeddings": {"model": "hashed", "remote_encoder_cmd": "x"}}, "exactly one"),
    ({"embeddings": {}}, "exactly one"),
    ({"bm25_candidates": 1}, "bm25_candidates"),
    ({"ann_candidates": 1}, "ann_candidates"),
    ({"blocking": {"enabled": True, "fields": []}}, "blocking needs"),
    ({"blocking": {"enabled": True, "operator": "or", "fields": [{"field_a": "country", "field_b": "domicile"}]}}, "operator"),
    ({"hooks": {"command": ""}}, "hooks"),
    ({"performance": {"quantization": "int8"}}, "quantization"),
    ({"performance": {"encoder_pool_size": 0}}, "encoder_pool_size"),
    ({"exclusions": {"path": "x"}}, "exclusions"),
    ({"match_fields": [{"method": "exact", "field_a": "a;b", "field_b": "b", "weight": 1}]}, "safe"),
    ({"match_fields": [{"method": "exact", "field_a": "a", "field_b": "b", "weight": 0.9}]}, "add up"),
    ({"match_fields": [{"method": "nope", "field_a": "a", "field_b": "b", "weight": 1}]}, "unknown method"),
    ({"match_fields": [{"method": "bm25", "field_a": "a", "weight": 1}]}, "bm25"),
    ({"match_fields": [{"method": "fuzzy", "field_a": "a", "field_b": "b", "scorer": "x", "weight": 1}]}, "scorer"),
]


@pytest.mark.parametrize("change, message", BAD)
def test_validation(change, message):
    with pytest.raises(cfg.ConfigError, match=message):
        cfg.from_dict(raw("/data", **change))


def test_parse():
    import yaml

    c = cfg.parse(yaml.safe_dump(raw("/data")))
    assert c.top_n == 5 and c.bm25_fields == [("legal_name", "name"), ("legal_name", "name")] and c.synonym_fields == [("legal_name", "name", 3)]
    for text in ("- a", "a: [", ""):
        with pytest.raises(cfg.ConfigError):
            cfg.parse(text)
    assert cfg.enroll_from_dict({"id_field": "id", "match_fields": [{"method": "exact", "field": "x", "weight": 1}]})["fields"][0].field_a == "x"
