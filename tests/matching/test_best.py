"""The best candidates by classes of equal values against all pairs, scored one by one."""

import random

import pytest
from pyspark.sql import functions as F

from linkwright.functions.fuzzy import wratio
from linkwright.operators import best, scoring
from linkwright.operators.candidates import block_pairs, first_of_block
from linkwright.streaming import enroll

FIELDS = [scoring.MatchField("fuzzy", 0.5, "name", "name"), scoring.MatchField("exact", 0.3, "code", "code"), scoring.MatchField("numeric", 0.2, "size", "size")]
BLOCKS = [("b_k", "a_k"), ("b_m", "a_m")]


def side(spark, s, n, seed, own_codes):
    """Few values, so that many scores tie; ids in another order than seq; some block fields are empty."""
    rng = random.Random(seed)
    rows = []
    for seq, k in enumerate(rng.sample(range(n), n)):
        code = rng.choice(["c1", "C1 ", "c2", ""] + [f"{s}{k}"] * own_codes)
        rows.append((f"{k:03}", seq * 2 + (s == "b"), rng.choice(["Red Bolt", "red bolt ", "bolt red", "blue nut", ""]), code, rng.choice(["1", "1.0", "2", "x"]), rng.choice(["u", "U", "v", ""]), rng.choice(["p", "q", ""])))
    return spark.createDataFrame(rows, ", ".join(f"seq_{s} long" if c == "seq" else f"{s}_{c} string" for c in ("id", "seq", "name", "code", "size", "k", "m")))


def brute(a, b, k, keyless, skip_self, earlier, floor=0.0):
    key = lambda x: x.strip().lower()
    out = set()
    for q in b.collect():
        has = [x for x in "km" if q[f"b_{x}"]]
        if not has and not keyless:
            continue
        found = []
        for p in a.collect():
            if any(key(q[f"b_{x}"]) != key(p[f"a_{x}"]) for x in has) or skip_self and q.b_id == p.a_id or earlier and p.seq_a >= q.seq_b:
                continue
            exact = key(q.b_code) == key(p.a_code) != ""
            numeric = "x" not in (q.b_size, p.a_size) and float(q.b_size) == float(p.a_size)
            score = round(0.5 * wratio(p.a_name, q.b_name) + 0.3 * exact + 0.2 * numeric, 9)
            if score >= floor:
                found.append((-score, p.a_id))
        out |= {(q.b_id, i, -s) for s, i in sorted(found)[:k]}
    return out


@pytest.mark.parametrize("keyless, skip_self, earlier, few", [(True, False, False, 200_000), (False, True, False, 0), (True, False, True, 0), (True, True, True, 200_000)])
def test_best_of_all_pairs(spark, monkeypatch, keyless, skip_self, earlier, few):
    monkeypatch.setattr(best, "FEW_CLASSES", few)
    monkeypatch.setattr(scoring.fuzzy_tables, "__defaults__", (few, ""))
    a, b = side(spark, "a", 90, 1, 2), side(spark, "b", 90, 2, 2)
    got = best.best_candidates(b, a, BLOCKS, FIELDS, 3, keyless, skip_self, earlier)
    assert all(len(r["field_scores"]) == 3 for r in got.head(5))
    assert {(r["b_id"], r["a_id"], round(r["score"], 9)) for r in got.collect()} == brute(a, b, 3, keyless, skip_self, earlier)


def test_a_floor_before_the_cut(spark):
    a, b = side(spark, "a", 60, 3, 0), side(spark, "b", 60, 4, 0)
    got = best.best_candidates(b, a, [], FIELDS, 2, earlier=True, floor=0.7)
    assert {(r["b_id"], r["a_id"], round(r["score"], 9)) for r in got.collect()} == brute(a, b.withColumns({"b_k": F.lit(""), "b_m": F.lit("")}), 2, True, False, True, 0.7)


def test_repeated_values_make_no_pairs(spark):
    """2,000 records a side in one block have 4,000,000 pairs and 4 pairs of classes: only these are scored."""
    a = spark.range(2000).select(F.format_string("%05d", "id").alias("a_id"), F.lit("u").alias("a_k"), F.concat(F.lit("n"), F.col("id") % 2).alias("a_name"))
    b = spark.range(2000).select(F.format_string("%05d", "id").alias("b_id"), F.lit("u").alias("b_k"), F.concat(F.lit("n"), F.col("id") % 2).alias("b_name"))
    seen = spark.sparkContext.accumulator(0)
    old = best._scored

    def counted(met, fields, tables):
        seen.add(met.count())
        return old(met, fields, tables)

    best._scored = counted
    try:
        got = best.best_candidates(b, a, [("b_k", "a_k")], FIELDS[:1], 5).groupBy("b_id").count().groupBy("count").count().collect()
    finally:
        best._scored = old
    assert [tuple(r) for r in got] == [(5, 2000)] and seen.value == 4


def test_first_of_block(spark):
    a, b = side(spark, "a", 40, 5, 0), side(spark, "b", 40, 6, 0)
    every = {}
    for r in block_pairs(b, a, BLOCKS).collect():
        every.setdefault(r["b_id"], []).append(r["a_id"])
    got = first_of_block(b, a, BLOCKS, 3).collect()
    assert sorted(map(tuple, got)) == sorted((q, i) for q, ids in every.items() for i in sorted(ids)[:3])


def test_enrolment_without_the_pairs_of_a_block(spark):
    """As pair by pair, where a top_n of 0 keeps every edge; each record with few values meets classes, not records."""
    pool = side(spark, "a", 80, 7, 1).withColumnsRenamed({"seq_a": "seq"} | {f"a_{c}": c for c in ("id", "name", "code", "k")}).select("id", "seq", "name", "code", "k")
    fields = [scoring.MatchField("fuzzy", 0.6, "name", "name"), scoring.MatchField("exact", 0.4, "code", "code")]
    new = pool.where("id > '020'").select("id")
    for some in (None, new):
        every = enroll.edges(pool, ["k"], fields, 0.5, 0, some).where("rank <= 3")
        got = enroll.edges(pool, ["k"], fields, 0.5, 3, some)
        assert got.schema.simpleString() == every.schema.simpleString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))
