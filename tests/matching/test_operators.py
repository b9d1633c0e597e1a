import random

import pytest
from pyspark.sql import functions as F

from linkwright.operators import analysis, candidates, prematch, ranking, tables
from linkwright.operators.ranking import _rounds

PAIR = "a_id string, b_id string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_blocking_masks(spark):
    b = spark.createDataFrame([("1", "US", "x"), ("2", "", "x"), ("3", " us ", ""), ("4", None, None)], "b_id string, k string, m string")
    a = spark.createDataFrame([("p", "us", "X"), ("q", "", "x"), ("r", "US", "y")], "a_id string, k string, m string")
    got = rows(candidates.block_pairs(b, a, [("k", "k"), ("m", "m")]), "b_id", "a_id")
    assert got == [("1", "p"), ("2", "p"), ("2", "q"), ("3", "p"), ("3", "r"), ("4", "p"), ("4", "q"), ("4", "r")]
    assert len(rows(candidates.block_pairs(b, a, [("k", "k"), ("m", "m")], all_if_keyless=False), "b_id")) == 5


def test_prematch(spark):
    a = spark.createDataFrame([("1", "X"), ("2", "X"), ("3", "Y"), ("4", "")], "a_id string, a_k string")
    b = spark.createDataFrame([("8", " X "), ("7", "X"), ("9", "y"), ("5", "")], "b_id string, b_k string")
    assert rows(prematch.common_id_match(a, b, "a_k", "b_k"), "a_id", "b_id") == [("2", "7")]
    mapped = spark.createDataFrame([("2", "z")], PAIR)
    assert rows(prematch.common_id_match(a, b, "a_k", "b_k", mapped), "a_id", "b_id") == []
    assert rows(prematch.exact_prefilter(a, b, [("a_k", "b_k")]), "a_id", "b_id") == [("2", "7"), ("3", "9")]


def serial(edges):
    taken, won = set(), {}
    for b, _, a in sorted((b, r, a) for b, a, r in edges):
        if b not in won and a not in taken:
            won[b] = a
            taken.add(a)
    return sorted(won.items())


@pytest.mark.parametrize("seed", range(3))
def test_claim_in_rounds_is_serial(spark, seed):
    rng = random.Random(seed)
    edges = []
    for b in range(30):
        for rank, a in enumerate(rng.sample(range(18), 4), 1):
            edges.append((f"b{b:02}", f"a{a:02}", rank))
    df = spark.createDataFrame([(b, a, 0.99 - r / 100, r, "top_scoring") for b, a, r in edges], "b_id string, a_id string, score double, rank int, reason string")
    assert rows(_rounds(df), "b_id", "a_id") == serial(edges)
    assert rows(ranking.claim(df, 0.9), "b_id", "a_id") == serial(edges)
    pairs = rows(ranking.claim(df, 0.9, spark.createDataFrame([("a03", "b05")], PAIR)), "b_id", "a_id")
    assert len({a for _, a in pairs}) == len({b for b, _ in pairs}) == len(pairs) and not any("b05" == b or "a03" == a for b, a in pairs)


def test_a_long_chain_of_displacements(spark):
    """Each query wants the candidate that the one before it takes, then the next."""
    n = 40
    rows_ = [(f"b{k:03}", f"a{k + j:03}", 0.99 - 0.01 * j) for k in range(n) for j in (-1, 0) if k + j >= 0]
    rows_ = [(b, a, s) for b, a, s in rows_]
    df = spark.createDataFrame([(b, a, 0.95 if int(a[1:]) < int(b[1:]) else 0.9, 1, "top_scoring") for b, a, _ in rows_], "b_id string, a_id string, score double, rank int, reason string")
    taken, want = set(), {}
    for k in range(n):
        for a in (k - 1, k):
            if a >= 0 and a not in taken:
                taken.add(a)
                want[f"b{k:03}"] = f"a{a:03}"
                break
    assert rows(_rounds(df), "b_id", "a_id") == sorted(want.items()) == rows(ranking.claim(df, 0.85), "b_id", "a_id")


def test_claims_beyond_rank_255(spark):
    """The 257th candidate is the next by score, though all beyond the 255th show the same rank."""
    scores = [("b2", f"a{(k * 37) % 300:03}", 0.99 - k / 10_000) for k in range(300)]
    first = [(f"b1{k:03}", a, 0.99) for k, (_, a, _) in enumerate(scores[:256])]
    r = ranking.ranked(spark.createDataFrame(scores + first, "b_id string, a_id string, score double"), 0.85, 0.6)
    assert r.agg(F.max("rank")).first()[0] == 255
    for small in (200_000, 0):
        got = dict(rows(ranking.claim(r, 0.85, small=small), "b_id", "a_id"))
        assert got["b2"] == scores[256][1] and len(got) == 257


def test_nearest_in_tiles(spark):
    rng = random.Random(4)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    q = [(f"q{k:02}", vec() if k else None, ["x", "y", ""][k % 3]) for k in range(30)]
    p = [(f"p{k:02}", vec(), ["x", "y", "z", ""][k % 4]) for k in range(50)]
    q[4] = ("p04", p[4][1], "x")

    def cos(u, v):
        if u is None:
            return 0.0
        return sum(x * y for x, y in zip(u, v)) / sum(x * x for x in u) ** 0.5 / sum(x * x for x in v) ** 0.5

    def want(k, allowed=None):
        out = []
        for b, u, block in q:
            near = sorted((-round(cos(u, v), 9), a) for a, v, other in p if (not block or block == other) and a != b and (allowed is None or a in allowed))
            out += [(b, a) for _, a in (near[:k] if k else near)]
        return sorted(out)

    left, right = spark.createDataFrame(q, "b_id string, b_vector array<double>, b_k string"), spark.createDataFrame(p, "a_id string, a_vector array<double>, a_k string")
    for k, tile, slice_ in ((3, 4, 5), (3, 4096, 65_536), (0, 7, 3)):
        got = candidates.nearest_vectors(left, right, k, [("b_k", "a_k")], skip_self=True, tile=tile, slice_=slice_)
        assert rows(got, "b_id", "a_id") == want(k)
    some = spark.createDataFrame([(f"p{k:02}",) for k in range(0, 50, 3)] * 2, "a_id string")
    assert rows(candidates.nearest_vectors(left, right, 2, [("b_k", "a_k")], skip_self=True, allowed=some), "b_id", "a_id") == want(2, {f"p{k:02}" for k in range(0, 50, 3)})


def test_bm25_by_block(spark):
    b = spark.createDataFrame([("1", "us", "red bolt"), ("2", "", "red bolt"), ("3", "de", "gear")], "b_id string, b_k string, b_text string")
    a = spark.createDataFrame([("p", "US", "red bolt red"), ("q", "de", "red gear"), ("r", "", "bolt")], "a_id string, a_k string, a_text string")
    assert rows(candidates.bm25_raw(b, a, [("b_k", "a_k")]), "b_id", "a_id") == [("1", "p"), ("2", "p"), ("2", "q"), ("2", "r"), ("3", "q")]
    assert rows(candidates.with_block(b, a, [("b_k", "a_k")]), "b_id") == [("1",), ("2",), ("3",)]
    all_ = {(r["b_id"], r["a_id"]): r["raw"] for r in candidates.bm25_raw(b, a).collect()}
    assert all(abs(all_[r["b_id"], r["a_id"]] - r["raw"]) < 1e-12 for r in candidates.bm25_raw(b, a, [("b_k", "a_k")]).collect())


def test_gap_check_and_walk(spark):
    s = spark.createDataFrame([("1", "p", 0.90), ("1", "q", 0.87), ("2", "p", 0.95), ("2", "q", 0.7), ("3", "p", 0.9), ("4", "z", 0.2)], "b_id string, a_id string, score double")
    r = ranking.ranked(s, 0.85, 0.6, 0.1, 2).persist()
    assert rows(r.where("b_id = '1'"), "rank", "classification", "reason") == [(1, "review", "downgraded"), (2, "auto", "top_scoring")]
    won = ranking.claim(r, 0.85)
    assert rows(won, "b_id", "a_id", "reason") == [("1", "p", "downgraded")]
    out = ranking.outcomes(r, won, spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("5",)], "b_id string"), 0.85, 0.6)
    assert [(b, t, a) for b, t, a in rows(out, "b_id", "relationship_type", "a_id") if b != "5"] == [("1", "match", "p"), ("2", "review", "q"), ("3", "no_match", "p"), ("4", "no_match", "z")]


def test_crossmap(spark):
    m = spark.createDataFrame([("1", "x"), ("2", "y")], PAIR)
    new = spark.createDataFrame([("1", "y"), ("3", "z")], PAIR)
    assert rows(tables.crossmap_add(m, new), "a_id", "b_id") == [("1", "y"), ("3", "z")]
    assert rows(tables.crossmap_displaced(m, new), "a_id", "b_id") == [("1", "x"), ("2", "y")]
    assert rows(tables.crossmap_claim(m, new), "a_id", "b_id") == [("1", "x"), ("2", "y"), ("3", "z")]
    assert rows(tables.crossmap_remove(m, spark.createDataFrame([("1", "y"), ("2", "y")], PAIR)), "a_id") == [("1",)]
    left, taken = tables.crossmap_take(m, spark.createDataFrame([("1",)], "a_id string"), "a")
    assert rows(left, "a_id") == [("2",)] and rows(taken, "b_id") == [("x",)]
    assert tables.crossmap_stats(m, spark.range(4), spark.range(8)).first().asDict() == {"pairs": 2, "a_total": 4, "b_total": 8, "a_share": 50.0, "b_share": 25.0}


def test_exclusions_either_way(spark):
    pairs = spark.createDataFrame([("b1", "a1"), ("b2", "a2")], "b_id string, a_id string")
    assert rows(candidates.without_excluded(pairs, spark.createDataFrame([("b1", "a1")], PAIR)), "b_id") == [("b2",)]
    assert rows(tables.exclusion_pairs(spark.createDataFrame([("b1", "a1"), ("a2", "b2")], PAIR), spark.createDataFrame([("a1",), ("a2",)], "a_id string")), "a_id", "b_id") == [("a1", "b1"), ("a2", "b2")]


def test_groups():
    assert tables.merged_groups([["A", "b"], ["B ", "c"], ["x"], ["y", "Y"], ["p", "q"]]) == [("A", 0), ("B", 0), ("C", 0), ("P", 1), ("Q", 1)]


def test_pages(spark):
    r = spark.createDataFrame([("b", "1", "p", 0.8), ("b", "1", "q", 0.8), ("b", "2", "p", 0.9)], "side string, id string, candidate_id string, score double")
    first = tables.page_reviews(r, None, 2).collect()
    assert [(x["id"], x["candidate_id"]) for x in first] == [("2", "p"), ("1", "p")]
    assert [x["candidate_id"] for x in tables.page_reviews(r, tables.review_cursor(first[-1])).collect()] == ["q"]
    assert tables.page_reviews(r, "nonsense").count() == 3
    page, n = tables.browse(r, {"candidate_id": "P", "id": "1", "none": "x"}, exact=["id"], sort="score")
    assert n == 1 and page.first()["candidate_id"] == "p"


def test_overlap_and_accuracy(spark):
    o = spark.createDataFrame([("1", "match", "p", 0.9), ("2", "match", "q", 0.9), ("3", "review", "r", 0.7), ("4", "no_match", None, None), ("5", "no_match", "s", 0.55)], "b_id string, relationship_type string, a_id string, score double")
    t = spark.createDataFrame([("1", "p"), ("2", "z"), ("3", "r"), ("5", "s")], "b_id string, true_a_id string")
    j = analysis.populations(o, t).persist()
    got = analysis.accuracy(j).first()
    assert (got["auto_tp"], got["auto_fp"], got["review_tp"], got["fn"], got["tn"]) == (1, 1, 1, 1, 1) and got["precision"] == 0.5
    assert abs(analysis.overlap_coefficient(j).first()["overlap"] - 1 / 3) < 1e-9
    assert rows(analysis.overlap_zone(j, 0.6), "zone") == [("missed_near_floor",), ("review_match",)]
    assert analysis.histogram(j).agg(F.sum("n")).first()[0] == 5


def test_a_large_block_is_shared_out(spark, monkeypatch):
    """One block of 300 x 200 pairs leaves several tasks, none with more than a few shares of it, and no pair is lost."""
    b = spark.range(300).selectExpr("cast(id as string) as b_id", "if(id < 299, 'k', '') as b_k")
    a = spark.range(200).selectExpr("cast(id as string) as a_id", "'K ' as a_k")
    monkeypatch.setattr(candidates, "SHARE", 1000)
    got = candidates.block_pairs(b, a, [("b_k", "a_k")])
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == got.distinct().count() == 60_000 and len(sizes) > 5 and max(sizes) < 20_000


def test_bm25_without_a_pool(spark):
    """The average length of no documents is no error."""
    a, b = spark.createDataFrame([], "a_id string, a_text string, a_k string"), spark.createDataFrame([("1", "one two", "u")], "b_id string, b_text string, b_k string")
    assert candidates.corpus_stats(a).first()["average"] is None
    assert candidates.bm25_top(b, a, 5, [("b_k", "a_k")]).collect() == []
