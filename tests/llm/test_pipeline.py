from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkwright.llm import toxicity
from linkwright.llm.mixing import row_hash
from tests.llm.test_simhash import by_hand as simhash_by_hand
from tests.llm.test_toxicity import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = corpus(150, 3)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in docs]
    rows += [(500 + i, rows[i][1], "en", "s1", 5) for i in range(0, 60, 3)]
    rows += [(700, None, None, None, None), (701, "", "en", "s0", 0), (702, "word " * 3000, "en", None, 1)]
    base = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{base}/labels.parquet")
    return base, rows


def words(text):
    return len((text or "").encode().split())


def test_stages(spark, folder, tmp_path):
    base, rows = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    held = {None: docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, base).write.parquet(path)
        docs = held[name] = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == held[None].columns
    at = {name: [tuple(r) for r in df.collect()] for name, df in held.items()}
    model = toxicity.train(held[None], spark.read.parquet(f"{base}/labels.parquet"))
    assert sorted(at["toxicity"], key=str) == sorted((r for r in rows if model.score(r[1]) < 0.5), key=str)
    first = {}
    for r in sorted(at["toxicity"]):
        first.setdefault(r[1] or "", r)
    assert sorted(at["exact_dedup"]) == sorted(first.values())
    parts = simhash_by_hand([r[:2] for r in at["exact_dedup"]])
    assert sorted(at["simhash_dedup"]) == sorted(r for r in at["exact_dedup"] if parts[r[0]][1] == r[0])
    check_mix(spark, at["simhash_dedup"], at["mixing"])
    tokens = Counter()
    for r in at["packing"]:
        tokens[r[0]] += r[2]
    total = sum(tokens.values())
    assert set(tokens) == {r[0] for r in at["mixing"]} and max(r[5] for r in at["packing"]) == (total - 1) // 2048


def check_mix(spark, rows, got):
    """The mixture by sorting all hashes."""
    by_source, size = defaultdict(list), {}
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    hashes = {r["doc_id"]: r["h"] for r in spark.createDataFrame(rows, kind).select("doc_id", row_hash(F.col("doc_id"), F.col("text")).alias("h")).collect()}
    for r in rows:
        by_source[r[3]].append((hashes[r[0]], words(r[1]), r[0]))
    order = sorted(by_source, key=lambda s: (s is None, s))
    size = {s: sum(w for _, w, _ in by_source[s]) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        for s in over or open_:
            target[s] = min(share[s], 3 * size[s])
        left -= sum(target[s] for s in over)
        open_ = open_ - set(over) if over else set()
    want = Counter()
    for s in order:
        copies = min(3, int(target[s] // size[s])) if size[s] else 0
        budget, taken = target[s] - copies * size[s], 0
        for _, w, d in sorted(by_source[s]):
            more = budget > 0 and (taken + w <= budget or (taken <= budget and budget - taken >= w / 2))
            if taken + w > budget:
                taken, w = float("inf") if taken <= budget else taken, 0
            taken += w
            want[d] += copies + more
    assert Counter(r[0] for r in got) == +want


def test_run(spark, folder):
    base, _ = folder
    assert corpus_pipeline.run(spark, base).count() > 0
