import numpy as np

from pyspark.sql import functions as F

from linkwright.llm.embedding_dedup import embedding_groups, near_links, near_pairs, recall
from linkwright.llm.hnsw import Graph

KIND = "vec_id long, embedding array<float>, label int, n_links string"


def by_hand(rows, least=0.98):
    n = len(rows)
    ok = [r[2] is not None and r[1] is not None and None not in r[1] and np.isfinite(np.array(r[1], dtype=float)).all() and any(r[1]) for r in rows]
    links = [[] for _ in rows]
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (a, b))
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                    links[a].append(b)
                    links[b].append(a)
    out, seen = [None] * n, set()
    for a in range(n):
        if a in seen:
            continue
        todo, part = [a], {a}
        while todo:
            for b in links[todo.pop()]:
                if b not in part:
                    part.add(b)
                    todo.append(b)
        seen |= part
        low = min(rows[b][0] for b in part)
        for b in part:
            out[b] = (rows[b][0], len(links[b]), low, rows[b][0] == low)
    return sorted(out)


def rows():
    rng = np.random.default_rng(4)
    made = []
    for i in range(260):
        v = rng.normal(size=16)
        made.append((i * 3, v.tolist(), i % 4))
        if i % 3 == 0:
            made.append((i * 3 + 1, (v + rng.normal(size=16) * 0.05).tolist(), i % 4 if i % 2 else 9))
    centre = rng.normal(size=16)
    made += [(5000 + i, (centre + rng.normal(size=16) * 0.08).tolist(), 1) for i in range(200)]
    made += [(9000 + i, [1.0] + [0.0] * 15, 2) for i in range(150)]
    made += [(9500, None, 1), (9501, [0.0] * 16, 1), (9502, [1.0, None] * 8, 1), (9503, [float("nan")] * 16, 1), (9504, [float("inf")] * 16, 1), (9505, [1.0] * 16, None), (9506, [1.0] * 16, None), (9507, [1.0, 2.0], 1), (9508, [1.0, 2.0], 1), (9509, [], 1)]
    made.append((9507, [1.0, 2.0], 1))
    return made


def test_against_all_pairs(spark):
    table = spark.createDataFrame([(*r, "clash") for r in rows()], KIND)
    for shard_rows in (100_000, 60):
        got = sorted(tuple(r) for r in embedding_groups(table, shard_rows=shard_rows).collect())
        assert got == by_hand(rows())


def test_recall_over_many_shards(spark):
    """One label of twelve shards and rare links: audits see links, and what they miss is below a tenth."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(5400, 32))
    base[5000:] = base[:400] + rng.normal(size=(400, 32)) * 0.05
    rows = [(k, "g", v.tolist()) for k, v in enumerate(base)]
    links = near_links(spark.createDataFrame(rows, "rid long, grp string, embedding array<double>"), shard_rows=450, together=5).persist()
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    true = ((unit @ unit.T) >= 0.98).sum() - len(unit)
    got = links.where("u is not null").agg(F.sum("n")).first()[0]
    seen, found = recall(links)
    assert true > 700 and 0.99 * true <= got <= true and seen > 300 and found >= 0.99 * seen


def test_extreme_lengths(spark):
    rows = [(1, [1e-200, 2e-200], 1, ""), (2, [2e-200, 4e-200], 1, ""), (3, [1e200, 2e200], 1, ""), (4, [1e200, -2e200], 1, ""), (5, [5e-324, 1e-323], 1, "")]
    got = sorted(tuple(r)[:3] for r in embedding_groups(spark.createDataFrame(rows, KIND.replace("float", "double"))).collect())
    assert got == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (5, 3, 1)]


def test_empty(spark):
    assert embedding_groups(spark.createDataFrame([], KIND)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, _ = Graph(x).search(x[:200], 64)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true)]) > 0.95


def test_beams_widen():
    """Beams too narrow for the links of a query are widened, or its links counted by comparing with all."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(1, 8)) + rng.normal(size=(80, 8)) * 0.02, rng.normal(size=(400, 8))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = near_pairs(x, x, Graph(x), 0.98, same=True, beam=4)
    assert (found.count == (x @ x.T >= 0.98).sum(axis=1) - 1).all()
