import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from linkwright.llm import shared
from linkwright.llm.simhash import classes, fingerprint, near_pairs, postings, simhash_dedup, simhash_groups, tallied


def plain(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint():
    for t in (None, "", " \t ", "One", "one TWO", "a b c", "A b\xa0c d É e f g" * 9, "x y " * 300):
        assert fingerprint(t) == plain(t)


def by_hand(rows):
    fps = {i: plain(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (f"{fps[i]:016x}", find(i)) for i in fps}


def test_groups(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghijk") + str(rng.randrange(40)) for _ in range(rng.randrange(3, 200))] for _ in range(30)]
    rows = []
    for i in range(200):
        words = list(rng.choice(base))
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i + 3, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "\n")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_groups(docs).collect()}
    assert got == by_hand(rows)
    left = simhash_dedup(docs.union(docs.where("doc_id = 3")))
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for _, c in got.values()})


def test_chain_and_links(spark):
    """A chain of fingerprints two bits apart is one component, though its ends differ in many."""
    chain = [0]
    for k in range(0, 60, 2):
        chain.append(chain[-1] | 3 << k)
    chain += [1 << 63 | 1 << 61 | 1 << 59]
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(chain)]
    got = {r["class_fp"]: r["component_id"] for r in classes(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert [got[f] for _, f in rows] == [0] * 31 + [31]


def components_of(fps):
    """By all pairs: the smallest fingerprint (unsigned) reachable from each."""
    far = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    root = np.arange(len(fps))
    while True:
        new = np.where(far, root[None, :], len(fps)).min(axis=1)
        if (new == root).all():
            return root
        root = new


def test_tally_of_a_long_list():
    rng = np.random.default_rng(3)
    members = np.unique(rng.integers(0, 1 << 16, 900, dtype=np.uint64) << np.uint64(8))
    assert (tallied(members, np.zeros(len(members), dtype=int)) == components_of(members)).all()


@pytest.mark.parametrize("longest", [1, 5, 10_000])
def test_long_lists_are_split_without_loss(spark, longest):
    """Fingerprints that share most of their bytes, so that lists are long at every depth."""
    rng = np.random.default_rng(longest)
    base = rng.integers(0, 1 << 62, 12, dtype=np.uint64)
    noise = [np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 5), dtype=np.uint64), initial=np.uint64(0)) for _ in range(400)]
    fps = np.unique(np.array([base[k % 12] ^ noise[k] for k in range(400)], dtype=np.uint64))
    rows = [(int(x),) for x in fps.view(np.int64)]
    edges = near_pairs(spark.createDataFrame(rows, "fp long"), 1 if longest == 1 else len(rows), longest=longest).collect()
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    root = list(range(len(fps)))
    for e in edges:
        assert (int(fps[at[e["u"]]]) ^ int(fps[at[e["v"]]])).bit_count() >= 1
        x, y = sorted((root[at[e["u"]]], root[at[e["v"]]]))
        root = [x if r == y else r for r in root]
    assert root == components_of(fps).tolist()
    assert postings(spark.createDataFrame(rows, "fp long"), 2).count() == 6 * len(rows)


def test_empty_and_nulls(spark):
    kind = "doc_id long, text string"
    assert simhash_groups(spark.createDataFrame([], kind)).count() == 0
    got = simhash_groups(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c")], kind)).collect()
    assert [r["component_id"] for r in got] == [4, 4, 4]


@pytest.mark.parametrize("longest", [1, 30, 10_000])
def test_four_bits(spark, longest):
    rng = np.random.default_rng(longest)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    noise = [np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 8), dtype=np.uint64), initial=np.uint64(0)) for _ in range(300)]
    fps = np.unique(np.array([base[k % 40] ^ noise[k] for k in range(300)], dtype=np.uint64)).view(np.int64).tolist()
    unsigned = {x: x % (1 << 64) for x in fps}
    edges = near_pairs(spark.createDataFrame([(x,) for x in fps], "fp long"), len(fps), bits=4, longest=longest).collect()
    got, want = {x: x for x in fps}, {x: x for x in fps}

    def join(root, a, b):
        x, y = sorted((root[a], root[b]))
        root.update({i: x for i, r in root.items() if r == y})

    for e in edges:
        join(got, e["u"], e["v"])
    for a, b in combinations(fps, 2):
        if (unsigned[a] ^ unsigned[b]).bit_count() <= 4:
            join(want, a, b)
    assert got == want and 20 < len(set(want.values())) < len(fps) - 20


def test_few_edges_are_joined_at_once(spark, monkeypatch):
    rng, saved, save = random.Random(4), [], shared.save
    rows = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(70)] + [(None, 3), (4, None), (7, 7)] + [(k, k + 1) for k in range(1000, 1100)]
    edges = spark.createDataFrame(rows, "u long, v long")
    want = sorted(map(tuple, shared.components(edges).collect()))
    monkeypatch.setattr(shared, "save", lambda df, name: saved.append(name) or save(df, name))
    assert sorted(map(tuple, shared.components(edges, few=1000).collect())) == want
    assert len(saved) == 1
    assert sorted(map(tuple, shared.components(edges, few=100).collect())) == want
    assert shared.components(edges.limit(0), few=1000).count() == 0
