"""Embedding near-deduplication by navigable small-world graphs per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.hnsw import BATCH, Graph
from linkwright.llm.shared import components, save, small

#: How far single precision may put a similarity below its true value.
SLACK = 1e-4


#: Queries that are searched together against another shard.
QUERIES = 4096


class Found:
    """Links between two lists of vectors, counted for each, with what they connect; and the audit's links, all and found."""

    def __init__(self, n: int, m: int):
        self.count, self.root = np.zeros(n + m, dtype=np.int64), np.arange(n + m)
        self.true = self.hits = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Different pairs, each given once."""
        self.count += np.bincount(i, minlength=len(self.count)) + np.bincount(j, minlength=len(self.count))
        self.join(i, j)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != (up := root[root])).any():
                root[:] = up


def audited(best: np.ndarray, audits: int) -> np.ndarray:
    """The order in which queries are audited: by turns the one with the nearest neighbour found, where links are to be
    expected and a beam may have stopped short of some, and a random one."""
    near, random = np.argsort(-best, kind="stable"), np.random.default_rng(7).permutation(len(best))
    mixed = np.stack([near, random], axis=1).ravel()
    _, first = np.unique(mixed, return_index=True)
    return mixed[np.sort(first)]


def near_pairs(q: np.ndarray, x: np.ndarray, graph: Graph, least: float, same: bool, beam: int = 64, recall: float = 0.999, audits: int = 256) -> Found:
    """Links of cosine >= least between unit vectors (double precision) q and those of a graph, x; same: q is x.

    Beams start at `beam` wide. A query at least half of whose beam are links is compared with all of the shard
    instead, in blocks, as its links may be more than any beam. For an audit queries are compared with all of the
    shard, until they have shown `audits` links other than to themselves, or eight times as many queries are used up;
    while less than `recall` of their links had been found, beams are doubled and all searched again.
    """
    n, m = len(q), len(x)
    found = Found(n, 0 if same else m)
    shift = 0 if same else n
    beam, order = min(beam, m), None
    truth: dict[int, np.ndarray] = {}
    while True:
        pairs, dense, best = [], [], []
        for at in range(0, n, BATCH):
            ids, sims = graph.search(q[at : at + BATCH], beam)
            close = (sims >= least - SLACK) & (ids >= 0)
            wide = close.sum(axis=1) * 2 >= ids.shape[1]
            dense.append(np.flatnonzero(wide) + at)
            itself = ids == np.arange(at, at + len(ids))[:, None] if same else np.zeros(ids.shape, dtype=bool)
            best.append(np.where(itself | (ids < 0), -2.0, sims).max(axis=1))
            i, k = np.nonzero(close & ~wide[:, None])
            j = ids[i, k]
            i = i + at
            true = np.einsum("pd,pd->p", q[i], x[j]) >= least
            pairs.append(np.stack([i[true], j[true]]))
        got, full = np.concatenate(pairs, axis=1).astype(np.int64), np.concatenate(dense)
        key = np.unique(got[0] * m + got[1])
        whole = np.zeros(n, dtype=bool)
        whole[full] = True
        if order is None:
            order = audited(np.concatenate(best), audits)[: 8 * audits]
            for at in range(0, len(order), 256):
                rows = order[at : at + 256]
                for a, row in zip(rows.tolist(), q[rows] @ x.T >= least):
                    truth[a] = np.flatnonzero(row)
                    truth[a] = truth[a][truth[a] != a] if same else truth[a]
                found.true = sum(map(len, truth.values()))
                if found.true >= audits:
                    break
        found.hits = sum(len(t) if whole[a] else int(np.isin(a * m + t, key).sum()) for a, t in truth.items())
        if found.hits >= recall * found.true or beam >= m:
            break
        beam = min(m, 2 * beam)
    # pairs of queries that were not compared with all: each once, found from either side
    i, j = key // m, key % m
    if same:
        i, j = np.minimum(i, j), np.maximum(i, j)
        other = (i != j) & ~whole[i] & ~whole[j]
        key = np.unique(i[other] * m + j[other])
        found.add(key // m, key % m)
    else:
        found.add(i, j + shift)
    for at in range(0, len(full), 256):
        rows = full[at : at + 256]
        mask = q[rows] @ x.T >= least
        if same:
            mask[np.arange(len(rows)), rows] = False
            # a link of two such queries is seen from both, a link to another query from here only
            found.count[rows] += mask.sum(axis=1)
            found.count[:m] += np.where(whole, 0, mask.sum(axis=0))
        else:
            found.count[rows] += mask.sum(axis=1)
            found.count[n:] += mask.sum(axis=0)
        a, b = np.nonzero(mask)
        found.join(rows[a], b + shift)
    return found


def _vectors(rows: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _rows(found: Found, ids: np.ndarray) -> pa.RecordBatch:
    """(u, n, v) of linked vectors, and a row of null, the links that the audit saw, and those of them that were found."""
    linked = np.flatnonzero(found.count)
    columns = [np.r_[ids[linked], 0], np.r_[found.count[linked], found.true], np.r_[ids[found.root[linked]], found.hits]]
    audit = np.r_[np.zeros(len(linked), dtype=bool), True]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64(), mask=audit), *(pa.array(c, pa.int64()) for c in columns[1:])], ["u", "n", "v"])


class _Shard:
    """A shard whose vectors come first, and then those that query it."""

    def __init__(self, least: float, own: bool):
        self.least, self.own, self.graph = least, own, None
        self.ids, self.vectors, self.asked, self.queries = [], [], [], []

    def take(self, query: bool, ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not query:
            self.ids.append(ids)
            self.vectors.append(vectors)
            return
        self.asked.append(ids)
        self.queries.append(vectors)
        if sum(map(len, self.asked)) >= QUERIES:
            yield from self.answer()

    def build(self) -> Iterator[pa.RecordBatch]:
        if self.graph is None:
            self.ids, self.x, self.vectors = np.concatenate(self.ids), _unit(np.concatenate(self.vectors)), None
            self.graph = Graph(self.x)
            if self.own:
                yield _rows(near_pairs(self.x, self.x, self.graph, self.least, same=True), self.ids)

    def answer(self) -> Iterator[pa.RecordBatch]:
        yield from self.build()
        if self.asked:
            q, ids = _unit(np.concatenate(self.queries)), np.concatenate([*self.asked, self.ids])
            self.asked, self.queries = [], []
            yield _rows(near_pairs(q, self.x, self.graph, self.least, same=False), ids)

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.own or self.asked:
            yield from self.answer()


def near_links(vectors: DataFrame, least: float = 0.98, shard_rows: int = 16384, together: int = 64) -> DataFrame:
    """vectors (rid, grp, embedding: finite, not zero, of one length in a group) -> (u, n, v): u has n links in one
    comparison of shards, and is connected to v by them. All vectors are indexed and all queried. Rows whose u is null
    are audits: n true links seen, v of them found.

    Groups are dealt by a hash into shards of about shard_rows, each of which becomes one graph, built by the task that
    queries it and never shipped. Vectors query their own shard's graph and those of the group's other shards, a pair
    of shards being compared once, in the one or the other by turns. Queries arrive as a stream after the shard's
    vectors; those of `together` shards are one task's, so that groups of any size spread over many tasks, each of
    which holds one shard and some thousand queries.
    """
    parts = save(vectors.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards")), "shard-counts")
    dealt = vectors.join(small(parts), "grp").withColumn("shard", F.pmod(F.xxhash64("rid"), F.col("shards")).cast("int"))
    slices = F.sequence(F.lit(0), F.floor((F.col("shards") - 1) / together).cast("int"))
    indexed = dealt.select("grp", F.col("shard").alias("target"), F.explode(slices).alias("slice"), F.lit(0).alias("query"), "shard", "rid", "embedding")
    # of shards i < j, j is queried if i + j is odd, else i
    others = F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda t: (t != F.col("shard")) & (((t > F.col("shard")) == ((t + F.col("shard")) % 2 == 1))))
    asking = dealt.select("grp", F.explode(others).alias("target"), F.floor(F.col("shard") / together).cast("int").alias("slice"), F.lit(1).alias("query"), "shard", "rid", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, None
        for batch in batches:
            names = batch.column("grp").to_pylist()
            target, slice_, query, rids = (batch.column(c).to_numpy() for c in ("target", "slice", "query", "rid"))
            new = np.array([True, *(a != b for a, b in zip(names, names[1:]))][: len(names)], dtype=bool)
            for c in (target, slice_, query):
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            for a, b in zip(starts, [*starts[1:], len(names)]):
                if (names[a], target[a], slice_[a]) != key:
                    if shard is not None:
                        yield from shard.finish()
                    key = (names[a], target[a], slice_[a])
                    shard = _Shard(least, target[a] // together == slice_[a])
                for at in range(a, b, QUERIES):
                    to = min(b, at + QUERIES)
                    yield from shard.take(bool(query[a]), rids[at:to], _vectors(batch.column("embedding").slice(at, to - at)))
        if shard is not None:
            yield from shard.finish()

    keys = ["grp", "target", "slice"]
    return indexed.unionByName(asking).repartition(*keys).sortWithinPartitions(*keys, "query", "shard", "rid").mapInArrow(run, "u long, n long, v long")


def recall(links: DataFrame) -> tuple[int, int]:
    """(true links that the audits saw, how many of them had been found)."""
    return tuple(links.where("u is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first())


def embedding_groups(table: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard_rows: int = 16384) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with equal labels (not null) and cosine >= least, in double precision, are linked. Null and zero vectors,
    those with a null or non-finite component, and those of another length link with nothing. component_id is the
    smallest vec_id reachable. Rows with the same vec_id are different vectors, of which each that has its component's
    smallest id is kept.
    """
    every = table.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    rows = save(every.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    usable = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    usable = usable.select("rid", F.concat_ws(":", F.size("embedding"), "label").alias("grp"), "embedding")
    links = save(near_links(usable, least, shard_rows), "vector-links").where("u is not null")
    counts = links.groupBy("u").agg(F.sum("n").alias("n"))
    roots = components(links.select("u", "v"), "vector-edges")
    ids = rows.select("rid", "vec_id")
    named = save(ids.join(roots, F.col("rid") == F.col("node"), "left").select("rid", "vec_id", F.coalesce("root", "rid").alias("root")), "vector-roots")
    lowest = named.groupBy("root").agg(F.min("vec_id").alias("low")).select(F.col("root").alias("r"), "low")
    return (
        named.join(lowest, F.col("root") == F.col("r"))
        .join(counts, F.col("rid") == F.col("u"), "left")
        .select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.col("low").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
