"""Candidate generation: blocking, nearest vectors, BM25, acronyms; each yields pairs (b_id, a_id)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions.acronyms import acronyms
from linkwright.functions.scalar import bm25_normalised, bm25_term, clamp, idf, key, tokens
from linkwright.operators.settle import settled


def keyed(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """df with its blocking keys as block_0, block_1, ..."""
    return df.withColumns({f"block_{k}": key(F.col(f)) for k, f in enumerate(fields)})


def by_mask(queries: DataFrame, pool: DataFrame, fields: Sequence[tuple[str, str]], look: bool = False):
    """For each set of fields that a query can have: (those queries, the pool, their shared key columns). A field that is
    empty in the query sets no condition; pool rows with an empty field only match queries without it. `look` finds out
    first which sets there are, for plans that are long."""
    q, p = keyed(queries, [b for b, _ in fields]), keyed(pool, [a for _, a in fields])
    names = [f"block_{k}" for k in range(len(fields))]
    sets = list(product([True, False], repeat=len(fields)))
    if look and fields:
        seen = {tuple(r) for r in q.select(*[F.col(n) != "" for n in names]).distinct().collect()}
        sets = [x for x in sets if x in seen] or sets[:1]
    for has in sets:
        mask = F.lit(True)
        for n, x in zip(names, has):
            mask = mask & ((F.col(n) != "") if x else (F.col(n) == ""))
        used = [n for n, x in zip(names, has) if x]
        own, other = (df.drop(*[n for n in names if n not in used]) for df in (q.where(mask), p))
        yield own, other, used


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def block_pairs(queries: DataFrame, pool: DataFrame, fields: Sequence[tuple[str, str]], all_if_keyless: bool = True) -> DataFrame:
    """Pairs that agree on all blocking fields (b field, a field), ignoring case and outer spaces.

    Queries are split by which fields they have, each part being one equi-join; a query without any pairs with the whole
    pool (all_if_keyless) or with nothing. A block's queries are dealt out by their ids, and each of its shares meets the whole
    block, so that no task makes more than about SHARE pairs of a block, however large it is.
    """
    q, p = queries.select("b_id", *dict.fromkeys(b for b, _ in fields)), pool.select("a_id", *dict.fromkeys(a for _, a in fields))
    parts = []
    for own, other, used in by_mask(q, p, fields):
        if used or all_if_keyless:
            parts.append(_spread(own.select("b_id", *used), other.select("a_id", *used), used))
    return union(parts)


#: Pairs of a block that one task makes, about.
SHARE = 20_000_000


def _spread(queries: DataFrame, pool: DataFrame, used: Sequence[str]) -> DataFrame:
    """The pairs of queries (b_id, keys) and pool (a_id, keys) with equal keys, a large block's in shares of its queries."""
    n = lambda df, name: df.groupBy(*used).agg(F.count(F.lit(1)).alias(name))
    sizes = n(queries, "_n").join(n(pool, "_m"), used) if used else n(queries, "_n").crossJoin(n(pool, "_m"))
    shares = F.least(F.col("_n"), F.ceil(F.col("_n") * F.col("_m").cast("double") / SHARE))
    large = sizes.select(*used, shares.cast("int").alias("_shares")).where("_shares > 1")
    share = F.coalesce("_shares", F.lit(1))
    with_ = lambda df: df.join(F.broadcast(large), used, "left") if used else df.crossJoin(F.broadcast(large.select(F.max("_shares").alias("_shares"))))
    asked = with_(queries).select("b_id", *used, F.pmod(F.xxhash64("b_id"), share).cast("int").alias("_share"))
    held = with_(pool).select("a_id", *used, F.explode(F.sequence(F.lit(0), share - 1)).alias("_share"))
    spark = queries.sparkSession
    # a number of tasks that is not lowered for the few bytes that come in: many pairs go out
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    asked, held = (df.repartition(tasks, *used, "_share") for df in (asked, held))
    return asked.join(held, [*used, "_share"]).select("b_id", "a_id")


def first_of_block(queries: DataFrame, pool: DataFrame, fields: Sequence[tuple[str, str]], k: int, all_if_keyless: bool = True) -> DataFrame:
    """Of the pairs of block_pairs each query's k first by a_id, without making the others."""
    q, p = queries.select("b_id", *dict.fromkeys(b for b, _ in fields)), pool.select("a_id", *dict.fromkeys(a for _, a in fields))
    parts = []
    for own, other, used in by_mask(q, p, fields):
        if used or all_if_keyless:
            first = other.select("a_id", *used).withColumn("_place", F.row_number().over(Window.partitionBy(*used).orderBy("a_id"))).where(F.col("_place") <= k).drop("_place")
            own = own.select("b_id", *used)
            parts.append((own.join(first, used) if used else own.crossJoin(first)).select("b_id", "a_id"))
    return union(parts)


def with_block(queries: DataFrame, pool: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """The b_ids of queries whose block has a pool row, without making pairs."""
    q, p = queries.select("b_id", *dict.fromkeys(b for b, _ in fields)), pool.select("a_id", *dict.fromkeys(a for _, a in fields))
    return union(own.join(other.select(*used) if used else other.limit(1).select(F.lit(1).alias("one")), used or F.lit(True), "left_semi").select("b_id") for own, other, used in by_mask(q, p, fields))


def top_k(pairs: DataFrame, score: str, k: int) -> DataFrame:
    """The k best candidates of each query, ties by a_id; 0 keeps all."""
    if not k:
        return pairs
    best = Window.partitionBy("b_id").orderBy(F.desc(score), "a_id")
    return pairs.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k).drop("_place")


#: Pool vectors that a task compares with at once, and queries that it compares with them.
TILE, SLICE = 4096, 65_536


def nearest_vectors(queries: DataFrame, pool: DataFrame, k: int, blocks: Sequence[tuple[str, str]] = (), skip_self: bool = False, allowed: DataFrame | None = None, tile: int = TILE, slice_: int = SLICE) -> DataFrame:
    """(b_id, a_id, similarity): the k nearest (0: all) of each query's blocked candidates by the cosine of b_vector and
    a_vector, exact within the block, similarities rounded to nine digits and clamped to [0, 1], ties by a_id. `allowed`
    (a_id) narrows the pool before the search, so that k are found among those allowed.

    A block is cut into tiles of pool vectors and slices of queries. A task holds one tile and lets the queries pass,
    one matrix product for each batch, of which only the k best of the tile leave it: no pair of a block is made as a
    row, and blocks of any size spread over tasks.
    """
    if allowed is not None:
        pool = pool.join(allowed.select("a_id").distinct(), "a_id", "left_semi")
    q, p = queries.select("b_id", "b_vector", *dict.fromkeys(b for b, _ in blocks)), pool.select("a_id", "a_vector", *dict.fromkeys(a for _, a in blocks))
    parts = []
    for own, other, used in by_mask(q, p, blocks):
        block = F.to_json(F.array(*used)) if used else F.lit("")
        own, other = own.select(block.alias("block"), F.col("b_id").alias("id"), F.col("b_vector").alias("v")), other.select(block.alias("block"), F.col("a_id").alias("id"), F.col("a_vector").alias("v"))
        parts.append(_tiled(own, other, k + skip_self if k else 0, tile, slice_))
    best = union(parts)
    best = top_k(best.where("b_id <> a_id") if skip_self else best, "similarity", k)
    return best.withColumn("similarity", clamp(F.col("similarity")))


def _tiled(queries: DataFrame, pool: DataFrame, k: int, tile: int, slice_: int) -> DataFrame:
    """queries and pool (block, id, v) -> (b_id, a_id, similarity): at least the k nearest of each tile."""
    tiles = pool.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    slices = queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / slice_).cast("int").alias("slices"))
    sizes = tiles.join(slices, "block")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = pool.join(sizes, "block").select("block", place("tiles").alias("tile"), each("slices").alias("slice"), F.lit(0).alias("query"), "id", "v")
    asked = queries.join(sizes, "block").select("block", each("tiles").alias("tile"), place("slices").alias("slice"), F.lit(1).alias("query"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, matrix = None, [], [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("block", "tile", "slice", "query"))))
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                *here, query = keys[a]
                if here != key:
                    key, ids, vectors, matrix = here, [], [], None
                part = batch.slice(a, b - a)
                if not query:
                    ids += part.column("id").to_pylist()
                    vectors.append(part.column("v"))
                elif ids:
                    if matrix is None:
                        matrix = _matrix(vectors)
                    for at in range(0, b - a, 512):
                        some = part.slice(at, 512)
                        yield nearest(some.column("id").to_pylist(), _matrix([some.column("v")]), ids, matrix)

    def nearest(q_ids: list, q: np.ndarray, ids: list, x: np.ndarray) -> pa.RecordBatch:
        s = np.round(q @ x.T, 9) if q.shape[1] == x.shape[1] else np.zeros((len(q), len(x)))
        if 0 < k < len(ids):
            i, j = np.nonzero(s >= np.partition(s, -k, axis=1)[:, -k][:, None])
        else:
            i, j = (x.ravel() for x in np.indices(s.shape))
        return pa.RecordBatch.from_arrays([pa.array([q_ids[n] for n in i]), pa.array([ids[n] for n in j]), pa.array(s[i, j])], ["b_id", "a_id", "similarity"])

    names = ["block", "tile", "slice"]
    rows = held.unionByName(asked).repartition(*names).sortWithinPartitions(*names, "query", "id")
    return rows.mapInArrow(run, "b_id string, a_id string, similarity double")


def _matrix(columns: list[pa.Array]) -> np.ndarray:
    """Unit vectors as rows; vectors that are null or shorter than the longest are filled with zeros, zero stays zero."""
    rows = [np.array(v or [], dtype=float) for c in columns for v in c.to_pylist()] if any(len(set(pc.list_value_length(c).to_pylist())) > 1 or c.null_count for c in columns) else None
    if rows is None:
        out = np.concatenate([c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), -1) for c in columns])
    else:
        out = np.zeros((len(rows), max(map(len, rows))))
        for n, v in enumerate(rows):
            out[n, : len(v)] = v
    length = np.sqrt((out * out).sum(axis=1))[:, None]
    return np.divide(out, length, out=out, where=length > 0)


def corpus_stats(pool: DataFrame, text: str = "a_text") -> DataFrame:
    """One row: docs, all_tokens, average (null without docs)."""
    n = F.size(tokens(F.col(text)))
    return pool.select(n.cast("long").alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_tokens")).withColumn("average", F.try_divide("all_tokens", "docs"))


def term_counts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, tf, length) of each row's terms."""
    each = df.select(id_col, tokens(F.col(text)).alias("t"))
    return each.select(id_col, F.size("t").alias("length"), F.explode("t").alias("term")).groupBy(id_col, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_raw(queries: DataFrame, pool: DataFrame, blocks: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(b_id, a_id, raw): BM25 of each query's different terms against the pool, whose statistics cover all of it.

    The fields of `blocks` (b field, a field) join the condition on the term, so that a frequent term only meets its own
    block; a query's empty fields set no condition.
    """
    stats = corpus_stats(pool)
    postings = term_counts(pool, "a_id", "a_text")
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = postings.join(frequency, "term").join(F.broadcast(stats))
    weight = bm25_term(F.col("tf"), idf(F.col("docs"), F.col("df")), F.col("length"), F.col("average"))
    weights = weights.select("a_id", "term", weight.alias("w"))
    if blocks:
        weights = settled(weights.join(pool.select("a_id", *dict.fromkeys(a for _, a in blocks)), "a_id"))
    terms = queries.select("b_id", *dict.fromkeys(b for b, _ in blocks), F.explode(F.array_distinct(tokens(F.col("b_text")))).alias("term"))
    parts = [own.join(other, ["term", *used]).groupBy("b_id", "a_id").agg(F.sum("w").alias("raw")) for own, other, used in by_mask(terms, weights, blocks)]
    return union(parts)


def bm25_self(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(b_id, own): each query's score as if it were a document of the pool, counting repeated terms; terms that the
    pool does not have are skipped."""
    frequency = term_counts(pool, "a_id", "a_text").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    each = term_counts(queries, "b_id", "b_text").join(frequency, "term").join(F.broadcast(corpus_stats(pool)))
    term = bm25_term(F.col("tf"), idf(F.col("docs"), F.col("df")), F.col("length"), F.col("average"))
    return each.groupBy("b_id").agg(F.sum(term).alias("own"))


def bm25_top(queries: DataFrame, pool: DataFrame, k: int, blocks: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(b_id, a_id, raw, bm25): the k best of each query, and their score over the query's own."""
    best = top_k(bm25_raw(queries, pool, blocks), "raw", k)
    return best.join(bm25_self(queries, pool), "b_id").select("b_id", "a_id", "raw", bm25_normalised(F.col("raw"), F.col("own")).alias("bm25"))


def synonym_keys(df: DataFrame, id_col: str, name: Column, least: int = 3, groups: DataFrame | None = None, query: bool = False) -> DataFrame:
    """(id, key): a value and its acronyms in upper case; for queries also the dictionary's equivalents and theirs."""
    base = df.select(id_col, F.upper(F.trim(F.coalesce(name, F.lit("")))).alias("raw"), acronyms(name, least).alias("short"))
    found = base.select(id_col, F.explode(F.array_union(F.array("raw"), "short")).alias("key"))
    if query and groups is not None:
        mine = base.join(groups.select(F.col("term").alias("raw"), "group_id"), "raw")
        other = mine.join(groups, "group_id").where("term <> raw").select(id_col, F.explode(F.array_union(F.array("term"), acronyms(F.col("term"), least))).alias("key"))
        found = found.unionByName(other)
    return found.where("key <> ''").distinct()


def synonym_pairs(queries: DataFrame, pool: DataFrame, b_name: str, a_name: str, least: int = 3, groups: DataFrame | None = None) -> DataFrame:
    """Pairs in which one value is an acronym or a synonym of the other; not limited to the query's block."""
    q = synonym_keys(queries, "b_id", F.col(b_name), least, groups, query=True)
    return q.join(synonym_keys(pool, "a_id", F.col(a_name), least), "key").select("b_id", "a_id").distinct()


def union_candidates(**sources: DataFrame) -> DataFrame:
    """The pairs that any source found, once each, with a flag from_<source> for those that did."""
    names = list(sources)
    parts = [df.select("b_id", "a_id", *[F.lit(n == m).alias(f"from_{m}") for m in names]) for n, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("b_id", "a_id").agg(*[F.max(f"from_{n}").alias(f"from_{n}") for n in names])


def without_self(pairs: DataFrame) -> DataFrame:
    """For matching a pool with itself: no row is its own candidate."""
    return pairs.where(F.col("b_id") != F.col("a_id"))


def without_excluded(pairs: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Pairs that no exclusion (a_id, b_id) forbids, whichever way round it is written."""
    both = exclusions.select("a_id", "b_id").union(exclusions.select(F.col("b_id"), F.col("a_id"))).distinct()
    return pairs.join(both, ["a_id", "b_id"], "left_anti")
