"""SimHash near-deduplication through an inverted index on byte positions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.shared import components, save, small

SEED = 42
#: Rows of an Arrow batch handled at once.
SLICE = 512
#: Lists of the index that are longer are split by another byte.
LONGEST = 256


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, each set if it is set in over half of the XXH64 of the text's shingles of words; 0 if it has no word.

    A-Z are lower-cased, words are what lies between the six ASCII spaces; fewer words than a shingle make one.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return majority(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(bit) for bit in np.flatnonzero(counts * 2 > len(hashes))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carry: bool = False) -> DataFrame:
    """(doc_id, fp), fp as a signed long; with carry also `row`, a struct of the input's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                marks = np.array([fingerprint(t.as_py(), shingle) for t in part.column("text")], dtype=np.uint64).astype(np.int64)
                kept = [part.column(n) for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(marks)], [*(n for n in part.schema.names if n != "text"), "fp"])

    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *row, F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = df.drop("text").schema.add("fp", "long", False)
    return df.mapInArrow(run, fields)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def postings(fps: DataFrame, depth: int = 1, bits: int = 2) -> DataFrame:
    """The inverted index (mask, bytes, fp) on positional bytes: a fingerprint is listed under its byte at each of the first
    positions; at a depth above 1, under each `depth` bytes at the first depth + bits positions.

    Fingerprints that differ in at most `bits` bits have as many different bytes at most, so they share `depth` of any
    depth + bits positional bytes and meet in a list.
    """
    chosen = [sum(255 << 8 * p for p in c) for c in combinations(range(depth + bits), depth)]
    each = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in chosen])).alias("mask"))
    return each.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"), "fp")


def split(hot: DataFrame, depth: int, bits: int = 2) -> DataFrame:
    """The postings of lists of `depth` bytes dealt to lists of one more: whoever is linked in such a list also shares
    one of the bytes at the first depth + bits + 1 positions that the list does not fix."""
    more = F.array(*[F.lit(_signed(255 << 8 * p)) for p in range(depth + bits + 1)])
    each = hot.select("fp", "mask", F.explode(more).alias("more")).where(F.col("mask").bitwiseAND(F.col("more")) == 0)
    each = each.select(F.col("mask").bitwiseOR(F.col("more")).alias("mask"), "fp")
    return each.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"), "fp").distinct()


def _shorten(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Connect i with j: hook the larger root onto the smaller, then shorten the chains."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root[:] = up


def tallied(fps: np.ndarray, lists: np.ndarray, bits: int = 2) -> np.ndarray:
    """Of fingerprints sorted by list, the first that each is connected to in its list by links.

    For each pair of a list the equal positional bytes are tallied; pairs that reach the 8 - bits that a link
    guarantees are kept, and verified by counting the bits in which they differ.
    """
    root, size = np.arange(len(fps)), np.bincount(lists, minlength=1)
    left, at = size[lists] - 1, np.arange(len(fps)) - (np.cumsum(size) - size)[lists]
    left -= at  # how many follow in the list
    for ahead in range(1, int(size.max(initial=1))):
        i = np.flatnonzero(left >= ahead)
        apart = fps[i] ^ fps[i + ahead]
        tally = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        i, apart = i[tally >= 8 - bits], apart[tally >= 8 - bits]
        i = i[np.bitwise_count(apart) <= bits]
        _shorten(root, i, i + ahead)
    return root


def links(index: DataFrame, bits: int = 2) -> DataFrame:
    """Edges (u, v) of fingerprints that connect what is linked within a list: never more rows than the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None
        for batch in batches:
            rows = tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("mask", "bytes", "fp"))
            if rest is not None:
                rows = tuple(np.concatenate(x) for x in zip(rest, rows))
            mask, key, _ = rows
            if not len(mask):
                continue
            last = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])[-1]
            rest = tuple(x[last:] for x in rows)
            yield from found(*(x[:last] for x in rows))
        if rest is not None:
            yield from found(*rest)

    def found(mask: np.ndarray, key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(fps):
            lists = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            fps = np.ascontiguousarray(fps.astype(np.int64))
            root = tallied(fps.view(np.uint64), lists, bits)
            away = np.flatnonzero(root != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays([pa.array(fps[away]), pa.array(fps[root[away]])], ["u", "v"])

    return index.repartition("mask", "bytes").sortWithinPartitions("mask", "bytes", "fp").mapInArrow(run, "u long, v long")


def near_pairs(fps: DataFrame, n: int, bits: int = 2, longest: int = LONGEST) -> DataFrame:
    """Edges (u, v) that connect all of n different fingerprints (fp) that differ in at most `bits` bits.

    A list of more than `longest` is split by one positional byte more, and so on; lists of 8 - bits bytes are as long as
    they are, but hold 256 ** bits fingerprints at most, whatever the data. The first depth is one at which lists of
    evenly spread fingerprints would not be split.
    """
    depth = 1
    while depth < 8 - bits and n / 256**depth > longest:
        depth += 1
    index, edges = postings(fps, depth, bits), None
    while True:
        if depth < 8 - bits:
            hot = save(index.groupBy("mask", "bytes").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > longest).select("mask", "bytes"), "long-lists")
            if hot.head(1):
                found = links(index.join(small(hot), ["mask", "bytes"], "left_anti"), bits)
                edges = found if edges is None else edges.union(found)
                index = save(split(index.join(small(hot), ["mask", "bytes"], "left_semi"), depth, bits), "split-lists")
                depth += 1
                continue
        found = links(index, bits)
        return found if edges is None else edges.union(found)


def classes(marked: DataFrame, bits: int = 2) -> DataFrame:
    """marked (doc_id, fp) -> (fp, component_id, size): the smallest doc_id reachable from each different fingerprint."""
    found = save(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "fingerprints")
    edges = near_pairs(found.select("fp"), found.count(), bits)
    parts = components(edges, "simhash-edges")
    rooted = found.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lowest, "root").select(F.col("fp").alias("class_fp"), "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id.

    Documents whose fingerprints differ in at most `bits` bits are linked; component_id is the smallest doc_id
    reachable. Null and empty texts have fingerprint zero and are linked like others. Null ids are never the smallest,
    unless a component has no other. Repeated rows each get their row.
    """
    marked = save(fingerprints(docs, id_col, text_col, shingle), "marked")
    return marked.join(classes(marked, bits), F.col("fp") == F.col("class_fp")).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """The rows that stay, one of each component: that with the smallest id (one of repeated rows), with all its columns."""
    marked = save(fingerprints(docs, id_col, text_col, shingle, carry=True), "marked-rows")
    found = classes(marked.select("doc_id", "fp"), bits)
    first = marked.join(found, F.col("fp") == F.col("class_fp")).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = Window.partitionBy("doc_id", "fp").orderBy(F.xxhash64("row"))
    return first.withColumn("place", F.row_number().over(one)).where("place = 1").select("row.*")
