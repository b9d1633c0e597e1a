"""Bounded training samples, and counts of words by class."""

from __future__ import annotations

import ctypes
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.shared import small


_CURRENT: list = []


def only(model):
    """model, after the one that this Python worker used before it (for another query) has forgotten its tables: a worker
    keeps every broadcast value that it has read."""
    if not _CURRENT or _CURRENT[0] is not model:
        for other in _CURRENT:
            other.forget()
        _CURRENT[:] = [model]
    return model


def release() -> None:
    """Forget the tables of the model that this Python worker used, for stages that need none, and give free memory back to
    the system, where the C library can."""
    for other in _CURRENT:
        other.forget()
    _CURRENT.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def fold(doc_id: Column, folds: int) -> Column:
    """The remainder of the CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def sampled(rows: DataFrame, most: int, key: Column) -> DataFrame:
    """About `most` rows at most, chosen by a hash of the key, all of them if there are no more."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) < int(1_000_000 * most / n))


def sampled_by_class(rows: DataFrame, most: int) -> DataFrame:
    """rows (doc_id, kind, text) -> (kind, text): about `most` different rows at most, shared out equally among the kinds; what
    a small kind leaves of its share goes to the others. Chosen by a hash of id and text, copies of a row once."""
    # in order of size, each kind may take an equal share of what the smaller ones have left
    sizes, left, shares = sorted((r["n"], r["kind"]) for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()), most, []
    for k, (size, kind) in enumerate(sizes):
        quota = left / (len(sizes) - k)
        shares.append((kind, min(1.0, quota / size)))
        left -= min(size, quota)
    if not shares:
        return rows.select("kind", "text")
    share = small(rows.sparkSession.createDataFrame(shares, "kind string, share double"))
    key = F.xxhash64(F.lit("sample"), "doc_id", "text")
    chosen = rows.join(share, "kind").withColumn("key", key).where(F.pmod("key", F.lit(1_000_000)) < F.col("share") * 1_000_000)
    return chosen.dropDuplicates(["kind", "key"]).select("kind", "text")


def class_counts(texts: DataFrame, split: Callable[[str], list[str]], once: bool, most: int = 300_000) -> DataFrame:
    """texts (kind, text) -> (kind, word, n): how often, or in how many texts (once), a class has a word.

    Tasks count in a table that is passed on when it has `most` entries, before the shuffle adds them up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            kinds, words = zip(*counts) if counts else ((), ())
            kind = batch_kind or pa.string()
            return pa.RecordBatch.from_arrays([pa.array(kinds, kind), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], ["kind", "word", "n"])

        counts: Counter = Counter()
        batch_kind = None
        for batch in batches:
            batch_kind = batch.column("kind").type
            for kind, text in zip(batch.column("kind"), batch.column("text")):
                words = split(text.as_py() or "")
                k = kind.as_py()
                for w, n in (((w, 1) for w in set(words)) if once else Counter(words).items()):
                    counts[k, w] += n
                if len(counts) > most:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    kind = dict(texts.dtypes)["kind"]
    return texts.select("kind", "text").mapInArrow(run, f"kind {kind}, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))
