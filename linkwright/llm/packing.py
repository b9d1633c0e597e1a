"""Packing tokenized documents into sequences by deficit round-robin over source queues."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.shared import save, small
from linkwright.llm.tokens import encoder
from linkwright.llm.training import release

SLICE_ROWS = 256
#: Fixed point of a source's quantum: fractions of a token a round.
UNIT = 1 << 16


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, part, before, n, ids): a document's ids with end_id after them, n of them, `before` tokens of
    its source come before it in its partition `part`. ids are little-endian bytes, 2 each for vocabularies below 65,536."""
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        enc, part, before = encoder(shipped.value), TaskContext.get().partitionId(), {}
        for batch in batches:
            for rows in by_size(batch, "text"):
                flat, n = enc.encode(rows.column("text"))
                flat, n = np.insert(flat, np.cumsum(n), end_id), n + 1
                ends = np.r_[0, np.cumsum(n) * enc.dtype.itemsize].astype(np.int32)
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
                starts = []
                for source, k in zip(rows.column("source").to_pylist(), n.tolist()):
                    starts.append(before.get(source, 0))
                    before[source] = starts[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("source"), pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), ids],
                    ["doc_id", "source", "part", "before", "n", "ids"],
                )

    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, source string, part int, before long, n long, ids binary")


def by_size(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column holds at most so many bytes, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


class Rounds:
    """The order in which deficit round-robin serves the sources, in closed form.

    In each round (as many tokens as a window) source s gains a quantum in proportion to its target, and is served
    whole slices while its deficit counter covers them; what is left is carried to the next round. So slice j is
    served in the first round r with r * quantum >= (j + 1) * slice, after the sources that precede s in that round.
    Any task can compute where any slice lies, without having seen the rest: deficits carry over windows and
    partitions alike.
    """

    def __init__(self, totals: list[int], shares: list[float] | None, window: int, slice_tokens: int):
        if sum(totals) >= 1 << 46 or any(w < 0 for w in shares or []):
            raise ValueError("shares must not be negative, and all tokens together fewer than 2 ** 46")
        self.totals = np.array(totals, dtype=np.int64)
        total = sum(totals)
        scale = sum(shares) if shares else 0
        wanted = [w / scale for w in shares] if scale else [t / max(total, 1) for t in totals]
        self.quantum = np.array([max(1, int(w * window * UNIT)) for w in wanted], dtype=np.int64)
        self.slice = slice_tokens
        #: the round that serves the last of a source; counting no further keeps products small
        slices = -(-self.totals // slice_tokens)
        self.last = -(-slices * slice_tokens * UNIT // self.quantum)

    def _served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of each source served by the end of each round."""
        return np.minimum(np.minimum(rounds[:, None], self.last[None, :]) * self.quantum[None, :] // (UNIT * self.slice) * self.slice, self.totals[None, :])

    def place(self, source: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Where slice j of a source starts in the stream of all tokens."""
        out, most = np.empty(len(j), dtype=np.int64), max(1, (1 << 18) // max(1, len(self.totals)))
        for at in range(0, len(j), most):
            s, k = source[at : at + most], j[at : at + most]
            r = -((-(k + 1) * self.slice * UNIT) // self.quantum[s])
            first = np.arange(len(self.totals))[None, :] < s[:, None]
            # of the own source the slices of this round come in turn, those before j are served
            other = np.where(first, self._served(r), self._served(r - 1))
            other[np.arange(len(s)), s] = k * self.slice
            out[at : at + most] = other.sum(axis=1)
        return out


def pieces_of(order: Rounds, window: int, source: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start in it, length, sequence, offset) of the pieces of documents at `start` of their source's stream."""
    size = order.slice
    first, last = start // size, (start + n - 1) // size
    count = last - first + 1
    doc = np.repeat(np.arange(len(n)), count)
    j = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    low, high = np.maximum(start[doc], j * size), np.minimum((start + n)[doc], (j + 1) * size)
    place = order.place(source[doc], j) + low - j * size
    new = np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + (high - low)[:-1])] if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    doc, begin, place, length = doc[at], (low - start[doc])[at], place[at], np.add.reduceat(high - low, at) if len(at) else high - low
    cuts = (place + length - 1) // window - place // window + 1
    k = np.repeat(np.arange(len(doc)), cuts)
    w = np.arange(len(k)) - np.repeat(np.cumsum(cuts) - cuts, cuts) + (place // window)[k]
    left, right = np.maximum(place[k], w * window), np.minimum((place + length)[k], (w + 1) * window)
    return doc[k], begin[k] + left - place[k], right - left, w, left - w * window


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    slice_tokens: int = 256,
    shares: Mapping[str | None, float] | None = None,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of documents laid out without gaps into sequences of `window` tokens: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, and the ids themselves.

    `tokenizer` is a definition as text, `shares` target proportions by source, by default those of the input, so that
    every window mirrors the corpus; when a queue runs dry the others go on, and a source without a share is served last.
    Only the last sequence can be short.
    Null texts are empty: a document has at least end_id. The null source has a queue of its own. Rows are packed one
    by one, so repeated rows repeat tokens. Only each source's name and total are held by the driver;
    each slice's place takes a step for each source, so sources should be some thousands at most.
    Token ids are written once and never shuffled: places follow from the totals by source and partition.
    """
    spark = docs.sparkSession
    table = save(tokenized(docs, tokenizer, end_id, id_col, text_col, source_col), "tokens")
    parts = table.groupBy("source", "part").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = save(parts.select("source", "part", "n", F.coalesce(upto, F.lit(0)).alias("base")), "token-bases")
    totals = base.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    index = {r["source"]: k for k, r in enumerate(totals)}
    wanted = [float(shares.get(r["source"], 0.0)) for r in totals] if shares else None
    order = Rounds([r["n"] for r in totals], wanted, window, slice_tokens)
    shipped = spark.sparkContext.broadcast((index, order, encoder(tokenizer).dtype.str))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, order, dtype = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                n = rows.column("n").to_numpy()
                start = rows.column("base").to_numpy() + rows.column("before").to_numpy()
                source = np.array([index[s] for s in rows.column("source").to_pylist()], dtype=np.int64)
                doc, begin, length, sequence, offset = pieces_of(order, window, source, start, n)
                wide = [memoryview(np.frombuffer(x.as_buffer(), dtype=dtype).astype("<u4").tobytes()) for x in rows.column("ids")]
                cut = [wide[d][4 * b : 4 * (b + k)] for d, b, k in zip(doc.tolist(), begin.tolist(), length.tolist())]
                arrays = [rows.column("doc_id").take(pa.array(doc)), pa.array(begin), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(n[doc]), pa.array(sequence), pa.array(offset)]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(cut), dtype="<i4"))
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), flat))
                yield pa.RecordBatch.from_arrays(arrays, NAMES[: len(arrays)])

    kind = dict(table.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    placed = table.join(small(base.select(F.col("source").alias("s"), F.col("part").alias("p"), "base")), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return placed.select("doc_id", "source", "before", "base", "n", "ids").mapInArrow(run, schema)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves, (sequence_id, ids, spans): at most a window of tokens each, pieces in order."""
    each = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(each.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("spans"))
