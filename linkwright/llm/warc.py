"""WARC archives: writing pages as records, and reading archives back by verifying chains of record offsets."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwright.llm.shared import BROADCAST_ROWS, new_path, save, small

#: Fixed values of the format.
MAGIC, VERSIONS = "WARC/1.", (b"0\r\n", b"1\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), HEX32, BASE32)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write one record per row to uncompressed archives below `path`, one file per task.

    Of rows with equal payloads (the html in UTF-8, null as empty) of least_bytes or more, that with the smallest id
    becomes a response, of repeated ids one; the others become revisits that refer to it and hold the HTTP header only.
    Null ids come last. Line ends in a url are percent-encoded. Payloads of one kind are counted before the shuffle,
    and the few columns that tell responses from revisits are joined to the pages only where payloads repeat.
    """
    payload = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "utf-8")
    base = pages.select(
        F.col(f"`{id_col}`").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"),
        F.octet_length(payload).alias("size"),
        base32_sha1(payload).alias("digest"),
    )
    groups = base.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = save(groups.where("n > 1").select(F.col("digest").alias("d"), "first"), "repeated")
    marked = base.join(small(repeated), F.col("digest") == F.col("d"), "left")
    # of several rows with the smallest id, the one of the smallest url (then any) is the response
    again = save(
        base.where(F.col("size") >= least_bytes).join(small(repeated), F.col("digest") == F.col("d"))
        .where(F.col("page_id").eqNullSafe(F.col("first"))).groupBy("digest").agg(F.min("url").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1"),
        "repeated-ids",
    )
    marked = _one_of_repeated(marked, again) if again.head(1) else marked.withColumn("first_row", F.lit(True))
    revisit = F.col("d").isNotNull() & (F.col("size") >= least_bytes) & ~(F.col("page_id").eqNullSafe(F.col("first")) & F.col("first_row"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit(MAGIC + "1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        record_id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), record_id(F.col("first")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(F.encode(body, "utf-8")).cast("string"),
        F.lit("\r\n\r\n"),
    )
    # a record ends with two line ends, the last line feed of which is the text writer's own
    marked.select(F.concat(head, body, F.lit("\r\n\r")).alias("value")).write.option("lineSep", "\n").text(path)


def _one_of_repeated(marked: DataFrame, again: DataFrame) -> DataFrame:
    """first_row: true but for the surplus rows of a payload's smallest id. Only these rows are gathered: they are counted by
    url before the shuffle, and of their equal payloads one goes on."""
    joined = marked.join(small(again.select(F.col("digest").alias("ad"), "u")), F.col("digest") == F.col("ad"), "left")
    twice = F.col("ad").isNotNull() & F.col("page_id").eqNullSafe(F.col("first"))
    keys = ["page_id", "url", "size", "digest", "d", "first"]
    counted = joined.where(twice).groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("n"), F.first("html").alias("html"))
    first = (F.col("k") == 1) & (F.col("url") == F.col("u"))
    rows = counted.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(*keys, F.when(first, F.col("html")).otherwise(F.lit("")).alias("html"), first.alias("first_row"))
    return joined.where(~twice).select(*keys, "html", F.lit(True).alias("first_row")).unionByName(rows)


def _parse(block: bytes) -> tuple | None:
    """Of what follows the magic: (bytes of the header, content length, fields), or None if it is no record's header."""
    end = block.find(b"\r\n\r\n")
    if end < 0 or block[:3] not in VERSIONS:
        return None
    fields = {}
    for line in block[3:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields or b"warc-record-id" not in fields:
        return None
    return end + 4, int(length), fields


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies from one magic to the next: (file, split, block). Files are read in splits, by any number of tasks;
    a segment belongs to the split in which it starts, and a split's segments come in order."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("block"))


def _walk(batches: Iterator[pa.RecordBatch], names: list[str], rows: int = 256) -> Iterator[tuple]:
    """(key, place, *values) of each segment: its split, and its offset from the split's first one."""
    key, at = None, 0
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            for file, split, block, *more in zip(*(part.column(n).to_pylist() for n in ["file", "split", "block", *names])):
                if (file, split) != key:
                    key, at = (file, split), 0
                yield key, at, block, *more
                at += len(block) + len(MAGIC)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Record-to-successor offsets, (file, split, place, exit, size), place and exit counted from the split's start.

    Each segment that begins with a header is the candidate of a record. A task follows the pointers within its split:
    exit is the first offset beyond it on the chain from that candidate, null if the chain ends at no candidate.
    size is the length of the split's segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, ahead, size):
            exits = {}
            for place in sorted(ahead, reverse=True):
                to = ahead[place]
                exits[place] = to if to is None or to >= size else exits.get(to)
            n = len(exits)
            arrays = [pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array(list(exits), pa.int64()), pa.array(list(exits.values()), pa.int64()), pa.array([size] * n, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["file", "split", "place", "exit", "size"])

        now, ahead, size = None, {}, 0
        for key, place, block in _walk(batches, []):
            if key != now:
                if now is not None:
                    yield out(now, ahead, size)
                now, ahead = key, {}
            parsed = _parse(block)
            if parsed or not ahead:  # a split's first segment stays, to carry its size
                ahead[place] = place + len(MAGIC) + parsed[0] + parsed[1] + 4 if parsed else None
            size = place + len(block) + len(MAGIC)
        if now is not None:
            yield out(now, ahead, size)

    return _segments(spark, path).mapInArrow(run, "file string, split long, place long, exit long, size long")


def reachable(chain: DataFrame) -> DataFrame:
    """chain (file, at, to) -> (file, at) of what is reached from the smallest `at` of each file that has a pointer.

    Pointer jumping: in each round every pointer leaps over twice as many candidates and the reached set doubles, so
    the rounds are logarithmic. A pointer to no candidate, as at a file's end, ends its chain.
    """
    jump = save(chain.where("to is not null").select("file", "at", "to"), "jumps")
    reached = save(jump.groupBy("file").agg(F.min("at").alias("at")), "reached")
    while True:
        more = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(chain.where("to is not null").select("file", "at"), ["file", "at"], "left_semi")
        more = save(more, "reached")
        if not more.head(1):
            return reached
        reached = save(reached.unionByName(more).distinct(), "reached")
        over = jump.select("file", F.col("at").alias("to"), F.col("to").alias("over"))
        jump = save(jump.join(over, ["file", "to"]).select("file", "at", F.col("over").alias("to")), "jumps")


def read_warc(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """The records of the archives below path: record_type, record_id, refers_to_id, url, payload_bytes,
    payload_digest, verified, and the block as binary in content.

    A task knows only its own split; chains of successor offsets from each file's start tell where the first true
    record of each split lies, so a magic inside a payload starts no record and the pieces it cuts are put together
    again. Versions 1.0 and 1.1 are read; archives whose names end in .gz are decompressed, record by record or as a whole, in
    one task each. A response's payload is measured; for a revisit, which holds none, the HTTP header and the record state
    the length and digest of the payload it refers to. verified: the stated length and digest are right (null for
    revisits). Empty archives give no rows, an archive without any reachable record is an error; what follows a break in a
    file's chain is not reachable.
    """
    found = save(candidates(spark, path), "candidates")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = found.groupBy("file", "split").agg(F.max("size").alias("size"))
    bases = save(splits.select("file", "split", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")), "splits")
    chain = save(found.drop("size").join(small(bases), ["file", "split"]).select("file", "split", "base", "place", "size", (F.col("base") + F.col("place")).alias("at"), (F.col("base") + F.col("exit")).alias("to")), "chain")
    entries = save(chain.join(reachable(chain), ["file", "at"]).select("file", "split", "place", (F.col("to") > F.col("base") + F.col("size")).alias("crosses")), "entries")
    if (bad := bases.join(entries.select("file").distinct(), "file", "left_anti").select("file").head()) is not None:
        raise ValueError(f"{bad['file']} has no WARC record")
    known = save(bases.join(entries, ["file", "split"], "left").select("file", "split", "base", F.col("place").alias("entry")), "split-entries")
    segments = _segments(spark, path)
    if known.count() <= BROADCAST_ROWS:
        ready = segments.join(F.broadcast(known), ["file", "split"])
    else:
        ready = segments.withColumn("n", F.monotonically_increasing_id()).join(known, ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "n").drop("n")
    if not entries.where("crosses").head(1):
        return ready.mapInArrow(_records(with_content), RECORD)
    # a record that goes on in the next split: its pieces, few, meet by file
    pieces = save(ready.mapInArrow(_records(True, pieces=True), "file string, at long, starts boolean, block binary, whole boolean"), "pieces")
    owner = F.last(F.when(F.col("starts"), F.col("at")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    joined = pieces.where("not whole").withColumn("owner", owner).where("owner is not null").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "block"))).alias("p"))
    blocks = pieces.where("whole").select("block").union(joined.select(F.aggregate("p.block", F.lit(b""), lambda a, b: F.concat(a, b))))
    return blocks.mapInArrow(_records(with_content, whole=True), RECORD)


RECORD = "record_type string, record_id string, refers_to_id string, url string, payload_bytes long, payload_digest string, verified boolean, content binary"


def _record(block: bytes, with_content: bool) -> tuple | None:
    """A row of RECORD from what follows a record's magic; what lies behind its stated length is left out."""
    parsed = _parse(block)
    if parsed is None:
        return None
    start, length, fields = parsed
    text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    content = block[start : start + length]
    kind, digest, verified = text(b"warc-type"), (text(b"warc-payload-digest") or "").removeprefix("sha1:") or None, None
    head, _, payload = content.partition(b"\r\n\r\n") if text(b"content-type") != "text/plain" else (b"", b"", content)
    stated = next((line.partition(b":")[2].strip() for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")), b"")
    size = int(stated) if stated.isdigit() else None
    if kind == "response":
        real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        verified = real == (digest or real) and size in (None, len(payload)) and len(content) == length
        digest, size = real, len(payload)
    return kind, text(b"warc-record-id"), text(b"warc-refers-to"), text(b"warc-target-uri"), size, digest, verified, content if with_content else None


def _records(with_content: bool, pieces: bool = False, whole: bool = False):
    """The task that turns segments into records; with `pieces` into rows (file, at, starts, block, whole) instead."""
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("starts", pa.bool_()), ("block", pa.binary()), ("whole", pa.bool_())]) if pieces else RECORD_ARROW

    def blocks(batches):
        """(file, at, starts, block, whole) of true records, and of segments that belong to one of an earlier split."""
        now, entry, base, start, held = None, None, 0, None, []
        for key, place, block, first, begin in _walk(batches, ["entry", "base"]):
            if key != now:
                if held:
                    yield now[0], base + start, True, b"".join(held), False
                now, entry, base, start, held = key, first, begin, None, []
                goal = None
            if entry is not None and place == (entry if goal is None else goal):
                parsed = _parse(block)
                start, held = place, [block]
                goal = place + len(MAGIC) + parsed[0] + parsed[1] + 4 if parsed else -1
            elif held:
                held += [MAGIC.encode(), block]
            elif place or block:
                yield key[0], base + place, False, MAGIC.encode() + block, False
            if held and place + len(block) + len(MAGIC) == goal:
                yield key[0], base + start, True, b"".join(held), True
                held = []
        if held:
            yield now[0], base + start, True, b"".join(held), False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if whole:
            each = ((None, None, True, x, True) for b in batches for x in b.column(0).to_pylist())
        else:
            each = blocks(batches)
        while part := list(islice(each, 256)):
            rows = part if pieces else [r for x in part if x[2] and (r := _record(x[3], with_content)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


RECORD_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "refers_to_id", "url")] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()), ("content", pa.binary())]
)


def page_of(record: Column) -> Column:
    """The id that record_id() wrote, as a long; null for a null id."""
    return F.regexp_extract(record, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def archived(pages: DataFrame, path: str | None = None, least_bytes: int = 0, with_content: bool = False, **columns) -> DataFrame:
    """Write pages below path (a new place in the shared folder if none is given), read them back: page_id,
    payload_bytes, payload_digest, record_type, refers_to, verified, url, content."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(pages, path, least_bytes=least_bytes, **columns)
    return read_warc(spark, path, with_content).select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to_id")).alias("refers_to"), "verified", "url", "content"
    )
