import base64
import gzip
import hashlib

import pytest

from linkwright.llm.warc import archived, read_warc, write_warc

KIND = "page_id long, url string, html string, record_type int"


def by_hand(rows, least=0):
    first = {}
    for i, _, h, _ in rows:
        first.setdefault(h or "", []).append(i)
    out = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        ids = first[h or ""]
        low = min((x for x in ids if x is not None), default=None)
        plain = len(raw) < least or i == low
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if plain else "revisit", None if plain else low))
    return sorted(out, key=str)


def taken(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def rows():
    made = [(i, f"http://h{i}.org/", f"<p>{i}</p>é\r\n\n" * (i % 40), 0) for i in range(300)]
    made += [(1000 + i, None, f"<p>{i % 7}</p>same", 0) for i in range(50)]
    made += [(2000, "u\r\nWARC-Type: x", None, 0), (2001, "u", "", 0), (2002, "u", FAKE, 0), (2003, "u", "x" + FAKE * 3 + "WARC/1.1\r\n", 0), (2004, "u", "WARC/1.1\r\n", 0), (2005, "v", FAKE, 0)]
    return made


def test_round_trip(spark):
    pages = spark.createDataFrame(rows(), KIND).repartition(3)
    for least in (0, 30):
        got = archived(pages, least_bytes=least)
        assert taken(got) == by_hand(rows(), least)
        assert {r["verified"] for r in got.where("record_type = 'response'").collect()} == {True}


def test_small_splits(spark, tmp_path):
    """Splits of a few hundred bytes: payloads with a magic inside cross them."""
    few = rows()[1:12] + rows()[-6:]
    write_warc(spark.createDataFrame(few, KIND).coalesce(1), str(tmp_path / "w"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for size in ("400",):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = read_warc(spark, str(tmp_path / "w"))
            text = {int(r["record_id"][10:-1]): r["content"].split(b"\r\n\r\n", 1)[1].decode() for r in got.where("record_type = 'response'").collect()}
            assert got.count() == len(few)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
            spark.conf.set("spark.sql.files.openCostInBytes", old[1])
        want = {i: h or "" for i, _, h, _ in few}
        assert all(want[i] == t for i, t in text.items()) and {2002, 2003, 2004} <= set(text)


def test_other_archives(spark, tmp_path):
    """Version 1.0, records compressed one by one, other record types, lower-case names, and what is no archive."""
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    record = lambda kind, id, block: b"WARC/1.0\r\nwarc-type: " + kind + b"\r\nWARC-Record-ID: <urn:x:" + id + b">\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    records = [record(b"warcinfo", b"0", b"software: x WARC/1.0\r\n"), record(b"response", b"1", body), record(b"response", b"2", body.replace(b"5", b"9999").replace(b"hello", b"WARC/1.1\r\n" * 1111))]
    plain, packed = tmp_path / "plain", tmp_path / "packed"
    plain.mkdir()
    packed.mkdir()
    (plain / "a.warc").write_bytes(b"".join(records))
    (packed / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    for folder in (plain, packed):
        got = {r["record_id"]: r for r in read_warc(spark, str(folder)).collect()}
        assert set(got) == {"<urn:x:0>", "<urn:x:1>", "<urn:x:2>"} and got["<urn:x:1>"]["payload_bytes"] == 5 and got["<urn:x:0>"]["record_type"] == "warcinfo"
        assert got["<urn:x:1>"]["verified"] and not got["<urn:x:2>"]["verified"] and got["<urn:x:2>"]["payload_bytes"] == 11110
    (plain / "b.warc").write_bytes(b"no archive at all")
    with pytest.raises(ValueError, match="no WARC record"):
        read_warc(spark, str(plain))


def test_long_payload(spark):
    pages = spark.createDataFrame([(1, "u", "WARC/1.1\r\n" * 300_000, 0), (2, "u" * 5000, "<p>" * 500_000, 0)], KIND)
    assert taken(archived(pages)) == by_hand([tuple(r) for r in pages.collect()])


def test_repeated_rows_and_null_ids(spark):
    got = archived(spark.createDataFrame([(1, "u", "a", 0), (1, "u", "a", 0), (None, "u", "a", 0), (None, None, "b", 0)], KIND)).collect()
    again = archived(spark.createDataFrame([(7, "v", "same", 0)] * 40 + [(7, "u", "same", 0), (9, "u", "same", 0)], KIND)).collect()
    assert sorted((r["page_id"], r["record_type"], r["url"]) for r in again) == sorted([(7, "response", "u"), (9, "revisit", "u")] + [(7, "revisit", "v")] * 40)
    assert {r["payload_bytes"] for r in again} == {4}
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got) == [("1", "response", "None"), ("1", "revisit", "1"), ("None", "response", "None"), ("None", "revisit", "1")]


def test_empty(spark):
    assert archived(spark.createDataFrame([], KIND)).count() == 0
