import sys
import time
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkwright.functions import fuzzy as fz
from linkwright.functions import scalar
from linkwright.functions.acronyms import acronyms, synonym_score
from linkwright.functions.encoder import EncoderRefusal, Remote, hashed_ngrams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("a, b, want", [("Foo", "foo", 1.0), (" Bar ", "bar", 1.0), ("", "", 0.0), ("Café", "café", 1.0), ("abc", "def", 0.0), (None, "a", 0.0), (None, None, 0.0)])
def test_exact(spark, a, b, want):
    assert one(spark, scalar.exact(F.lit(a).cast("string"), F.lit(b).cast("string"))) == want


@pytest.mark.parametrize("a, b, want", [("42", "42", 1.0), ("42", "43", 0.0), ("foo", "bar", 0.0), ("", "", 0.0), (" 1e3", "1000.0 ", 1.0), ("0.1", "0.1000000001", 1.0), (None, "1", 0.0)])
def test_numeric(spark, a, b, want):
    assert one(spark, scalar.numeric(F.lit(a).cast("string"), F.lit(b).cast("string"))) == want


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


@given(st.text(alphabet="abcé ", max_size=12), st.text(alphabet="abcé ", max_size=12))
def test_fuzzy_properties(a, b):
    assert fz.lcs_length(a, b) == plain_lcs(a, b)
    assert fz.ratio(a, b) == fz.ratio(b, a)
    for f in (fz.ratio, fz.partial_ratio, fz.token_sort_ratio):
        assert 0 <= f(a, b) <= fz.wratio(a, b) <= 1


def test_fuzzy_values():
    assert fz.ratio("Hello", "hello") == 1 and fz.ratio("", "") == 0 and abs(fz.ratio("kitten", "sitting") - 0.6154) < 1e-4
    assert fz.token_sort_ratio("John  Smith", "Smith John") == 1
    assert fz.partial_ratio("bar", "foobar") == 1 and fz.partial_ratio("abc", "xyz") < 0.5 and fz.partial_ratio("", "a") == 0
    assert fz.wratio("unrelated", "zzzz") < 0.5


def test_fuzzy_column(spark):
    rows = [("kitten", "sitting"), (None, "x"), ("A", "a "), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    for name, f in fz.SCORERS.items():
        got = [r[0] for r in df.select(fz.fuzzy(name, F.col("a"), F.col("b"))).collect()]
        assert got == [f(a, b) for a, b in rows]
    with pytest.raises(ValueError):
        fz.fuzzy("soundex", F.col("a"), F.col("b"))


def test_acronyms(spark):
    short = lambda n, least=3: one(spark, acronyms(F.lit(n), least))
    assert short("Taylor, Reeves and Mcdaniel SRL") == ["TRAM", "TRAMS", "TRM", "TRMS"]
    assert short("Harris, Watkins and Goodwin BV") == ["HWAG", "HWAGB", "HWG", "HWGB"]
    assert short("KPMG") == [] and short("Acme Ltd") == [] and short("Gibson-Edwards & Co", 2) == ["GE", "GE&", "GE&C", "GEC"] and short("") == []
    assert one(spark, synonym_score(F.lit("hwg"), F.lit("Harris, Watkins and Goodwin BV"))) == 1
    assert one(spark, synonym_score(F.lit("IBM"), F.lit("ibm"), F.lit(1), F.lit(1))) == 0
    assert one(spark, synonym_score(F.lit("IBM"), F.lit("Big Blue"), F.lit(1), F.lit(1))) == 1


@pytest.mark.parametrize("raw, own, want", [(2.5, 5.0, 0.5), (1.0, 0.0, 0.0), (6.0, 5.0, 1.0), (-1.0, 5.0, 0.0)])
def test_bm25_normalised(spark, raw, own, want):
    assert one(spark, scalar.bm25_normalised(F.lit(raw), F.lit(own))) == want


def test_vectors(spark):
    v, w = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert abs(one(spark, scalar.cosine(v, w)) - 0.96) < 1e-12
    assert one(spark, scalar.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, scalar.dot(v, F.array(F.lit(1.0)))) == 0
    c = scalar.combined([(v, 0.3), (w, 0.2)])
    assert abs(one(spark, scalar.dot(c, c)) - 0.5) < 1e-12 and abs(one(spark, scalar.decomposed(c, c, 2, 2, 0.2)) - 1) < 1e-12


def test_tokens_and_joined(spark):
    assert one(spark, scalar.tokens(F.lit("Ünï-code, 42x! 東京"))) == ["ünï", "code", "42x", "東京"]
    assert one(spark, scalar.joined(F.lit(" a "), F.lit(None).cast("string"), F.lit(""), F.lit("b"))) == "a b"


STUB = r"""
import json, struct, sys, time
out = sys.stdout.buffer
def say(x, trailer=b""):
    out.write(json.dumps(x).encode() + b"\n" + trailer); out.flush()
if "mute" in sys.argv: time.sleep(60)
say({"type": "handshake", "protocol_version": 2 if "new" in sys.argv else 1, "vector_dim": 2, "model_id": "stub"})
for line in sys.stdin:
    t = json.loads(line)["texts"]
    if "refuse" in t: say({"type": "encode_response", "error": "over quota"}); continue
    if "hang" in t: time.sleep(60)
    good = [x for x in t if x]
    data = b"".join(struct.pack("<2f", len(x), 1) for x in good)
    say({"type": "encode_response", "results": [{"ok": True} if x else {"error": "empty"} for x in t], "vector_count": len(good), "vector_dim": 2}, struct.pack("<I", len(data)) + data if good else b"")
    if "die" in t: break
"""


def test_remote_encoder():
    r = Remote([sys.executable, "-c", STUB], timeout=5)
    assert r.encode(["abc", "", "x"]) == [[3.0, 1.0], None, [1.0, 1.0]] and r.encode([""]) == [None]
    assert r.encode(["die"]) == [[3.0, 1.0]]
    assert r.encode(["ab"]) == [[2.0, 1.0]] and (r.dim, r.model) == (2, "stub")
    with pytest.raises(EncoderRefusal, match="quota"):
        r.encode(["refuse"])
    r.close()


@pytest.mark.parametrize("flag, texts, error", [("mute", ["a"], TimeoutError), ("new", ["a"], ValueError), ("", ["hang"], TimeoutError)])
def test_remote_encoder_gives_up(flag, texts, error):
    began = time.monotonic()
    r = Remote([sys.executable, "-c", STUB, flag], retries=1, timeout=0.5, greeting=2)
    with pytest.raises(error):
        r.encode(texts)
    assert time.monotonic() - began < 20 and r.process is None


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:016x}"


def test_hashes(spark):
    for t in ("", "a", "Müller & Söhne", "x" * 300):
        assert one(spark, scalar.fnv1a(F.encode(F.lit(t), "utf-8"))) == fnv(t.encode())
        assert one(spark, scalar.fnv1a_8(F.lit(t))) == fnv(t.encode())[8:]
    assert one(spark, scalar.text_hash(F.lit(" ab "), F.lit(None).cast("string"))) == fnv(b"ab\xff\xff") != one(spark, scalar.text_hash(F.lit("a"), F.lit("b")))


def test_hashed_ngrams():
    assert hashed_ngrams("") == [0.0] * 64 and hashed_ngrams("Foo bar") == hashed_ngrams(" foo  BAR ")
