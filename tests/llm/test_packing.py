import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from linkwright.llm.packing import Rounds, pack, pieces_of, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")
DEFINITION = open(PATH, encoding="utf-8").read()
SCHEMA = "doc_id long, source string, text string, start long, ids int"


def rounds_by_hand(order):
    """The queues served one round after another."""
    left, served, deficit, out, at = list(order.totals), [0] * len(order.totals), [0] * len(order.totals), {}, 0
    while any(left):
        for s in range(len(left)):
            deficit[s] += int(order.quantum[s])
            while left[s] and deficit[s] >= order.slice * (1 << 16):
                k = min(order.slice, left[s])
                out[s, served[s]] = at
                at, served[s], left[s], deficit[s] = at + k, served[s] + 1, left[s] - k, deficit[s] - order.slice * (1 << 16)
    return out


def test_closed_form_is_the_round_robin():
    for totals, shares in ([1000, 10, 333, 1], None), ([500, 500], [0.9, 0.1]), ([7], None):
        order = Rounds(totals, shares, 64, 8)
        for (s, j), at in rounds_by_hand(order).items():
            assert order.place(np.array([s]), np.array([j]))[0] == at


def test_large_totals_and_a_zero_share():
    order = Rounds([50_000_000, 10**9], [0.0, 1.0], 2048, 256)
    last = [-(-t // 256) - 1 for t in (50_000_000, 10**9)]
    at = order.place(np.array([1, 1, 0, 0]), np.array([0, last[1], 0, last[0]]))
    # the source without a share is served a slice now and then, the other without a break before its end
    assert at[0] == 0 and 10**9 - 256 <= at[1] < 10**9 + 50_000_000 and (np.diff(at) > 0).sum() >= 2
    assert sorted({*at}) == [*sorted(at)] and at[3] == 50_000_000 + 10**9 - (50_000_000 - last[0] * 256)
    many = Rounds([1000] * 3000, None, 2048, 256)
    s, j = np.repeat(np.arange(3000), 4), np.tile(np.arange(4), 3000)
    assert np.unique(many.place(s, j)).size == 12000


def test_shares_hold_in_each_window(spark):
    order, window = Rounds([60_000, 60_000, 60_000], [0.5, 0.25, 0.25], 2048, 64), 2048
    j = np.arange(60_000 // 64)
    place = order.place(np.repeat([0, 1, 2], len(j)), np.tile(j, 3))
    kind = np.repeat([0, 1, 2], len(j))
    for w in range(50):  # until the first queue is dry
        here = kind[(place >= w * window) & (place < (w + 1) * window)]
        assert abs((here == 0).sum() * 64 - window / 2) <= 3 * 64


def test_pieces_cover():
    order = Rounds([100, 50], None, 32, 8)
    doc, begin, length, seq, off = pieces_of(order, 32, np.array([0, 0, 1]), np.array([0, 30, 0]), np.array([30, 70, 50]))
    seen = sorted(x for d, b, n, q, o in zip(doc, begin, length, seq, off) for x in range(q * 32 + o, q * 32 + o + n))
    assert seen == list(range(150))
    assert Counter({0: 30, 1: 70, 2: 50}) == sum((Counter({int(d): int(n)}) for d, n in zip(doc, length)), Counter())


def test_round_trip(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, " ".join(f"word{i}x{k}" for k in range(i * 3)) if i % 5 else None, 1, 2) for i in range(60)]
    rows += [rows[9], rows[9], (None, "s0", "no id here", 1, 2), (99, "s1", "long " * 5000, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = pack(docs, DEFINITION, window=128, slice_tokens=16)
    got = made.collect()
    tok = Tokenizer.from_file(PATH)
    want = Counter((r[0], tuple(tok.encode(r[2] or "", add_special_tokens=False).ids + [1])) for r in rows)
    by_doc, windows = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and len(r["ids"]) == r["length"]
        by_doc[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    copies = Counter(r[0] for r in rows)
    for (d, ids), n in want.items():
        pieces = sorted((r["start"], tuple(r["ids"])) for r in by_doc[d])
        counted = Counter(pieces)
        assert sum(len(p) for _, p in pieces) == len(ids) * copies[d]
        for (start, piece), _ in counted.items():
            assert ids[start : start + len(piece)] == piece
    for k, spans in windows.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at == 128 or k == max(windows)
    assert sum(len(r["ids"]) for r in sequences(made).collect()) == sum(len(i) * n for (_, i), n in want.items())


def test_empty(spark):
    assert pack(spark.createDataFrame([], SCHEMA), DEFINITION).count() == 0
