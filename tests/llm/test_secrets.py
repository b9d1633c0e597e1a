import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from linkwright.llm.secret_scan import Scanner, listed, scan

SCANNER = Scanner()


def plain(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


PIECES = ["password", "PassWD", "secret", "token", "api_key", "ApiKey", "ſecret", "toKen", "=", ":", " ", '"', "'", "abc", "abcdef1", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "Q9", "é", "🙂", "\n", "-", "/"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base(text):
    assert SCANNER.base(text) == plain(text)


def test_novel():
    text = "let me set the access credential to\n  zX9fQ2mL7vRt4KpW8sYb and go on with the thing"
    base, every = SCANNER.scan(text)
    assert not base and [text[s:e] for s, _, e in every] == ["zX9fQ2mL7vRt4KpW8sYb"]
    for quiet in ("the credential is your_password_here_2 or credentials_config_1", "see build zX9fQ2mL7vRt4KpW8sYb", "token credential1234 credential1234 credential1234"):
        assert not SCANNER.scan(quiet)[1]
    repeated = "id qW8eR5tY2uI9oP1aS and credential qW8eR5tY2uI9oP1aS"
    assert not SCANNER.scan(repeated)[1]


def novel_by_hand(text):
    """Runs of string characters, character by character; the sensitive word nearest before each decides."""
    words = "passw passphrase secret token apikey api_key api-key credential bearer private authorization access".split()
    out, at, used = [], 0, set()
    low = text.lower() if text.isascii() else text
    ends = sorted({k + len(w) for w in words for k in range(len(text)) if low.startswith(w, k)})
    ends = [e for e in ends if not any(low.startswith(w, k) and k + len(w) == e for w in words for k in range(e) if any(low.startswith(v, j) and j < k < j + len(v) <= e for v in words for j in range(max(0, k - 12), k)))]
    for end in ends:
        at = max(at, end)
        while at <= min(end + 48, len(text)):
            stop = at
            while stop < len(text) and re.match(r"[A-Za-z0-9+/_.=~!@#$%^&*-]", text[stop]):
                stop += 1
            if stop - at >= 12:
                s = text[at:stop]
                rest = s[1:] if s[0].isupper() else s
                n = bool(re.search("[0-9]", rest)) + bool(re.search("[a-z]", rest)) + bool(re.search("[A-Z]", rest))
                if n >= 2 and SCANNER.marginal(text, at, stop) / len(s) >= 0.72:
                    out.append((at, 3, stop))
                at = stop
            else:
                at = max(at + 1, stop)
    return out


def test_novel_equals_plain_search():
    rng = random.Random(2)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    for _ in range(300):
        parts = [rng.choice(["the secret of", "client token", "a credential:", "some words here", "Bearer", "\n", "your_password_here", "x = 5", "".join(rng.choices(alphabet, k=rng.randrange(8, 40)))]) for _ in range(8)]
        text = rng.choice([" ", "", "  "]).join(parts)
        assert SCANNER.novel(text) == novel_by_hand(text)


def test_planted_secrets_are_found():
    """Random strings after sensitive words that no pattern fits, among prose, identifiers and capitalised words."""
    rng = random.Random(8)
    words = "the quick Brown foxes Understandably jumped over configuration getUserName lazyDogs Internationalisation of their neighbour".split()
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    found = wrong = 0
    for _ in range(200):
        secret = "".join(rng.choices(alphabet, k=24))
        before, after = (" ".join(rng.choices(words, k=12)) for _ in range(2))
        text = f"{before} {rng.choice(['Authorization Bearer', 'the credential is', 'private', 'access code'])} {secret} {after}"
        base, every = SCANNER.scan(text)
        spans = {text[s:e] for s, k, e in every if k == 3}
        found += secret in spans and not base
        wrong += len(spans - {secret})
    assert found >= 195 and wrong <= 4


def test_long_runs_take_linear_time():
    rng = random.Random(1)
    text = "".join("token" + "".join(rng.choices("abcdefghij", k=8)) for _ in range(40_000))
    began = time.time()
    spans = [s for s in SCANNER.scan(text)[1] if s[1] == 3]
    assert time.time() - began < 20 and all(a[2] <= b[0] for a, b in zip(spans, spans[1:]))
    one = SCANNER.novel("secret zX9fQ2mL7vRtoken4KpW8sYbQ1wE5")
    assert len(one) == 1


def test_patterns_are_measured_too():
    """An assignment of a placeholder is a base span only."""
    text = 'token = "e03422dad6b454724135a384f69ba12c7de6c8f4" and password = "changeme_placeholder"'
    base, every = SCANNER.scan(text)
    assert [k for _, k, _ in base] == [0, 2, 0] and [text[s:e] for s, k, e in every if k == 3] == ["e03422dad6b454724135a384f69ba12c7de6c8f4"]


def test_query(spark):
    texts = [None, "", "password=hunter2xyz", "x" * 50000 + " token: 'abcdef12' " + "0f" * 20, "é🙂 secret=abcdefg", "AKIA" + "A1" * 10]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(2, texts[2], "clash")]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert r["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest() and set(listed(want).split(",")) - {""} <= set(r["spans"].split(","))
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
