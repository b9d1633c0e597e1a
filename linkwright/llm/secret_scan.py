"""Secret scans: fixed patterns, and strings that stay incompressible next to the code around them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 256
#: The kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "novel")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: With the least lengths, which for these two do not change what is found.
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}")
#: Where a secret may follow, and what one may look like.
SENSITIVE = re.compile("|".join(map(_either, ("passw", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "credential", "bearer", "private", "authorization", "access"))))
SHORTEST = 12
STRING = re.compile(r"[A-Za-z0-9+/_.=~!@#$%%^&*-]{%d,}" % SHORTEST)
#: Identifiers and code that are no news next to a candidate.
IDENTIFIERS = (
    "password passwd passphrase secret client_secret token access_token refresh_token api_key apikey private_key public_key credential credentials "
    "authorization bearer session cookie username user_name host hostname localhost example.com port database connection config settings "
    "getenv environ import from return function const let var class def self this null none true false undefined string integer boolean "
    "process.env os.environ System.getProperty changeme placeholder your_password_here your-api-key xxxxxxxxxxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ http:// https:// .json .yaml .properties application/json Content-Type"
)


class Scanner:
    """Finds spans (kind, start, end) in code points, end exclusive.

    Base kinds are patterns, leftmost and without overlaps each. A novel span is a string that starts within `reach`
    characters after a sensitive word, has two kinds of characters at least (digits, small letters, capitals other than
    the first letter), and adds more than `ratio` compressed bytes per character: a raw-content dictionary of identifiers
    primes the compressor, which also sees the `around` characters on either side, so that whatever the surroundings
    repeat costs next to nothing. Every such string is measured, those that a pattern has found too: a placeholder that
    only looks like an assignment is a base span, but no novel one. Novel spans do not overlap each other; each string
    is compressed once, so a scan is linear in the text.
    """

    def __init__(self, reach: int = 48, around: int = 256, ratio: float = 0.72, level: int = 9):
        self.reach, self.around, self.ratio = reach, around, ratio
        dictionary = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def marginal(self, text: str, start: int, end: int) -> int:
        """Compressed bytes that the candidate adds to what surrounds it."""
        context = (text[max(0, start - self.around) : start] + "\n" + text[end : end + self.around]).encode("utf-8", "surrogatepass")
        size = lambda x: len(self.compressor.compress(x))
        return size(context + b"\n" + text[start:end].encode()) - size(context + b"\n")

    def novel(self, text: str) -> list[tuple[int, int, int]]:
        found, done = [], 0
        for word in SENSITIVE.finditer(text):
            last = min(len(text), word.end() + self.reach)
            while (first := max(done, word.end())) <= last and (m := STRING.search(text, first, last + SHORTEST)) and m.start() <= last:
                m = STRING.match(text, m.start())  # the whole run, past the window too
                done = m.end()
                if kinds(m[0]) >= 2 and self.marginal(text, *m.span()) >= self.ratio * len(m[0]):
                    found.append((m.start(), 3, m.end()))
        return found

    def scan(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base spans, all spans), each sorted by start and kind; null counts as empty."""
        text = text or ""
        base = self.base(text)
        return base, sorted(base + self.novel(text))


def kinds(string: str) -> int:
    """How many kinds of characters it has; a capital that only begins a word counts as small."""
    rest = string[1:] if string[:1].isupper() else string
    return sum(any(test(c) for c in rest) for test in (str.isdigit, str.islower, str.isupper))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_secrets: bool = True) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans, and the secrets found.

    Whole texts are read, one by one; null ones have no spans. Repeated rows get equal rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = []
                for t in part.column("text"):
                    text = t.as_py() or ""
                    base, every = scanner.scan(text)
                    counts = [sum(k == n for _, k, _ in every) for n in range(4)]
                    rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), [text[s:e] for s, _, e in every]))
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.string())] * with_secrets
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", *NAMES[: len(arrays)]])

    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string" + ", secrets array<string>" * with_secrets)


NAMES = ["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "secrets"]
