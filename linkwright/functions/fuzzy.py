"""Fuzzy string similarity. Values are trimmed and lower-cased; lengths are in characters; two empty values score 0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table is a Python integer, one bit per character of a."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _indel(a: str, b: str) -> float:
    return 1.0 if a == b else 2.0 * lcs_length(a, b) / (len(a) + len(b))


def _clean(x: str | None) -> str:
    return (x or "").strip().lower()


def ratio(a: str | None, b: str | None) -> float:
    """Twice the longest common subsequence over both lengths."""
    a, b = _clean(a), _clean(b)
    return _indel(a, b) if a and b else 0.0


def partial_ratio(a: str | None, b: str | None) -> float:
    """The best ratio of the shorter value with a window of its length in the longer one."""
    short, long_ = sorted((_clean(a), _clean(b)), key=len)
    if not short:
        return 0.0
    if short in long_:
        return 1.0
    n = len(short)
    return max(_indel(short, long_[k : k + n]) for k in range(len(long_) - n + 1))


def token_sort_ratio(a: str | None, b: str | None) -> float:
    """The ratio after sorting each value's words."""
    a, b = (" ".join(sorted(_clean(x).split())) for x in (a, b))
    return _indel(a, b) if a and b else 0.0


def wratio(a: str | None, b: str | None) -> float:
    """The best of the three."""
    best = ratio(a, b)
    for other in (token_sort_ratio, partial_ratio):
        if best < 1.0:
            best = max(best, other(a, b))
    return best


SCORERS = {"ratio": ratio, "partial_ratio": partial_ratio, "token_sort": token_sort_ratio, "token_sort_ratio": token_sort_ratio, "wratio": wratio}


def _vectorized(name: str):
    scorer = SCORERS[name]

    @arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        # each different pair of a batch is scored once, and only its values become Python strings
        a, b = (pc.fill_null(x, "").dictionary_encode() for x in (a, b))
        code = a.indices.to_numpy().astype(np.int64) * max(1, len(b.dictionary)) + b.indices.to_numpy()
        pairs, back = np.unique(code, return_inverse=True)
        left, right = a.dictionary.to_pylist(), b.dictionary.to_pylist()
        scores = [scorer(left[p // len(right)], right[p % len(right)]) for p in pairs.tolist()]
        return pa.array(np.array(scores, dtype=float)[back])

    return run


_UDFS: dict = {}


def fuzzy(name: str, a: Column, b: Column) -> Column:
    """The similarity of two string columns, computed in Arrow batches; equal and empty values never leave the JVM."""
    if name not in SCORERS:
        raise ValueError(f"unknown fuzzy scorer {name!r}")
    if name not in _UDFS:
        _UDFS[name] = _vectorized(name)
    a, b = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(_UDFS[name](a, b))
