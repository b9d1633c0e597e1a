"""Scalar scores as column expressions: exact, numeric, vectors, BM25 terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the BM25 formula.
K1, B = 1.2, 0.75
#: Decimal literals that every engine reads alike.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def text(c: Column) -> Column:
    """A field's value: trimmed, null as empty."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def key(c: Column) -> Column:
    """A blocking or prefilter key: trimmed and lower-cased."""
    return F.lower(text(c))


def exact(a: Column, b: Column) -> Column:
    """1 if equal but for case and outer spaces, and not empty."""
    return ((key(a) == key(b)) & (key(a) != "")).cast("double")


def numeric(a: Column, b: Column) -> Column:
    """1 if both are numbers that are equal within 1e-9, relative to the larger one if that exceeds 1."""
    x, y = (F.when(text(c).rlike(NUMBER), text(c).try_cast("double")) for c in (a, b))
    near = F.abs(x - y) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
    return F.coalesce(near, F.lit(False)).cast("double")


def dot(a: Column, b: Column) -> Column:
    """The inner product; 0 if lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v at length one; the zero vector as it is."""

    def over(length: Column) -> Column:
        return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))

    return F.get(F.transform(F.array(norm(v)), over), F.lit(0))  # the length is computed once, not for each element


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors clamped to [0, 1]."""
    return clamp(dot(unit(a), unit(b)))


def combined(fields: list[tuple[Column, float]]) -> Column:
    """One vector for several fields: each at unit length times the root of its weight, so that the dot product of two
    such vectors is the weighted sum of the fields' cosines."""

    def part(v: Column, weight: float) -> Column:
        return F.transform(unit(v), lambda x: x * F.sqrt(F.lit(float(weight))))

    return F.flatten(F.array(*[part(v, w) for v, w in fields]))


def decomposed(a: Column, b: Column, start: int, length: int, weight: float) -> Column:
    """A field's cosine from two combined vectors: the dot product of its part over its weight, clamped."""
    return clamp(dot(F.slice(a, start + 1, length), F.slice(b, start + 1, length)) / F.lit(float(weight)))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def joined(*fields: Column) -> Column:
    """Several fields as one text: trimmed, without empty ones, a space between."""
    return F.array_join(F.filter(F.array(*[text(f) for f in fields]), lambda t: t != ""), " ")


def idf(docs: Column, with_term: Column) -> Column:
    return F.log((docs - with_term + 0.5) / (with_term + 0.5) + 1)


def bm25_term(tf: Column, idf_: Column, length: Column, average: Column) -> Column:
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25_normalised(raw: Column, own: Column) -> Column:
    """A raw score over the query's score with itself, in single precision, clamped; 0 if the latter is not positive."""
    return F.when(own > 0, clamp(raw.cast("float").cast("double") / own.cast("float").cast("double"))).otherwise(F.lit(0.0))


def classify(score: Column, auto: float, floor: float) -> Column:
    return F.when(score >= auto, F.lit("auto")).when(score >= floor, F.lit("review")).otherwise(F.lit("no_match"))


def fnv1a(data: Column) -> Column:
    """The 64-bit FNV-1a hash of a binary column, as 16 hexadecimal digits.

    The prime is 2 ** 40 + 435, so a step on the two halves of 32 bits needs no product beyond 64 bits.
    """
    low = F.lit(0xFFFFFFFF)
    # fixed value: the hash of nothing
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(h: Column, byte: Column) -> Column:
        lo = h["lo"].bitwiseXOR(F.conv(byte, 16, 10).cast("long"))
        product = lo * 435
        hi = h["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(lo, 8)
        return F.struct(hi.bitwiseAND(low).alias("hi"), product.bitwiseAND(low).alias("lo"))

    out = F.aggregate(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)), start, step)
    half = lambda n: F.lower(F.lpad(F.hex(out[n]), 8, "0"))
    return F.concat(half("hi"), half("lo"))


def fnv1a_8(c: Column) -> Column:
    """The last eight hexadecimal digits of the hash of a string."""
    return F.substring(fnv1a(F.encode(F.coalesce(c, F.lit("")), "utf-8")), 9, 8)


def text_hash(*fields: Column) -> Column:
    """The hash of the trimmed texts that an encoding depends on, each followed by a byte that no UTF-8 text has."""
    return fnv1a(F.concat(*[x for f in fields for x in (F.encode(text(f), "utf-8"), F.lit(b"\xff"))]))
