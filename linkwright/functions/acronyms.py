"""Acronyms of names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that join the parts of a name, and abbreviations of legal forms.
CONNECTORS = ["and", "&", "of", "the", "und", "et", "de", "des", "du", "van", "von", "di", "la", "le", "les", "del", "della"]
LEGAL_SUFFIXES = [
    "llc", "ltd", "limited", "gmbh", "bv", "inc", "incorporated", "corp", "corporation", "ag", "sa", "srl",
    "nv", "plc", "llp", "lp", "co", "pty", "kg", "se", "ab", "oy", "as", "spa", "sarl", "sl", "kk", "bhd",
    "pvt", "pte", "hf", "ehf",
]


def name_words(name: Column) -> Column:
    """The words of a name: split at white space and hyphens, without punctuation other than the ampersand."""
    kept = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}&\s-]", "")
    return F.filter(F.split(kept, r"[\s-]+"), lambda w: w != "")


def acronyms(name: Column, least: int = 3) -> Column:
    """The initials of a name's words, sorted and without repeats: of its name words alone, with connectors, with legal
    suffixes, with both. Names of fewer than two name words have none, nor are those shorter than `least` letters kept."""
    words = name_words(name)
    within = lambda w, names: F.lower(w).isin(names)
    plain = F.filter(words, lambda w: ~within(w, CONNECTORS) & ~within(w, LEGAL_SUFFIXES))
    initials = lambda ws: F.array_join(F.transform(ws, lambda w: _upper(F.substring(w, 1, 1))), "")
    forms = F.array(
        initials(plain),
        initials(F.filter(words, lambda w: ~within(w, LEGAL_SUFFIXES))),
        initials(F.filter(words, lambda w: ~within(w, CONNECTORS))),
        initials(words),
    )
    found = F.array_sort(F.array_distinct(F.filter(forms, lambda a: F.octet_length(a) >= least)))
    return F.when(F.size(plain) >= 2, found).otherwise(F.array().cast("array<string>"))


def _upper(c: Column) -> Column:
    """Only a-z are raised."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def synonym_score(a: Column, b: Column, group_a: Column | None = None, group_b: Column | None = None, least: int = 3) -> Column:
    """1 if one value is an acronym of the other, or both are in one group of the dictionary and not the same text."""
    up_a, up_b = F.upper(F.trim(F.coalesce(a, F.lit("")))), F.upper(F.trim(F.coalesce(b, F.lit(""))))
    hit = F.array_contains(acronyms(a, least), up_b) | F.array_contains(acronyms(b, least), up_a)
    if group_a is not None and group_b is not None:
        hit = hit | F.coalesce((group_a == group_b) & (up_a != up_b), F.lit(False))
    return ((up_a != "") & (up_b != "") & hit).cast("double")
