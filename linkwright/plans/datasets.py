"""A generated pair of datasets with known truth, for trials of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = "Alder Birch Cedar Dogwood Elm Fir Gorse Hazel Iris Juniper Kelp Larch Maple Nettle Oak Pine Quince Rowan Sorrel Thistle".split()
SECOND = "Bridge Canyon Delta Estuary Fjord Glacier Harbour Island Junction Knoll Lagoon Meadow".split()
FORM = ["Limited", "Incorporated", "GmbH", "Corporation", "Partners and Company"]
COUNTRIES = ["US", "GB", "DE", "FR", "NL", "CH", "JP", "SE"]


def _pick(words: list[str], seed: int, key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(len(words))) + 1).cast("int"))


def _noisy(name: Column, key: Column) -> Column:
    """One of six disturbances by a hash of the key: case, abbreviation, a word dropped, order, a letter lost, none."""
    kind = F.pmod(F.xxhash64(F.lit(50), key), F.lit(6))
    words = F.split(name, " ")
    return (
        F.when(kind == 0, F.upper(name))
        .when(kind == 1, F.regexp_replace(F.regexp_replace(name, "Incorporated", "Inc"), "Corporation", "Corp"))
        .when(kind == 2, F.array_join(F.slice(words, 1, 2), " "))
        .when(kind == 3, F.array_join(F.reverse(words), " "))
        .when(kind == 4, F.concat(F.substring(name, 1, 3), F.substring(name, 5, 200)))
        .otherwise(name)
    )


def generate(spark: SparkSession, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(reference, incoming): n rows each, the same for a seed on every run and at any parallelism.

    Of the incoming rows 70 % are a disturbed copy of a reference row (matched), 10 % share a name with one but nothing
    else (ambiguous), 20 % are of no row (unmatched); _true_a_id and _match_type tell which, and are never scored.
    """
    i = F.col("id")
    s = lambda k: F.struct(F.lit(seed + k), i)
    name = F.concat_ws(" ", _pick(FIRST, 1, s(0)), _pick(SECOND, 2, s(0)), F.format_string("%05d", i), _pick(FORM, 3, s(0)))
    lei = F.when(F.pmod(F.xxhash64(F.lit(4), s(0)), F.lit(100)) < 85, F.upper(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), i.cast("string"))), 1, 20))).otherwise("")
    base = spark.range(n).select(i, F.format_string("ENT-%06d", i + 1).alias("entity_id"), name.alias("legal_name"), _pick(COUNTRIES, 5, s(0)).alias("country_code"), lei.alias("lei"))
    a = base.withColumn("short_name", F.array_join(F.slice(F.split("legal_name", " "), 1, 2), " "))
    kind = F.when(i < n * 70 // 100, "matched").when(i < n * 80 // 100, "ambiguous").otherwise("unmatched")
    other = F.concat_ws(" ", F.lit("Unheard"), _pick(SECOND, 6, s(1)), F.format_string("%05d", i + 700_000), _pick(FORM, 7, s(1)))
    keeps = F.pmod(F.xxhash64(F.lit(8), s(0)), F.lit(100))
    b = base.select(
        F.format_string("CP-%06d", i + 1).alias("counterparty_id"),
        F.when(kind == "matched", _noisy(F.col("legal_name"), s(2))).when(kind == "ambiguous", F.col("legal_name")).otherwise(other).alias("counterparty_name"),
        F.when((kind == "matched") & (keeps >= 5), F.col("country_code")).otherwise(_pick(COUNTRIES, 9, s(3))).alias("domicile"),
        F.when((kind == "matched") & (keeps < 70), F.col("lei")).otherwise("").alias("lei_code"),
        F.when(kind == "unmatched", "").otherwise(F.col("entity_id")).alias("_true_a_id"),
        kind.alias("_match_type"),
    )
    return a.drop("id"), b
