"""Pairs that need no scoring: common identifiers and exact keys, one to one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions.scalar import key, text

EMPTY = "a_id string, b_id string"


def _one_to_one(a: DataFrame, b: DataFrame, a_key: Column, b_key: Column, mapped: DataFrame | None, reason: str) -> DataFrame:
    """Of each key the largest a_id of all, if it is free, and the smallest free b_id."""
    left = a.select(a_key.alias("key"), "a_id").where("key is not null").groupBy("key").agg(F.max("a_id").alias("a_id"))
    right = b.select(b_key.alias("key"), "b_id").where("key is not null")
    if mapped is not None:
        left = left.join(mapped.select("a_id"), "a_id", "left_anti")
        right = right.join(mapped.select("b_id"), "b_id", "left_anti")
    right = right.groupBy("key").agg(F.min("b_id").alias("b_id"))
    return left.join(right, "key").select("a_id", "b_id", F.lit(1.0).alias("score"), F.lit(reason).alias("reason"))


def common_id_match(a: DataFrame, b: DataFrame, a_field: str, b_field: str, mapped: DataFrame | None = None) -> DataFrame:
    """Pairs with the same identifier, trimmed and not empty; case counts."""
    filled = lambda c: F.when(text(F.col(c)) != "", text(F.col(c)))
    return _one_to_one(a, b, filled(a_field), filled(b_field), mapped, "canonical")


def exact_prefilter(a: DataFrame, b: DataFrame, fields: Sequence[tuple[str, str]], mapped: DataFrame | None = None) -> DataFrame:
    """Pairs that agree on all fields (a field, b field), none of them empty, ignoring case; blocks do not matter."""

    def whole(names: Sequence[str]) -> Column:
        parts = [key(F.col(n)) for n in names]
        filled = F.lit(True)
        for p in parts:
            filled = filled & (p != "")
        return F.when(filled, F.to_json(F.array(*parts)))

    return _one_to_one(a, b, whole([x for x, _ in fields]), whole([y for _, y in fields]), mapped, "exact")
