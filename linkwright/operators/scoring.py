"""Field scores and the weighted composite."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions.acronyms import synonym_score
from linkwright.functions.fuzzy import fuzzy
from linkwright.functions.scalar import clamp, exact, key, numeric
from linkwright.operators.settle import settled


@dataclass(frozen=True)
class MatchField:
    """One compared pair of fields. Embedding and BM25 scores are looked up, as columns of the candidate pairs."""

    method: str
    weight: float
    field_a: str = ""
    field_b: str = ""
    scorer: str = "wratio"

    @property
    def names(self) -> tuple[str, str]:
        return ("bm25", "bm25") if self.method == "bm25" else (self.field_a, self.field_b)


def field_score(f: MatchField) -> Column:
    """A field's score on a row with columns a_<field>, b_<field> (and bm25, emb_<a>_<b>, group_<a>/_<b> where used)."""
    a, b = F.col(f"a_{f.field_a}"), F.col(f"b_{f.field_b}")
    if f.method == "bm25":
        score = F.coalesce("bm25", F.lit(0.0))
    elif f.method == "embedding":
        score = F.coalesce(f"emb_{f.field_a}_{f.field_b}", F.lit(0.0))
    elif f.method == "exact":
        score = exact(a, b)
    elif f.method == "fuzzy":
        score = fuzzy(f.scorer, a, b)
    elif f.method == "numeric":
        score = numeric(a, b)
    elif f.method == "synonym":
        score = synonym_score(a, b, F.col(f"group_a_{f.field_a}"), F.col(f"group_b_{f.field_b}"))
    else:
        raise ValueError(f"unknown match method {f.method!r}")
    return F.when(F.isnan(score), F.lit(0.0)).otherwise(score)


def composite(fields: Sequence[MatchField], scores: Sequence[Column]) -> Column:
    """The weighted sum of all but synonym scores, over their weights unless those add up to 1 within 0.001, plus the
    synonym scores times their weights as a bonus; clamped to [0, 1]."""
    base = [(f.weight, s) for f, s in zip(fields, scores) if f.method != "synonym"]
    total = sum(w for w, _ in base)
    value = sum((s * F.lit(float(w)) for w, s in base), F.lit(0.0))
    if total > 0 and abs(total - 1) > 0.001:
        value = value / F.lit(float(total))
    bonus = sum((s * F.lit(float(f.weight)) for f, s in zip(fields, scores) if f.method == "synonym"), F.lit(0.0))
    whole = value + bonus
    return clamp(F.when(F.isnan(whole), F.lit(0.0)).otherwise(whole))


#: Values of two fields whose pairs, if there are so few, are scored once, as a table that is small enough to be broadcast.
FEW_PAIRS = 200_000


def fuzzy_tables(a: DataFrame, b: DataFrame, fields: Sequence[MatchField], most: int = FEW_PAIRS, prefix: str = "") -> dict[MatchField, DataFrame]:
    """(x, y, value) of all different values of a fuzzy field's two sides (columns <prefix>a_<field>, <prefix>b_<field>), for
    those fields that have at most `most` pairs of them: what each batch would score anew is scored once."""
    out = {}
    for f in fields:
        if f.method == "fuzzy":
            xs, ys = (df.select(key(F.col(f"{prefix}{s}_{n}")).alias(c)).distinct() for df, s, n, c in ((a, "a", f.field_a, "x"), (b, "b", f.field_b, "y")))
            n, m = (df.limit(most + 1).count() for df in (xs, ys))
            if n * m <= most:
                out[f] = settled(xs.crossJoin(ys).repartition(xs.sparkSession.sparkContext.defaultParallelism).withColumn("value", fuzzy(f.scorer, F.col("x"), F.col("y"))))
    return out


def with_scores(pairs: DataFrame, fields: Sequence[MatchField], tables: dict[MatchField, DataFrame] | None = None) -> DataFrame:
    """pairs with the fields' scores as _score_0, _score_1, ... and the composite score. Scores of fuzzy fields that have a
    table of them are looked up."""
    names, scores = [f"_score_{k}" for k in range(len(fields))], {}
    for n, f in zip(names, fields):
        if tables and f in tables:
            t = tables[f].select(F.col("x").alias(f"{n}_x"), F.col("y").alias(f"{n}_y"), F.col("value").alias(f"{n}_v"))
            pairs = pairs.join(F.broadcast(t), (key(F.col(f"a_{f.field_a}")) == F.col(f"{n}_x")) & (key(F.col(f"b_{f.field_b}")) == F.col(f"{n}_y")), "left").drop(f"{n}_x", f"{n}_y")
            scores[n] = F.col(f"{n}_v")
        else:
            scores[n] = field_score(f)
    return pairs.withColumns(scores).drop(*[f"{n}_v" for n in names]).withColumn("score", composite(fields, [F.col(n) for n in names]))


def detail(fields: Sequence[MatchField]) -> Column:
    """field_scores, an array of (field_a, field_b, method, score, weight), from the columns of with_scores."""
    return F.array(*[F.struct(F.lit(f.names[0]).alias("field_a"), F.lit(f.names[1]).alias("field_b"), F.lit(f.method).alias("method"), F.col(f"_score_{k}").alias("score"), F.lit(float(f.weight)).alias("weight")) for k, f in enumerate(fields)])


def scored(pairs: DataFrame, fields: Sequence[MatchField], tables: dict[MatchField, DataFrame] | None = None) -> DataFrame:
    """pairs with score and field_scores, an array of (field_a, field_b, method, score, weight)."""
    each = with_scores(pairs, fields, tables)
    return each.withColumn("field_scores", detail(fields)).drop(*[f"_score_{k}" for k in range(len(fields))])
