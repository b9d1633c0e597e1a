"""The best candidates of each query where whole blocks are candidates: by classes of equal values, without the pairs.

A pair's score depends on the compared values alone, so records of a block with the same values are one class, scored once.
The result is that of scoring every pair and keeping each query's best; what grows with the input is linear in it.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions.scalar import key
from linkwright.operators import scoring
from linkwright.operators.candidates import by_mask, union
from linkwright.operators.settle import settled

#: Methods whose scores depend on the two values only, and not on their case or outer spaces.
BY_VALUE = {"exact", "fuzzy", "numeric"}
#: Classes of the pool that are broadcast, if there are no more.
FEW_CLASSES = 200_000


def best_candidates(queries: DataFrame, pool: DataFrame, blocks: Sequence[tuple[str, str]], fields: Sequence[scoring.MatchField], k: int, all_if_keyless: bool = True, skip_self: bool = False, earlier: bool = False, floor: float = 0.0) -> DataFrame:
    """(b_id, a_id, score, field_scores): the k best blocked candidates of each query by score, then a_id.

    skip_self: a record is no candidate of its own. earlier: queries have seq_b, the pool seq_a, and candidates are those of
    a smaller seq. floor: only scores that reach it.

    Of the classes that a query's class meets only the k first by score and smallest a_id can hold any of its k best, and of
    a class only its k first members; with `earlier`, those members that ever are among the k first.
    """
    most = k + skip_self
    q, p = _classes(queries, pool, [b for b, _ in blocks], [a for _, a in blocks], fields)
    tables = scoring.fuzzy_tables(p, q, fields, prefix="v_")
    a_cols, b_cols = ([c for c in df.columns if c.startswith("v_")] for df in (p, q))
    detail = [f"_score_{n}" for n in range(len(fields))]
    tasks, parts = _tasks(q), []
    for own, other, used in by_mask(q, p, blocks, look=True):
        if not used and not all_if_keyless:
            own = own.limit(0)
        group = [*used, *b_cols]
        own, other = own.select("b_id", *group, *(["seq_b"] if earlier else [])), other.select("a_id", *used, *a_cols, *(["seq_a"] if earlier else []))
        if earlier:
            members = settled(skyband(other, [*used, *a_cols], ["a_id"], most).drop("until"))
        else:
            members = settled(_first(other, [*used, *a_cols], ["a_id"], most))
        held = settled(members.groupBy(*used, *a_cols).agg(F.min("a_id").alias("least"), *([F.min("seq_a").alias("soonest")] if earlier else [])))
        # few classes can make many pairs of them, which their bytes do not tell: they are dealt out before they meet
        asked = own.groupBy(*group).agg(F.max("seq_b").alias("latest")) if earlier else own.select(*group).distinct()
        asked = asked.repartition(tasks)
        held = F.broadcast(held) if held.limit(FEW_CLASSES + 1).count() <= FEW_CLASSES else held
        met = asked.join(held, used) if used else asked.crossJoin(held)
        if earlier:
            met = met.where("soonest < latest")
        met = _scored(met, fields, tables)
        if floor > 0:
            met = met.where(F.col("score") >= floor)
        if not earlier:
            met = _first(met, group, [F.desc("score"), "least"], most)
        listed = met.drop("least").join(members, [*used, *a_cols]).select(*group, "a_id", "score", *detail, *(["seq_a"] if earlier else []))
        if earlier:
            listed = skyband(listed, group, [F.desc("score"), "a_id"], most)
            found = own.join(listed, group).where("seq_a < seq_b and (until is null or seq_b <= until)")
        else:
            found = own.join(_first(listed, group, [F.desc("score"), "a_id"], most), group)
        if skip_self:
            found = _first(found.where("b_id <> a_id"), ["b_id"], [F.desc("score"), "a_id"], k)
        parts.append(found.select("b_id", "a_id", "score", scoring.detail(fields).alias("field_scores")))
    return union(parts)


def _tasks(df: DataFrame) -> int:
    return 3 * df.sparkSession.sparkContext.defaultParallelism


def _classes(queries: DataFrame, pool: DataFrame, b_blocks: Sequence[str], a_blocks: Sequence[str], fields: Sequence[scoring.MatchField]) -> tuple[DataFrame, DataFrame]:
    """Both sides with their ids, block fields and compared values (v_a_<field>, v_b_<field>). A value that is only compared exactly and that the other
    side does not have scores 0 with all of it, as an empty one does: those are one class."""
    sides = {}
    for s, df, id_, blocks in (("b", queries, "b_id", b_blocks), ("a", pool, "a_id", a_blocks)):
        names = dict.fromkeys(f"{s}_{getattr(f, f'field_{s}')}" for f in fields)
        sides[s] = df.select(id_, *([f"seq_{s}"] if f"seq_{s}" in df.columns else []), *[c for c in dict.fromkeys(blocks) if c != id_], *[key(F.col(n)).alias(f"v_{n}") for n in names])
    out = dict(sides)
    for s, o in ("ba", "ab"):
        for name in dict.fromkeys(getattr(f, f"field_{s}") for f in fields):
            mine = [f for f in fields if getattr(f, f"field_{s}") == name]
            if any(f.method != "exact" for f in mine):
                continue
            col = f"v_{s}_{name}"
            there = union(sides[o].select(F.col(f"v_{o}_{n}").alias(col)) for n in dict.fromkeys(getattr(f, f"field_{o}") for f in mine)).distinct()
            out[s] = out[s].join(there.withColumn("_there", F.lit(True)), col, "left").withColumn(col, F.when(F.col("_there"), F.col(col)).otherwise(F.lit(""))).drop("_there")
    return tuple(settled(out[s].repartition(_tasks(out[s]), f"{s}_id")) for s in "ba")


def _scored(met: DataFrame, fields: Sequence[scoring.MatchField], tables: dict) -> DataFrame:
    """Pairs of classes with the score of each field and the whole."""
    values = {c[2:]: c for c in met.columns if c.startswith("v_")}
    return scoring.with_scores(met.withColumns({n: F.col(c) for n, c in values.items()}), fields, tables).drop(*values)


def _first(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each group."""
    place = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= k).drop("_place")


def skyband(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The rows of df (group, order, seq_a) that are among the first k of their group, by `order`, of those of a smaller seq
    at some time, with `until`: after that seq k others of a smaller seq come before it (null: never).

    A row that k rows of a part of its group keep out is kept out of the whole, so each task drops what it can before the
    groups are brought together.
    """
    kind = df.schema["seq_a"].dataType.simpleString()
    names, schema = df.columns, f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, until {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seqs = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(g).to_pylist() for g in group))) if group else [()] * len(batch)
            keep, until = [], []
            for n, (at, seq) in enumerate(zip(keys, batch.column("seq_a").to_pylist())):
                if at != last:
                    last, seqs = at, []
                full = len(seqs) == k
                if full and seqs[-1] <= seq:
                    continue
                keep.append(n)
                until.append(seqs[-1] if full else None)
                insort(seqs, seq)
                del seqs[k:]
            some = batch.select(names).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(until, batch.column("seq_a").type)], [*names, "until"])

    local = df.sortWithinPartitions(*group, *order).mapInArrow(run, schema).drop("until")
    whole = local.repartition(*group) if group else local.coalesce(1)
    return whole.sortWithinPartitions(*group, *order).mapInArrow(run, schema)
