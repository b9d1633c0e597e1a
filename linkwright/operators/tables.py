"""State tables: cross-map, exclusions, records, reviews, unmatched rows, dictionary groups, and their pages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# --- cross-map: pairs (a_id, b_id), each id at most once ---


def crossmap_add(crossmap: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add pairs; whoever held one of their ids before loses the partner. Of conflicting new pairs the last by (a_id, b_id) stays."""
    new = pairs.select("a_id", "b_id").distinct()
    by_a, by_b = Window.partitionBy("a_id").orderBy(F.desc("b_id")), Window.partitionBy("b_id").orderBy(F.desc("a_id"))
    new = new.withColumn("n", F.row_number().over(by_a)).where("n = 1").withColumn("n", F.row_number().over(by_b)).where("n = 1").drop("n")
    old = crossmap.select("a_id", "b_id").join(new.select("a_id"), "a_id", "left_anti").join(new.select("b_id"), "b_id", "left_anti")
    return old.select("a_id", "b_id").unionByName(new)


def crossmap_displaced(crossmap: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that crossmap_add would remove."""
    same = crossmap.join(pairs.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
    return same.join(pairs.select("a_id"), "a_id", "left_semi").select("a_id", "b_id").unionByName(same.join(pairs.select("b_id"), "b_id", "left_semi").select("a_id", "b_id")).distinct()


def crossmap_remove(crossmap: DataFrame, pairs: DataFrame) -> DataFrame:
    """Remove exactly these pairs."""
    return crossmap.join(pairs.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti").select("a_id", "b_id")


def crossmap_take(crossmap: DataFrame, ids: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """Remove by one side's ids: (what is left, what was taken)."""
    col = f"{side}_id"
    return crossmap.join(ids.select(col), col, "left_anti").select("a_id", "b_id"), crossmap.join(ids.select(col).distinct(), col, "left_semi").select("a_id", "b_id")


def crossmap_claim(crossmap: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add those pairs of which both ids are free, in order of (b_id, a_id)."""
    free = pairs.select("a_id", "b_id").join(crossmap.select("a_id"), "a_id", "left_anti").join(crossmap.select("b_id"), "b_id", "left_anti")
    by_a, by_b = Window.partitionBy("a_id").orderBy("b_id"), Window.partitionBy("b_id").orderBy("a_id")
    free = free.withColumn("n", F.row_number().over(by_b)).where("n = 1").withColumn("n", F.row_number().over(by_a)).where("n = 1")
    return crossmap.select("a_id", "b_id").unionByName(free.select("a_id", "b_id"))


def partners(crossmap: DataFrame, ids: DataFrame, side: str) -> DataFrame:
    """The pairs of some records of a side: lookups by the dozen or by the million are the same join."""
    return crossmap.join(ids.select(f"{side}_id").distinct(), f"{side}_id", "left_semi")


def crossmap_stats(crossmap: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: pairs, a_total, b_total, a_share and b_share in percent."""
    n = crossmap.agg(F.count(F.lit(1)).alias("pairs"))
    na, nb = a.agg(F.count(F.lit(1)).alias("a_total")), b.agg(F.count(F.lit(1)).alias("b_total"))
    share = lambda c: F.when(F.col(c) > 0, 100.0 * F.col("pairs") / F.col(c)).otherwise(F.lit(0.0))
    return n.crossJoin(na).crossJoin(nb).select("pairs", "a_total", "b_total", share("a_total").alias("a_share"), share("b_total").alias("b_share"))


# --- exclusions ---


def exclusion_pairs(raw: DataFrame, a: DataFrame) -> DataFrame:
    """(a_id, b_id) from rows written either way round: the id that side A knows comes first."""
    known = a.select(F.col("a_id").alias("known"))
    right = raw.join(known, F.col("a_id") == F.col("known"), "left_semi")
    wrong = raw.join(known, F.col("a_id") == F.col("known"), "left_anti").select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))
    return right.select("a_id", "b_id").unionByName(wrong).distinct()


# --- records ---


def latest(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def unmatched(records: DataFrame, relationships: DataFrame, side: str) -> DataFrame:
    """Records of a side without a match or review."""
    col = f"{side}_id"
    taken = relationships.where(F.col("relationship_type").isin("match", "review")).select(col)
    return records.join(taken, col, "left_anti")


# --- pages ---


def page_pairs(crossmap: DataFrame, cursor: str | None = None, limit: int = 100) -> DataFrame:
    """Pairs ordered by a_id, b_id, after a cursor a_id."""
    rows = crossmap if cursor is None else crossmap.where(F.col("a_id") > cursor)
    return rows.orderBy("a_id", "b_id").limit(limit)


def page_unmatched(records: DataFrame, id_col: str, cursor: str | None = None, limit: int = 100, with_record: bool = True) -> DataFrame:
    """Unmatched records by id, after a cursor id; with their fields or the ids alone."""
    rows = records if cursor is None else records.where(F.col(id_col) > cursor)
    return (rows if with_record else rows.select(id_col)).orderBy(id_col).limit(limit)


def page_reviews(reviews: DataFrame, cursor: str | None = None, limit: int = 100) -> DataFrame:
    """Reviews by score descending, id, candidate; the cursor `score|id|candidate` is that of the last row seen. A malformed
    cursor gives the first page."""
    parts = (cursor or "").split("|")
    try:
        score = float(parts[0]) if len(parts) == 3 else None
    except ValueError:
        score = None
    if score is not None:
        s, i, c = F.lit(score), F.lit(parts[1]), F.lit(parts[2])
        later = (F.col("id") > i) | ((F.col("id") == i) & (F.col("candidate_id") > c))
        reviews = reviews.where((F.col("score") < s) | ((F.col("score") == s) & later))
    return reviews.orderBy(F.desc("score"), "id", "candidate_id").limit(limit)


def review_cursor(row) -> str:
    return f"{row['score']!r}|{row['id']}|{row['candidate_id']}"


def browse(table: DataFrame, filters: dict[str, str] | None = None, exact: Iterable[str] = (), sort: str | None = None, descending: bool = False, page: int = 0, size: int = 100) -> tuple[DataFrame, int]:
    """A page of a table and the count of all rows that pass: equality on `exact` columns, else substrings without case.
    Unknown columns are ignored; without a valid sort column the order is the table's first column."""
    for col, value in (filters or {}).items():
        if col in table.columns:
            c = F.col(f"`{col}`").cast("string")
            table = table.where(c == value if col in exact else F.contains(F.lower(c), F.lit(value.lower())))
    by = sort if sort in table.columns else table.columns[0]
    order = F.col(f"`{by}`").desc() if descending else F.col(f"`{by}`").asc()
    return table.orderBy(order, *[F.col(f"`{c}`") for c in table.columns if c != by]).offset(page * size).limit(size), table.count()


def index(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, columns) of tables that can be browsed, in one job."""
    spark = next(iter(tables.values())).sparkSession
    each = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.lit(",".join(df.columns)).alias("columns")) for n, df in tables.items()]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out if each else spark.createDataFrame([], "name string, rows long, columns string")


def choices(table: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, value, n): the values that can be chosen in columns with few different ones."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return table.select(pairs.alias("p")).select("p.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


# --- dictionary ---


def merged_groups(rows: Iterable[Iterable[str]]) -> list[tuple[str, int]]:
    """(term, group) of rows of equivalent terms: upper case, trimmed, rows of fewer than two terms skipped, rows that share a term merged."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for row in rows:
        terms = [t for t in dict.fromkeys(x.strip().upper() for x in row) if t]
        if len(terms) < 2:
            continue
        for t in terms:
            parent.setdefault(t, t)
        for t in terms[1:]:
            x, y = sorted((find(terms[0]), find(t)))
            parent[y] = x
    number = {root: k for k, root in enumerate(sorted({find(t) for t in parent}))}
    return sorted((t, number[find(t)]) for t in parent)


def synonym_groups(spark: SparkSession, rows: Iterable[Iterable[str]]) -> DataFrame:
    """The dictionary as a table (term, group_id). Dictionaries are configuration, small enough for the driver."""
    return spark.createDataFrame(merged_groups(rows), "term string, group_id int")
