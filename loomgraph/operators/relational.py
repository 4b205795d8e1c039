"""Relational operators over rows of a sheet. Columns are named; row order is the column _ord."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import scalars as S
from loomgraph.sources.workbook import ORD

from .identity import quoted

FUNCTIONS = ("count", "sum", "avg", "min", "max")


def filtered(df: DataFrame, column: str | None = None, value: object = None, predicate: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Rows whose column equals the value (null equals null), or that satisfy a condition built from the table."""
    if predicate is not None:
        return df.where(predicate(df))
    if column is None:
        return df.where(F.lit(False))
    return df.where(quoted(column).eqNullSafe(F.lit(value)))


def projected(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(quoted(c) for c in columns))


def ordered(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """By the value as text, with null as "None"; ties keep the row order."""
    key = F.coalesce(quoted(column).cast("string"), F.lit("None"))
    return df.orderBy(key.desc() if descending else key.asc(), ORD)


def ordered_metrics(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Aggregates by value: ascending with nulls last, descending with nulls first."""
    return df.orderBy(quoted(column).desc_nulls_first() if descending else quoted(column).asc_nulls_last())


def count_of(n: object) -> int:
    """A number of rows: what isn't a number is 10, negative numbers are 0."""
    try:
        return max(0, int(n))
    except (TypeError, ValueError):
        return 10


def limited(df: DataFrame, n: object = 10, order: Sequence[str] = (ORD,)) -> DataFrame:
    """The first n rows in row order."""
    return df.orderBy(*order).limit(count_of(n))


def top(df: DataFrame, column: str, n: object = 10, descending: bool = True) -> DataFrame:
    """Sort and limit in one: the first n by the value as text."""
    return ordered(df, column, descending).limit(count_of(n))


def distinct_entities(df: DataFrame, pk: str) -> DataFrame:
    """The first row of each key."""
    nth = F.row_number().over(Window.partitionBy(quoted(pk)).orderBy(ORD))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def grouped_count(df: DataFrame, column: str | None) -> DataFrame:
    key = quoted(column).alias("key") if column else F.lit(None).cast("string").alias("key")
    return df.groupBy(key).agg(F.count("*").alias("n"))


def aggregate(df: DataFrame, fn: str, column: str | None = None, by: str | None = None) -> DataFrame:
    """One of count, sum, avg, min, max (others count), of a column's numeric values, by group or over all rows.

    Values that aren't numbers are skipped; nothing left gives null, and 0 for count. Without a column, all functions
    count: rows, or the rows of each group.
    """
    f = fn.lower() if fn.lower() in FUNCTIONS else "count"
    if column is None:
        value = F.count("*").cast("double")
    else:
        x = S.number(quoted(column))
        value = {"count": F.count(x).cast("double"), "sum": F.sum(x), "avg": F.avg(x), "min": F.min(x), "max": F.max(x)}[f]
    if by is None:
        return df.agg(value.alias("value"))
    return df.groupBy(quoted(by).alias("key")).agg(value.alias("value"))


def joined(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Right rows whose key a left row has, one for each match; the left rows themselves where nothing matches."""
    out = right.join(left.select(quoted(left_key).alias("_k")), quoted(right_key) == F.col("_k")).drop("_k")
    return left if out.isEmpty() else out


def expanded(df: DataFrame, column: str, ents: DataFrame) -> DataFrame:
    """Entities that the identifiers in a column's cells name, with the row they come from."""
    ids = df.select(F.col(ORD).alias("from_row"), F.explode(F.regexp_extract_all(quoted(column), F.lit(S.ID_UPPER), F.lit(0))).alias("pk"))
    return ids.join(ents, "pk")


def expanded_list(df: DataFrame, column: str, ents: DataFrame, separators: str = r"[;,/|]") -> DataFrame:
    """The same for cells that list plain keys."""
    ids = df.select(F.col(ORD).alias("from_row"), F.explode(F.split(quoted(column).cast("string"), separators)).alias("pk"))
    return ids.select("from_row", F.trim("pk").alias("pk")).join(ents, "pk")


def pivoted(df: DataFrame, by: str, column: str, values: Sequence[object]) -> DataFrame:
    """Counts of rows by key and the given values of a column."""
    return df.groupBy(quoted(by).alias("key")).pivot(column, list(values)).count()


def searched(ents: DataFrame, token: str) -> DataFrame:
    """Entities whose name contains the token, whatever the case."""
    return ents.where(F.lower("name").contains(token.lower()))


def ranked_search(ents: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """(rank, pk, name): 0 equal id or name, 1 a prefix of one, 2 at a word's start, 3 within; in entity order, at most 50."""
    t = term.lower()
    pk, name = F.lower("pk"), F.coalesce(F.lower("name"), F.lit(""))
    word = lambda c: c.startswith(t) | c.contains(" " + t)
    cells = F.transform(F.map_values("metadata"), lambda v: F.lower(F.coalesce(v, F.lit(""))))
    rank = F.when((pk == t) | (name == t), 0).when(pk.startswith(t) | name.startswith(t), 1).when(F.exists(cells, word), 2).when(F.exists(cells, lambda c: c.contains(t)), 3)
    return ents.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "ord").select("rank", "class", "pk", "name").limit(limit)


# Predicates that invariants can use, by name.
PREDICATES: dict[str, Callable[[Column, str | None], Column]] = {
    "not_null": lambda c, _: c.isNotNull(),
    "non_empty": lambda c, _: F.coalesce(F.length(c.cast("string")) > 0, F.lit(False)),
    "equals": lambda c, target: F.coalesce(c.cast("string") == F.lit(target), F.lit(False)),
    "matches": lambda c, target: F.coalesce(c.cast("string").rlike(target or ""), F.lit(False)),
}
