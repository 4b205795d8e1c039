"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.storage import discard, scratch, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], base: str) -> str:
    """A column name like base that none of the taken names equals, whatever the case."""
    used = {x.lower() for x in taken}
    while base.lower() in used:
        base += "_"
    return base


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """Asks for a broadcast of a table of so many short rows, if they are few enough."""
    return F.broadcast(df) if rows <= most else df


__all__ = ["discard", "fresh", "scratch", "small", "table", "text_or_empty", "written"]
