"""Line deduplication by overlapping three-line windows, by DataFrame functions only.

Every three consecutive lines of a text are a window, known by a 128-bit hash. The first occurrence of a window in the
whole table, by id (nulls last), then a hash of the text, then the row's place in the input, then position, stays; each later one covers its three lines, covered
positions are merged, and covered lines are removed. So a passage of three or more lines that repeats is kept once,
wherever it stands.

Lines are separated by line feeds and compared as they are. Windows of white space only don't count. A text of fewer than three lines
has no window and stays as it is, as do null and empty texts. Rows that repeat id and text, or repeat a text without an id, are
documents of their own, of which the first in the input keeps its lines. (The input is read twice: it must give its rows
in the same places both times, as files do; were it not so, too few lines would go, not too many.) A text whose lines
all go becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh


def windows(text: Column) -> Column:
    """Array of (a, b, pos): a window's hash in two halves and the position, from 0, of its first line."""

    def at(lines: Column) -> Column:
        def window(i: Column) -> Column:
            three = [F.element_at(lines, i + j) for j in range(3)]
            some = F.concat(*three).rlike(r"\S")
            return F.when(some, F.struct(F.xxhash64(*three).alias("a"), F.xxhash64(F.lit(1), *three).alias("b"), (i - 1).alias("pos")))

        return F.when(F.size(lines) >= 3, F.array_compact(F.transform(F.sequence(F.lit(1), F.size(lines) - 2), window)))

    # the lines are bound once by a one-element array
    return F.element_at(F.transform(F.array(F.split(text, "\n")), at), 1)


def repeated_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(place, h, removed): for each row that has later occurrences, the positions of their first lines."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("place"), windows(F.col(text_col)).alias("w"))
    seen = rows.select("id", "h", "place", F.explode("w").alias("w")).select("w.a", "w.b", F.struct(F.col("id").isNull().alias("none"), "id", "h", "place", "w.pos").alias("at"))
    first = seen.groupBy("a", "b").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = seen.join(first, ["a", "b"]).where(F.col("at") > F.col("first"))
    return later.groupBy("at.place", "at.h").agg(F.collect_set("at.pos").alias("removed"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text's lines but those covered by windows at the removed positions."""

    def kept(lines: Column) -> Column:
        covered = F.flatten(F.transform(removed, lambda p: F.array(p, p + 1, p + 2)))
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        return F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n")

    return F.element_at(F.transform(F.array(F.split(text, "\n")), kept), 1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, str]:
    """All columns of docs with the text deduplicated, and two more: the numbers of its lines before and of those removed."""
    place, h, removed = (fresh(docs.columns, x) for x in ("line_place", "line_hash", "line_removed"))
    before, gone = (fresh(docs.columns, x) for x in ("n_lines", "n_removed"))
    marks = repeated_windows(docs, id_col, text_col).toDF(place, h, removed)
    rows = docs.withColumns({h: F.xxhash64(text_col), place: F.monotonically_increasing_id()}).join(marks, [place, h], "left")
    text = F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(without_lines(F.col(text_col), F.col(removed)))
    lines = lambda t: F.coalesce(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    n_gone = F.when(F.col(removed).isNull(), 0).otherwise(F.size(F.array_distinct(F.flatten(F.transform(removed, lambda p: F.array(p, p + 1, p + 2)))))).cast("long")
    return rows.withColumns({gone: n_gone, before: lines(F.col(text_col))}).withColumn(text_col, text).select(*docs.columns, before, gone), before, gone
