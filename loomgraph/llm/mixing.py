"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target of words; its documents' expected copies are target / size of the source, the same for all.
The whole part of that number is taken, and the fractions are rounded dependently: two documents' fractions are paired
and mass is moved from one to the other, in a random direction whose probabilities keep each document's expectation,
until one of them is integral. Mass is counted in words (a document of twice the size takes half the fraction), so that
the source's words stay exact while pairs are resolved; only the last document of a source is rounded alone, and a
source misses its target by at most one document's size.

Documents whose expected copies are whole take no part in the rounding. The reduction is a tree: the others are dealt into
buckets by a hash (a hot source has many buckets, of at most ``fan_in`` documents but for a chance in a billion), each bucket is
resolved apart and leaves at most one fractional document, and these residuals meet in the next level until a source has
one. Random numbers are hashes of the seed, the level and the document, so reruns agree.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import fresh, small, written

WEIGHTS = (5.0, 2.0, 1.0)


def words(text: str | Column) -> Column:
    """The number of runs of characters other than blanks and control white space (null: 0)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Targets by weight that share the sum of all sizes; none above ``most`` times its size, the excess reshared by weight."""
    left, out = float(sum(sizes)), [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if sizes[i] > 0]
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def hashed(seed: int, level: int, nth: int) -> Column:
    """A hash of a row of the state; rows differ in id, text and number."""
    return F.xxhash64(F.lit(seed), F.lit(level), F.lit(nth), "id", "h", "nth")


def uniform(seed: int, level: int, nth: int) -> Column:
    """A number in [0, 1) by a hash of the row."""
    return F.shiftrightunsigned(hashed(seed, level, nth), 11) / F.lit(2.0**53)


def resolve(size: np.ndarray, fraction: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding of one bucket: (0, 1 or, for the one returned, a fraction; its index or -1).

    Documents are taken in order; the current residual and the next one exchange words until one is 0 or 1. Sizes are
    positive.
    """
    out = np.where(fraction >= 1.0 - 1e-12, 1.0, np.where(fraction <= 1e-12, 0.0, fraction))
    held = -1
    for i in range(len(out)):
        if out[i] in (0.0, 1.0):
            continue
        if held < 0:
            held = i
            continue
        a, b = float(size[held]), float(size[i])
        up = min((1.0 - out[held]) * a, out[i] * b)  # words that can go to the held one
        down = min(out[held] * a, (1.0 - out[i]) * b)
        moved = up if draw[i] * (up + down) < down else -down
        for j, d in ((held, moved / a), (i, -moved / b)):
            x = out[j] + d
            out[j] = 0.0 if x < 1e-12 else 1.0 if x > 1.0 - 1e-12 else x
        open_ = [j for j in (held, i) if out[j] not in (0.0, 1.0)]
        held = open_[0] if open_ else -1
    return out, held


def dealt(rows: DataFrame, fan_in: int, seed: int, level: int) -> tuple[DataFrame, int]:
    """rows with a bucket, by source and hash, and the number of rows of the largest source."""
    counts = {r["source_no"]: r["n"] for r in rows.groupBy("source_no").agg(F.count("*").alias("n")).collect()}  # a row a source
    if not counts:
        return rows, 0
    mean = max(2, fan_in - int(6 * fan_in**0.5))
    sizes = rows.sparkSession.createDataFrame([(s, 1 if n <= fan_in else -(-n // mean)) for s, n in counts.items()], "source_no int, buckets int")
    table = rows.join(small(sizes, len(counts)), "source_no")
    return table.withColumn("bucket", F.pmod(hashed(seed, level, 0), F.col("buckets")).cast("int")).drop("buckets"), max(counts.values())


def rounded(rows: DataFrame, fan_in: int, seed: int) -> DataFrame:
    """Resolves the fractions of (id, h, nth, source_no, size, fraction, copies) rows, by source, in a tree of buckets."""
    done = rows.where("fraction = 0")
    rows, schema, names = rows.where("fraction > 0"), rows.schema, rows.columns
    for level in itertools.count():
        table, largest = dealt(rows, fan_in, seed, level)
        if not largest:
            return done
        last = largest <= fan_in
        table = table.withColumns({f"draw{i}": uniform(seed, level, i) for i in (1, 2, 3)})

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.iloc[np.lexsort((pdf["nth"], pdf["h"], pdf["draw1"]))]
            got, held = resolve(pdf["size"].to_numpy(np.float64), pdf["fraction"].to_numpy(np.float64), pdf["draw2"].to_numpy())
            if held >= 0 and last:
                got[held] = float(pdf["draw3"].iloc[held] < got[held])
            one = got == 1.0
            return pdf[names].assign(fraction=np.where(one, 0.0, got), copies=(pdf["copies"] + one).astype(np.int32))

        out = written(table.groupBy("source_no", "bucket").applyInPandas(run, schema), f"mix-{level}")
        done = done.unionByName(out.where("fraction = 0"))
        if last:
            return done
        rows = out.where("fraction > 0")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS, most: float = 3.0, fan_in: int = 4_000, seed: int = 20240501) -> tuple[DataFrame, DataFrame]:
    """(rows with id, h, nth, size, source_no, copies; sources with source_no, source, source_size, target).

    Sources are taken by code point, null last, with the weights repeating. Documents of size 0 are never taken. Rows are
    told apart by their id, size and h, a hash of the text, and rows that agree in all of these (repeated rows) by a
    running number within them: repeated rows are documents of their own. The number of sources must fit the driver.
    """
    keyed = docs.select(F.col(source_col).alias("source"), words(text_col).alias("size"), F.col(id_col).alias("id"), text_hash(text_col).alias("h"))
    # repeated rows become one with a number of occurrences, and are spread again: only numbers are exchanged
    keyed = keyed.groupBy("source", "size", "id", "h").agg(F.count("*").alias("occurs"))
    keyed = keyed.select("source", "size", F.explode(F.sequence(F.lit(1), F.col("occurs").cast("int"))).alias("nth"), "id", "h")
    keyed = written(keyed, "mix-rows")
    sources = sorted(((r["source"], r["n"]) for r in keyed.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets([n for _, n in sources], [weights[i % len(weights)] for i in range(len(sources))], most)
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, s, int(n), float(t), min(most, t / n) if n else 0.0) for i, ((s, n), t) in enumerate(zip(sources, goal, strict=True))], "source_no int, source string, source_size long, target double, rate double")
    state = keyed.join(small(table, len(sources)), keyed["source"].eqNullSafe(table["source"]))
    rate = F.when(F.col("size") > 0, F.col("rate")).otherwise(F.lit(0.0))
    state = state.select("id", "h", "nth", "source_no", "size", (rate - F.floor(rate)).alias("fraction"), F.floor(rate).cast("int").alias("copies"))
    return rounded(state, fan_in, seed), table


def text_hash(text_col: str) -> Column:
    """A hash that tells null from empty."""
    return F.xxhash64(F.col(text_col).isNull(), F.col(text_col))


def mix_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """One row a row: id, size, source_size, target, taken (words, repeats counted) and copies."""
    rows, sources = mixed(docs, id_col, source_col, text_col, **options)
    rows = rows.join(small(sources, sources.count()), "source_no")
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents that the mix takes, with all their columns, each as often as it is taken."""
    rows, _ = mixed(docs, id_col, source_col, text_col, **options)
    k, total, same, nth = (fresh(docs.columns, x) for x in ("mix_key", "mix_copies", "mix_same", "mix_nth"))
    # one key column for join and window: texts are exchanged once; a null id is no field of the key, so that no text equals it
    key = lambda i, h: F.to_json(F.struct(i.alias("i"), h.alias("h")))
    # repeated rows are interchangeable: their copies are added up and dealt out evenly
    taken = rows.groupBy(key(F.col("id"), F.col("h")).alias(k)).agg(F.sum("copies").cast("int").alias(total), F.count("*").cast("int").alias(same)).where(F.col(total) > 0)
    salt = fresh(docs.columns, "mix_salt")
    found = docs.withColumns({k: key(F.col(id_col), text_hash(text_col)), salt: F.monotonically_increasing_id()}).join(taken, k)
    found = found.withColumn(nth, F.row_number().over(Window.partitionBy(k).orderBy(salt)))
    copies = F.floor(F.col(total) / F.col(same)) + (F.col(nth) <= F.col(total) % F.col(same)).cast("int")
    return found.withColumn(total, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))))).select(*docs.columns)
