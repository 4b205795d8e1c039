"""Numbers without gaps, in an order, and not by one task: ranges are sorted apart, counted, and numbered from the sums before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import written

PLACE = 33  # bits of a row's place within its partition in monotonically_increasing_id


def dense_numbers(df: DataFrame, order: list[str], name: str = "number", within: str | None = None) -> DataFrame:
    """df with numbers from 1 in ascending order of some columns, within each value of one column if it is given.

    Rows are dealt into ranges of the order, sorted, and written with their places; the driver adds up a count a range, and of
    ``within`` a first number a value is joined. Rows that are equal in all of order are numbered in any order.
    """
    order = ([within] if within else []) + order
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_place", PLACE)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a range
    before, total = [], 0
    for r in counts:
        before.append((r["part"], total))
        total += r["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_part long, _before long"))
    out = rows.withColumn("_part", part).join(offsets, "_part", "left").withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << PLACE) - 1)) + 1).drop("_part", "_before", "_place")
    if within is None:
        return out
    first = out.groupBy(F.col(within).alias("_of")).agg(F.min(name).alias("_first"))
    return out.join(first, F.col(within).eqNullSafe(F.col("_of"))).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_of", "_first")
