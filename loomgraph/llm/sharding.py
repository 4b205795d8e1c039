"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt into parts by a hash. The driver draws the matrix of counts part x shard from the multivariate
hypergeometric law, part after part from the shards' remaining room, so that its column sums are the shards' sizes.
Within a part the rows are permuted and the first m(p, 0) go to shard 0, the next m(p, 1) to shard 1 and so on. Within a
shard they are permuted again: rows are ranked by a random number, in slices of equal width whose offsets are sums of
counts, so that no task holds a shard. The matrix has parts x shards whole numbers, a part having some 131,072 rows.

Random numbers are hashes of a seed and the row, so that reruns, retried tasks and the two passes agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written


def communication_matrix(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """counts[p] rows of part p, dealt to shards whose sizes are at most one apart (larger ones first)."""
    rng = np.random.default_rng(seed)
    n = int(counts.sum())
    room = np.full(shards, n // shards, np.int64)
    room[: n % shards] += 1
    out = np.zeros((len(counts), shards), np.int64)
    for p, c in enumerate(counts):
        out[p] = draw(rng, room, int(c))
        room -= out[p]
    return out


def draw(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """One draw of n from an urn with room[j] balls of colour j, colour by colour."""
    out, left, total = np.zeros(len(room), np.int64), n, int(room.sum())
    for j, r in enumerate(room):
        rest = total - int(r)
        out[j] = left if rest == 0 else 0 if left == 0 else hypergeometric(rng, int(r), rest, left)
        left, total = left - int(out[j]), rest
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A draw by numpy's generator, which takes populations below 10^9; larger ones are inverted.

    There the probabilities are taken relative to the mode's, as products of ratios of neighbours, out to where they are
    below 10^-25 of it, and added up: no logarithms of factorials, so that the error is some units of the last place.
    """
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    least, most = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), least), most)

    def outward(step: int, end: int) -> np.ndarray:
        """Weights of mode + step, mode + 2 step, ... relative to the mode's."""
        out, x, weight = [], mode, 1.0
        while x != end and weight > 1e-25:
            k = np.arange(x, end, step)[:4096].astype(np.float64)
            up = (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1)) if step > 0 else k * (bad - n + k) / ((good - k + 1) * (n - k + 1))
            out.append(weight * np.cumprod(up))
            x, weight = x + step * len(k), float(out[-1][-1])
        return np.concatenate(out) if out else np.zeros(0)

    low, high = outward(-1, least), outward(1, most)
    sums = np.cumsum(np.concatenate([low[::-1], [1.0], high]))
    return mode - len(low) + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def sharded(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 20240501, rows_per_part: int = 1 << 17) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of all rows; law ``rows``: shards' counts are at most one apart.

    Size: UTF-8 bytes of the text (null: none) plus 16. Slots of a shard are gapless from 0. grown_shard is null, as the
    law says nothing about one more shard. Rows with equal ids and texts are interchangeable; null ids are dealt as others.
    Texts aren't exchanged, only ids, sizes and checksums.
    """
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"))
    rows = rows.groupBy("id", "size", "crc", "h").agg(F.count("*").alias("occurs"))
    rows = rows.select("id", "size", "crc", "h", F.explode(F.sequence(F.lit(1), F.col("occurs").cast("int"))).alias("nth"))
    rows = written(rows.select("id", "size", "crc", *(F.xxhash64(F.lit(seed + i), "id", "crc", "h", "nth").alias(f"r{i}") for i in range(3))), "shard-rows")
    n = rows.count()
    parts = max(64, -(-n // rows_per_part))
    part = F.pmod("r0", F.lit(parts)).cast("int")
    counts = np.zeros(parts, np.int64)
    for r in rows.groupBy(part.alias("p")).count().collect():  # a row a part
        counts[r["p"]] = r["count"]
    ends = np.cumsum(communication_matrix(counts, shards, seed), axis=1)
    matrix = spark.createDataFrame([(p, [int(x) for x in ends[p]]) for p in range(parts)], "part int, ends array<long>")
    if parts * shards * 8 <= 32 << 20:  # else Spark joins by an exchange
        matrix = F.broadcast(matrix)
    dealt = rows.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("r1", "r2", "id")))
    dealt = dealt.join(matrix, "part").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("place"))))
    # the second permutation: slices of the shard by the random number, as many as keep each at rows_per_part or fewer
    slices = max(1, -(-n // (shards * (rows_per_part // 16))))
    dealt = dealt.select("id", "size", "crc", "r2", "r1", "shard", F.pmod(F.shiftrightunsigned("r2", 8), F.lit(slices)).cast("int").alias("slice"))
    dealt = written(dealt, "shard-dealt")
    per_slice = dealt.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("shard", "slice").orderBy("r2", "r1", "id")
    return dealt.withColumn("place", F.row_number().over(order)).join(offsets, ["shard", "slice"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
