"""Document fingerprints: bottom-k sketches of hashed word shingles, by DataFrame functions only.

A sketch is the k smallest distinct 64-bit hashes of a text's shingles, ascending. The sketch of a union is the k
smallest of two sketches together (:func:`merged`), so parts of a text or corpus can be sketched apart. Sketches
estimate resemblance, containment and the number of distinct shingles. With k = 128 the standard error of a
resemblance is at most 0.044.

A shingle is five consecutive words, a word a run of characters other than white space, in lower case. A text of fewer
words has one shingle of all its words; one without words (or null) has the shingle of no words, so that two empty
texts resemble each other fully.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import small, text_or_empty, written

K, WORDS = 128, 5


def sketch(text: Column, k: int = K, n: int = WORDS) -> Column:
    """The bottom-k sketch of a text column (null: empty) as an ascending array of longs."""
    # words are hashed once; a shingle is hashed from its words' hashes
    hashed = F.transform(F.split(F.lower(text_or_empty(text)), r"\s+"), lambda w: F.when(w != "", F.xxhash64(w)))
    return sketch_of_word_hashes(F.array_compact(hashed), k, n)


def sketch_of_word_hashes(hashes: Column, k: int, n: int) -> Column:
    def shingles(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(*(F.element_at(h, i + j) for j in range(n))))
        few = F.array(F.xxhash64(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)), F.lit(1)))
        return F.when(F.size(h) >= n, many).otherwise(few)

    # a one-element array transformed: the hashes are bound once, where an expression used twice would be computed twice
    bound = F.transform(F.array(hashes), shingles)
    return F.slice(F.sort_array(F.array_distinct(F.element_at(bound, 1))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard resemblance: the share of the union's sketch that both hold."""
    u = merged(a, b, k)
    return F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, by inclusion and exclusion of the estimated counts."""
    j = resemblance(a, b, k)
    return F.least(F.lit(1.0), j * (distinct_shingles(a, k) + distinct_shingles(b, k)) / ((j + 1.0) * distinct_shingles(a, k)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact where the sketch isn't full."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def encoded(a: Column) -> Column:
    """A sketch as text: base64 of its big-endian hashes."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


MOST_RANGES, STRIDE = 65_536, 256


def id_ranges(docs: DataFrame, id_col: str, rows: int) -> list[int]:
    """Bounds of id ranges of about so many rows each, at most 65,536; an id that fills a range has one of its own."""
    n = docs.select(id_col).count()
    parts = min(MOST_RANGES, max(1, -(-n // rows)))
    if parts == 1:
        return []
    at = [i / parts for i in range(1, parts)]
    got = docs.select(F.percentile_approx(id_col, at, max(10_000, 4 * parts)).alias("x")).first()[0] or []
    often = {int(a) for a, b in zip(got, got[1:], strict=False) if a == b}
    return sorted({int(x) for x in got} | {x + 1 for x in often if x < (1 << 63) - 1})


def with_next(docs: DataFrame, id_col: str, text_col: str, own: dict[str, Column], rows: int = 500) -> DataFrame:
    """(id, text, next_text) and, for each column of ``own`` (expressions over text), itself and that of the next row as next_*.

    Rows are in ascending order of id, nulls last, ties by a hash of the text, then the text; after the last comes the first. Ids
    are cut into ranges at approximate percentiles, ranges of one id, or of null ids, that have many rows are cut by the hash,
    and the first row of a range is also put at the end of the one before, so that ranges are ordered apart and no window
    spans the table. Bounds are longs. (Only rows that repeat id and text stay together however many they are.)
    """
    bounds = id_ranges(docs.where(F.col(id_col).isNotNull()), id_col, rows)
    rows_ = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows_ = rows_.withColumns({"h": F.xxhash64("text"), "range": _range_of(bounds, F.col("id"))})
    # what ranges have: at most some 65,536 rows of numbers, from the ids alone
    sizes = rows_.groupBy("range").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()
    hot = [(r["range"], min(MOST_RANGES, -(-r["n"] // rows))) for r in sizes if r["lo"] == r["hi"] and r["n"] > 2 * rows]
    if hot:
        cuts = small(docs.sparkSession.createDataFrame(hot, "range int, cuts int"), len(hot))
        share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
        rows_ = rows_.join(cuts, "range", "left").withColumn("cut", F.coalesce(F.least(F.col("cuts") - 1, F.floor(share * F.col("cuts"))), F.lit(0)).cast("int")).drop("cuts")
    else:
        rows_ = rows_.withColumn("cut", F.lit(0))
    parts = ["range", "cut"]
    # the range, or cut, before each: within a range that of the next lower cut, else the last cut of the range before
    firsts = rows_.groupBy(*parts).agg(F.min("id").alias("first_id"))
    firsts = written(firsts.withColumn("cut_before", F.lag("cut").over(Window.partitionBy("range").orderBy("cut"))), "range-firsts")
    order = sorted(r["range"] for r in sizes)
    before = docs.sparkSession.createDataFrame([(r, order[i - 1]) for i, r in enumerate(order)], "range int, other int")
    lasts = firsts.groupBy(F.col("range").alias("other")).agg(F.max("cut").alias("last_cut"))
    heads = firsts.join(before.join(lasts, "other"), "range")
    heads = heads.select(*parts, "first_id", F.when(F.col("cut_before").isNull(), F.col("other")).otherwise(F.col("range")).alias("range_before"), F.coalesce("cut_before", "last_cut").alias("cut_before"))
    # of the rows with a range's first id that with the least hash and text is its first
    head = (
        rows_.join(small(heads, firsts.count(), 1_000_000), parts)
        .where(F.col("id").eqNullSafe(F.col("first_id")))
        .groupBy(*parts, "range_before", "cut_before").agg(F.min(F.struct("h", "text")).alias("first"))
        .select(F.lit(None).cast("long").alias("id"), "first.text", "first.h", F.col("range_before").alias("range"), F.col("cut_before").alias("cut"), F.lit(True).alias("sentinel"))
    )
    both = rows_.withColumn("sentinel", F.lit(False)).unionByName(head).repartition(*parts)
    both = both.select("*", *(c.alias(name) for name, c in own.items()))
    w = Window.partitionBy(*parts).orderBy("sentinel", F.col("id").asc_nulls_last(), "h", "text")
    ahead = [F.lead(x).over(w).alias(f"next_{x}") for x in ("text", *own)]
    return both.select("id", "text", "sentinel", *own, *ahead).where(~F.col("sentinel")).drop("sentinel")


def _range_of(bounds: list[int], column: Column) -> Column:
    """The number of bounds that aren't above the id; null ids are in a range after all. Every 256th bound is looked up first."""
    if not bounds:
        return F.when(column.isNull(), 1).otherwise(0)
    longs = lambda x: F.expr(f"cast(split('{','.join(map(str, x))}', ',') AS array<bigint>)")
    up_to = lambda x: F.size(F.filter(x, lambda b: b <= column))
    first = F.greatest(up_to(longs(bounds[::STRIDE])) - 1, F.lit(0)) * STRIDE
    return F.when(column.isNull(), len(bounds) + 1).otherwise(first + up_to(F.slice(longs(bounds), first + 1, STRIDE)))


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 4) code points replaced by the first as many (or all) of the following text."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likenesses; one row a row.

    Null texts are empty. Rows are ordered by id (nulls last), ties by a hash of the text; repeated rows follow one another, so that
    the next document of one may be its copy. A single row is its own next document. Texts are exchanged once.
    """
    rows = with_next(docs, id_col, text_col, {"a": sketch(F.col("text"), k)})
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = rows.select("id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "a", sketch(F.col("edited"), k).alias("b"), F.col("next_a").alias("c"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        encoded(F.col("a")).alias("fingerprint"),
        encoded(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b"), k).alias("near_edited"),
        resemblance(F.col("a"), F.col("c"), k).alias("near_next"),
        distinct_shingles(F.col("a"), k).alias("n_shingles"),
    )
