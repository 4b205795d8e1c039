"""Fill-in-the-middle: texts cut at unit boundaries into prefix, middle and suffix, and put in another order.

Cutting is relational. The matches of a unit pattern are exploded with their places, a window sums up their lengths within
a document, a request for a cut names a unit by its ordinal and is joined with it, the two offsets of a document are
aggregated, and the text is cut once by substrings. What is exchanged for this is numbers; a text is exchanged once, when
it meets its offsets.

Which units are cut follows from a hash of the id alone, so that reruns agree. Null texts are empty; texts that are empty,
hold a marker or are not drawn stay plain. Rows are known by hashes of id and text: rows that repeat both are cut once and
get the same result, rows without an id are told apart by their texts and are cut like an id of no digits. Cuts at one
place give an empty middle. Other columns stay as they are; new ones get a name that none of them has.
The units of one document are summed up in one task, as its text is in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import fresh, text_or_empty, written

LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Plan:
    """Unit pattern, hash prefix, percentages and markers. Markers must be such that none begins within another."""

    unit: str = LINES
    seed: str = "7:"
    changed: int = 100
    suffix_first: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def draws(seed: str, doc_id: Column) -> list[Column]:
    """Four numbers below 2^32: the first digits of a hash of the id."""
    hexed = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def cut_offsets(docs: DataFrame, id_col: str, text: Column, keys: list[Column], plan: Plan) -> DataFrame:
    """(k1, k2, n, first_cut, second_cut): the number of units of each distinct row, and offsets in code points."""
    lengths = F.transform(F.regexp_extract_all(text, F.lit(plan.unit), F.lit(0)), F.length)
    rows = docs.select(keys[0].alias("k1"), keys[1].alias("k2"), F.col(id_col).alias("id"), lengths.alias("lengths"))
    rows = rows.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("lengths").alias("lengths"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "fim-units")  # from here on a row is a number
    units = rows.select("row", "lengths").repartition("row").select("row", F.posexplode("lengths").alias("nth", "length"))
    so_far = Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = units.select("row", (F.col("nth") + 1).alias("ordinal"), F.sum("length").over(so_far).alias("offset"))
    h1, h2, *_ = draws(plan.seed, F.col("id"))
    n = F.size("lengths")
    asked = rows.select("row", "k1", "k2", n.cast("long").alias("n"), F.explode(F.array(*((h % (n + 1)).cast("int") for h in (h1, h2)))).alias("ordinal"))
    found = asked.join(ends, ["row", "ordinal"], "left").withColumn("offset", F.coalesce("offset", F.lit(0)))  # before the first unit: 0
    return found.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.min("offset").cast("int").alias("first_cut"), F.max("offset").cast("int").alias("second_cut"))


def restored(form: Column, output: Column, plan: Plan = Plan()) -> Column:
    """The text that an output of a form was made of."""

    def parts(start: str, inner: str) -> Column:
        marks = "|".join(f"\\Q{m}\\E" for m in (inner, plan.middle))
        return F.split(F.substr(output, F.lit(len(start) + 1)), marks, -1)

    psm, spm = parts(plan.prefix, plan.suffix), parts(plan.suffix, plan.prefix)
    return F.when(form == "plain", output).when(form == "psm", F.concat(psm[0], psm[2], psm[1])).otherwise(F.concat(spm[1], spm[2], spm[0]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> tuple[DataFrame, dict[str, str]]:
    """All columns of docs and five more, whose names are returned by role: n, form, output, prefix_chars, middle_chars."""
    names = {x: fresh(docs.columns, x) for x in ("n", "form", "output", "prefix_chars", "middle_chars")}
    k1, k2, first, second, n = (fresh([*docs.columns, *names.values()], x) for x in ("fim_k1", "fim_k2", "fim_first", "fim_second", "fim_n"))
    text = text_or_empty(text_col)
    keys = [F.xxhash64(F.lit(i), id_col, text) for i in range(2)]
    cuts = cut_offsets(docs, id_col, text, keys, plan).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("n").alias(n), F.col("first_cut").alias(first), F.col("second_cut").alias(second))
    rows = docs.withColumns({k1: keys[0], k2: keys[1]}).join(cuts.hint("shuffle_hash"), [k1, k2])
    *_, h3, h4 = draws(plan.seed, F.col(id_col))
    marked = F.lit(False)
    for m in (plan.prefix, plan.suffix, plan.middle):
        marked = marked | F.contains(text, F.lit(m))
    form = F.when((text == "") | marked | (h3 % 100 >= plan.changed), "plain").when(h4 % 100 < plan.suffix_first, "spm").otherwise("psm")
    rows = rows.withColumns({names["form"]: form, names["n"]: F.col(n)})
    head, mid, tail = F.substr(text, F.lit(1), F.col(first)), F.substr(text, F.col(first) + 1, F.col(second) - F.col(first)), F.substr(text, F.col(second) + 1)
    put = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    output = F.when(F.col(names["form"]) == "psm", put(plan.prefix, head, plan.suffix, tail, plan.middle, mid)).when(F.col(names["form"]) == "spm", put(plan.suffix, tail, plan.prefix, head, plan.middle, mid)).otherwise(text)
    changed = F.col(names["form"]) != "plain"
    counts = {names["prefix_chars"]: F.when(changed, F.col(first)).cast("long"), names["middle_chars"]: F.when(changed, F.col(second) - F.col(first)).cast("long")}
    return rows.withColumns({names["output"]: output} | counts).select(*docs.columns, *names.values()), names
