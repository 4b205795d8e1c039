"""Audit of how the sources of a language differ in their words, by distinct count columns.

A term's column of counts by source is the same for very many terms (most are rare). Terms are therefore grouped by their
sparse vector of (source, count); every ordered pair of sources is evaluated once for each distinct vector, and the value
is multiplied by the number of terms that have it. The terms themselves are only ranked. All numbers are whole.

With count occurrences of a term in a group, N those of all kept terms and V kept terms, p = 1 + floor(10^9 (count + 1) / (N + V)),
and a pair's value for a term is floor((p - q)^2 / q), summed over all V terms for ``pair``. A sum is at most (10^9 + V)^2,
which fits a long as long as a language keeps fewer than 2 * 10^9 terms.

Nulls in text, language or source are empty strings, which are a language and a source like others. Texts without a term and
empty texts make a group, but no terms; a language without kept terms has pairs of value 0. Repeated rows are documents of
their own, ids are not looked at, ties go to the lesser item by its UTF-8 bytes, and an empty table gives no rows.
Other columns are ignored. A long text is counted in pieces of a megabyte.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import small, text_or_empty, written

SCALE = 1_000_000_000
CELLS = 1 << 20  # numbers in a block of vectors
TILE = 256  # sources of a block that one row of work evaluates against all others
HELD = 400_000  # counted terms that a task holds before it passes them on
# every byte of a term is an ASCII letter or part of a longer character; all others separate
_table = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, in lists that end between terms."""
    clean, start = text.translate(_table), 0
    while start < len(clean):
        end = clean.find(b" ", start + size)
        end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of documents (lang, source, text); counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_of) in held.items():
                terms = list(n)
                for i in range(0, len(terms), 50_000):
                    part = terms[i : i + 50_000]
                    columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([n[t] for t in part], pa.int64()), pa.array([docs_of[t] for t in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, docs_of = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for some in words(text.as_py().encode()):
                    n.update(some)
                    seen.update(some)
                docs_of.update(seen)
                if sum(len(x) for x, _ in held.values()) > HELD:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), by decimals that hold any long."""
    of = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.call_function("div", of(count + 1, 20) * F.lit(SCALE).cast("decimal(10,0)"), of(total, 20)) + 1


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same on arrays: a long division, three decimal digits at a time, within 64 bits for totals below 9 * 10^15."""
    out, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def evaluated(sources: list[str], totals: np.ndarray, source: pa.Array, count: np.ndarray, ends: np.ndarray, often: np.ndarray, tile: range) -> np.ndarray:
    """value[a, b] of the tile's sources a against all b: each vector once, times the number of its terms."""
    p = np.repeat(shares(np.zeros(len(sources), np.int64), totals)[None, :], len(often), 0)
    at = pc.index_in(source, pa.array(sources, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(often)), np.diff(ends, prepend=0))
    p[row, at] = shares(count, totals[at])
    out = np.zeros((len(tile), len(sources)), np.int64)
    for i, a in enumerate(tile):
        d = p[:, a : a + 1] - p
        d *= d
        out[i] = (d // p * often[:, None]).sum(0)
    return out


def pair_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value) of blocks (lang, tile, groups, v, vectors)."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang, tile, groups, v, vectors = (c[i] for c in batch.columns)
            sources = groups.values.field("source").to_pylist()
            totals = groups.values.field("total").to_numpy() + v.as_py()
            cells = vectors.values.field("vec")
            ends = pc.cumulative_sum(pc.list_value_length(cells)).to_numpy().astype(np.int64)
            flat = cells.flatten()
            asked = range(tile.as_py() * TILE, min(len(sources), (tile.as_py() + 1) * TILE))
            value = evaluated(sources, totals, flat.field("source"), flat.field("n").to_numpy(), ends, vectors.values.field("often").to_numpy(), asked)
            for k, a in enumerate(asked):
                names = pa.array(sources, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(sources), pa.string()), pa.array([sources[a]] * len(sources), pa.string()), names, pa.array(value[k])], names=["lang", "source", "item", "value"])


def audit(docs: DataFrame, least_docs: int = 3, most_terms: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by ``pair``, terms by ``term``, most divergent first."""
    docs = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec"), F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    kept = written(by_term.where(F.col("docs") >= least_docs).select("lang", "term", "vec", "n"), "divergence-terms")
    totals = kept.select("lang", F.explode("vec").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    groups = written(groups, "divergence-groups")
    langs = groups.groupBy("lang").agg(F.count("*").alias("s"), F.sum("total").alias("lang_total")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang")
    langs = written(langs, "divergence-langs")
    n_groups, n_langs = groups.count(), langs.count()

    # a block is so many distinct vectors that it has some `cells` numbers; a row of work is a block and a tile of sources
    vectors = kept.groupBy("lang", "vec").agg(F.count("*").alias("often")).join(small(langs.select("lang", "s", "v"), n_langs), "lang")
    block = F.pmod(F.xxhash64("vec"), F.ceil(F.col("v") * F.col("s") / cells))
    blocks = vectors.groupBy("lang", "v", "s", block.alias("block")).agg(F.collect_list(F.struct("vec", "often")).alias("vectors"))
    of_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups"))
    work = blocks.join(small(of_lang, n_groups), "lang").withColumn("tile", F.explode(F.sequence(F.lit(0), F.floor((F.col("s") - 1) / TILE).cast("int"))))
    values = work.select("lang", "tile", "groups", "v", "vectors").mapInArrow(pair_values, "lang string, source string, item string, value long")
    values = values.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(small(groups.select("lang", F.col("source").alias("item")), n_groups), "lang").where("source <> item")
    pairs = pairs.join(values, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    terms = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("vec").alias("x")).select("lang", "term", "lang_n", "x.source", "x.n")
    terms = terms.join(small(groups, n_groups), ["lang", "source"]).join(small(langs, n_langs), "lang")
    terms = terms.select("lang", "source", "term", share(F.col("n"), F.col("total") + F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total") + F.col("v")).alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= most_terms))
