"""Indexes of what entities are called: whole names and identifiers, phrases in questions, parts of names, and typos.

The first lookups filter the entities, which takes one scan and no exchange; what is asked more often, or for parts of names and typos,
gets tables that are written once, each when it is first needed. ``names`` has a row a (key, entity), its keys being identifiers as they are and names in small
letters with single blanks. ``grams`` has postings: pieces of three characters of names, for parts of names, and of two
characters of names, identifiers and their words, for typos. Rows lie in folders by a hash of the key or piece and are sorted within, so
that a lookup reads the folders and row groups of its keys.

A part of a name is within all names that hold its rarest piece and are verified. For typos, a similarity of 0.8 (twice the
characters in matching blocks by all characters) of texts with T characters in all means M = ceil(0.4 T) matching ones and at most
u = T - 2 M others, so u + 1 blocks at most, which keep M - u - 1 pieces of two characters whole. So many of a token's pieces
are met, and one of the rarest ones at least, however they are chosen: only postings of these are read, and what they
name is compared exactly. Empty names are not indexed, and an empty question finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import scalars as S
from loomgraph.storage import discard, written

BETWEEN = r"[\s?,;!\"()]+"  # separates the words of a name, and of a question
INDEX_AFTER = 20  # lookups of names that scan the entities, before these are indexed
SHOWN = ["node_key", "class", "pk", "name", "canonical"]


def normal(text: str) -> str:
    return " ".join(x for x in re.split(BETWEEN, text.lower()) if x)


def normal_column(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), BETWEEN, " "))


def pieces(text: Column, q: int) -> Column:
    """Distinct pieces of q characters; a shorter text is a piece itself."""
    many = F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substr(text, i, F.lit(q)))
    return F.array_distinct(F.when(F.length(text) >= q, many).otherwise(F.array(text)))


def shared_pieces(a: int, b: int) -> int:
    """Pieces of two characters that texts of these lengths share at least, if their similarity is 0.8 or more."""
    total = a + b
    m = ceil(round(0.4 * total, 6))
    return m - (total - 2 * m) - 1


def lengths(n: int) -> range:
    """Lengths of texts that can be that similar to one of n characters."""
    fits = [k for k in range(1, 2 * n + 2) if 2.0 * min(k, n) / (k + n) >= 0.8]
    return range(fits[0], fits[-1] + 1)


@dataclass
class TextIndex:
    ents: DataFrame
    per_part: int = 1 << 20
    looked_up: int = 0

    @cached_property
    def size(self) -> int:
        return self.ents.count()

    @cached_property
    def parts(self) -> int:
        return min(4096, max(8, self.size * 4 // self.per_part))

    @cached_property
    def longest(self) -> int:
        """Words of the longest name."""
        return named(self.ents).agg(F.max(F.size(F.split(normal_name(), " ")))).first()[0] or 0

    @cached_property
    def names(self) -> DataFrame:
        """key, kind (id or name), words, SHOWN, ord, part; written."""
        rows = keyed(self.ents).withColumns({"words": F.size(F.split("key", " ")), "part": part_of(F.col("key"), self.parts)})
        return written(rows.repartition("part", F.pmod(F.xxhash64("ord"), F.lit(4))).sortWithinPartitions("part", "key", "ord"), "names", "part")

    @cached_property
    def grams(self) -> DataFrame:
        """piece, kind (part or typo), unit, key (of names), ord, part; written."""
        # equal names, and equal words of them, are posted once for the first entity of the name
        first = named(self.ents).groupBy(normal_name().alias("key"), F.lower("name").alias("unit")).agg(F.min("ord").alias("ord"))
        of_parts = first.select(F.explode(pieces(F.col("unit"), 3)).alias("piece"), F.lit("part").alias("kind"), "unit", "key", "ord")
        words = lambda c: F.concat(F.array(F.lower(c)), F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: F.length(w) >= 3))
        units = named(self.ents).select(normal_name().alias("key"), "ord", F.explode(F.array_distinct(words(F.col("name")))).alias("unit"))
        units = units.unionByName(self.ents.select(F.col("pk").alias("key"), "ord", F.explode(F.array_distinct(words(F.col("pk")))).alias("unit")))
        of_typos = units.where(F.length("unit") >= 2).select(F.explode(pieces(F.col("unit"), 2)).alias("piece"), F.lit("typo").alias("kind"), "unit", "key", "ord")
        rows = of_parts.unionByName(of_typos).withColumn("part", part_of(F.col("piece"), self.parts))
        salts = max(16, self.size * 4 // self.per_part)  # a piece that all names have is as many rows as there are names
        return written(rows.repartition("part", F.pmod(F.xxhash64("key"), F.lit(salts))).sortWithinPartitions("part", "piece", "ord"), "grams", "part")

    def _at(self, table: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
        values = list(dict.fromkeys(values))
        if not values:
            return table.limit(0)
        return table.where(F.col("part").isin([part_of(F.lit(v), self.parts) for v in values]) & F.col(column).isin(values))

    def named(self, keys: Iterable[str]) -> DataFrame:
        """Rows of names and identifiers that equal a key, of the index."""
        return self._at(self.names, "key", keys)

    def called(self, keys: Iterable[str]) -> DataFrame:
        """The same, of the entities for the first lookups."""
        keys = list(dict.fromkeys(keys))
        self.looked_up += 1
        if self.looked_up > INDEX_AFTER or "names" in self.__dict__:
            return self.named(keys)
        some = F.col("pk").isin(keys) | F.col("node_key").isin(keys) | F.col("canonical").isin(keys) | normal_name().isin(keys)
        return keyed(self.ents.where(some) if keys else self.ents.limit(0)).where(F.col("key").isin(keys))

    def phrases(self, texts: Iterable[str], most: int = 8) -> dict[str, list[dict]]:
        """Entities that are called like a phrase, by normalised phrase; the first in entity order."""
        rows = self.called(texts).where("kind = 'name'")
        nth = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
        out: dict[str, list[dict]] = {}
        for r in rows.withColumn("nth", nth).where(F.col("nth") <= most).orderBy("key", "nth").collect():
            out.setdefault(r["key"], []).append({c: r[c] for c in SHOWN})
        return out

    def _staged(self, token: str) -> DataFrame:
        """Hits of the exact stages, once a stage: id (0), Class:name (1), name (2)."""
        cls, colon, rest = token.partition(":")
        rest = rest.strip()
        keys = [token, normal(token)] + ([rest, normal(rest)] if colon else [])
        low = F.lower(F.col("name"))
        stage = F.when((F.col("kind") == "id") & (F.col("key") == token), 0)
        if colon:
            stage = stage.when(F.lower("class").startswith(cls.strip().lower()) & ((low == rest.lower()) | (F.col("pk") == rest)), 1)
        stage = stage.when(low == token.lower(), 2)
        return self.called(keys).withColumn("stage", stage).where("stage IS NOT NULL").groupBy("stage", "ord", *SHOWN).agg(F.lit(1).alias("one"))

    def exact(self, token: str, most: int = 9) -> list[dict]:
        """Hits of the first exact stage that has any."""
        found = self._staged(token).orderBy("stage", "ord").limit(most).collect()
        return [{"stage": r["stage"]} | {c: r[c] for c in SHOWN} for r in found if r["stage"] == found[0]["stage"]]

    def exact_total(self, token: str) -> int:
        """How many entities the first exact stage has that has any."""
        first = self._staged(token).groupBy("stage").agg(F.count("*").alias("n")).orderBy("stage").first()
        return first["n"] if first else 0

    def _counts(self, kind: str, wanted: Iterable[str]) -> dict[str, int]:
        rows = self._at(self.grams, "piece", wanted).where(F.col("kind") == kind).groupBy("piece").agg(F.count("*").alias("n"))
        return {r["piece"]: r["n"] for r in rows.collect()}  # a row a piece of the token

    def _entities(self, keys: DataFrame) -> DataFrame:
        """Name rows of a few keys."""
        return self.called([r["key"] for r in keys.select("key").distinct().collect()]).where("kind = 'name'")

    def parts_of_names(self, text: str, most: int = 9) -> list[dict]:
        """The first entities whose name holds a text; texts of one or two characters, which are no pieces, are looked for in all names."""
        low = text.lower()
        verified = F.lower(F.col("name")).contains(low)
        if len(low) < 3:
            rows = named(self.ents).where(verified)
        else:
            wanted = {low[i : i + 3] for i in range(len(low) - 2)}
            n = self._counts("part", wanted)
            if len(n) < len(wanted):
                return []
            held = self._at(self.grams, "piece", [min(wanted, key=lambda g: (n[g], g))]).where((F.col("kind") == "part") & F.col("unit").contains(low))
            first = held.groupBy("key").agg(F.min("ord").alias("ord")).orderBy("ord").limit(most)  # of equal names the first stands for all, which follow
            rows = self._entities(first).where(verified)
        return [{c: r[c] for c in SHOWN} for r in rows.orderBy("ord").select(*SHOWN).limit(most).collect()]

    def rare_pieces(self, token: str) -> list[str]:
        """Pieces of which any text that is similar to the token has one at least."""
        own = [token[i : i + 2] for i in range(len(token) - 1)]
        n = self._counts("typo", own)
        least = min((shared_pieces(len(token), k) for k in lengths(len(token)) if k > 2), default=1)
        ranked = sorted(own, key=lambda g: (n.get(g, 0), g))[: len(own) - max(least, 1) + 1]
        # of two characters, a text may be the first and last of three
        return [g for g in dict.fromkeys(ranked + ([token[0] + token[2]] if len(token) == 3 else [])) if n.get(g, 0) or len(token) == 3]

    def typos(self, token: str, most: int = 8) -> list[dict]:
        """The most similar entities by a name, an identifier or a word of them, at 0.8 or more, the closest first."""
        low, fits = token.lower(), lengths(len(token))
        held = self._at(self.grams, "piece", self.rare_pieces(low)).where((F.col("kind") == "typo") & F.length("unit").between(fits[0], fits[-1]))
        units = written(held.select("unit", "key", "ord").distinct(), "typo-units")
        close = units.select("unit").distinct().withColumn("ratio", S.typo_ratio(low)(F.col("unit"), F.lit(None).cast("string"))).where("ratio >= 0.8")
        best = units.join(close, "unit").groupBy("ord").agg(F.max(F.struct("ratio", "key")).alias("b")).orderBy(F.desc("b.ratio"), "ord").limit(most)
        at = {(r["b"]["key"], r["ord"]): i for i, r in enumerate(best.collect())}
        discard(units)
        rows = self.called([k for k, _ in at]).select("key", "ord", *SHOWN).collect()
        found = {at[r["key"], r["ord"]]: {c: r[c] for c in SHOWN} for r in rows if (r["key"], r["ord"]) in at}
        return [found[k] for k in sorted(found)]


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def normal_name() -> Column:
    return normal_column(F.col("name"))


def named(ents: DataFrame) -> DataFrame:
    """Entities that have a name."""
    return ents.where(F.col("name").isNotNull() & (normal_name() != ""))


def keyed(ents: DataFrame) -> DataFrame:
    """(key, kind, SHOWN, ord): a row an identifier and a name of each entity."""
    keys = F.array_distinct(F.array("pk", "node_key", "canonical"))
    ids = ents.select(F.explode(keys).alias("key"), F.lit("id").alias("kind"), *SHOWN, "ord")
    return ids.unionByName(named(ents).select(normal_name().alias("key"), F.lit("name").alias("kind"), *SHOWN, "ord"))


def text_index(ents: DataFrame, per_part: int = 1 << 20) -> TextIndex:
    """The index of all entities; those without a name are found by their identifiers."""
    return TextIndex(ents, per_part)
