"""Entities, canonical identities and node keys; resolving tokens to entities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import scalars as S
from loomgraph.sources.workbook import ORD, Sheet, Workbook

from .textindex import TextIndex, text_index


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def sheet_entities(wb: Workbook, s: Sheet) -> DataFrame:
    head = wb.header(s.name)
    text = lambda c: quoted(c).cast("string") if c else F.lit(None).cast("string")
    pairs = [x for c in head for x in (F.lit(c), text(c))]
    evidence = text(s.evidence)
    return wb.rows(s.name).select(
        F.lit(s.name).alias("class"),
        text(s.pk).alias("pk"),
        text(s.label if s.label != s.pk else None).alias("name"),
        evidence.alias("evidence"),
        S.has_evidence(evidence).alias("has_evidence"),
        F.lit(s.execution).alias("in_execution"),
        F.lit(s.lifecycle).alias("has_lifecycle"),
        F.create_map(*pairs).alias("metadata"),
        F.struct(F.lit(s.ix).alias("sheet"), F.col(ORD).alias("row")).alias("ord"),
    )


def entities(wb: Workbook) -> DataFrame:
    """All owner rows: node_key, class, pk, name, canonical, evidence, flags, metadata, ord.

    The node key is the pk where only one class has it, else the canonical key. Of rows that repeat a pk within a class
    the first is the entity.
    """
    parts = [sheet_entities(wb, s) for s in wb.owners()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = Window.partitionBy("pk", "class").orderBy("ord")
    # one exchange serves both windows: rows of a key are together, whatever their class
    out = out.where(F.col("pk").isNotNull()).repartition("pk").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    out = out.withColumn("canonical", S.canonical_key(F.col("class"), F.col("pk")))
    alone = F.count("*").over(Window.partitionBy("pk")) == 1
    return out.withColumn("node_key", F.when(alone, F.col("pk")).otherwise(F.col("canonical")))


def node_keys(ents: DataFrame) -> DataFrame:
    return ents.select("class", "pk", "node_key")


def collisions(ents: DataFrame) -> DataFrame:
    """pks that several classes hold: (pk, n_classes, classes)."""
    return ents.groupBy("pk").agg(F.count("*").alias("n_classes"), F.array_sort(F.collect_set("class")).alias("classes")).where("n_classes > 1")


def classes_for_pk(ents: DataFrame, pk: str) -> DataFrame:
    return ents.where(F.col("pk") == pk).select("class", "node_key", "canonical")


def pk_schema(ents: DataFrame, first: int = 50) -> DataFrame:
    """(class, shape): numeric, prefixed, composite, opaque or empty, by the first pks of each class."""
    nth = F.row_number().over(Window.partitionBy("class").orderBy("ord"))
    head = ents.where(F.col("pk") != "").withColumn("nth", nth).where(F.col("nth") <= first)
    every = lambda c: F.bool_and(c)
    shape = (
        F.when(every(F.col("pk").rlike(r"^[+-]?\d+(\.\d+)?$")), "numeric")
        .when(every(F.col("pk").rlike(r"^[A-Za-z]+-\w+")), "prefixed")
        .when(every(F.col("pk").rlike(r"[|/:+]")), "composite")
        .otherwise("opaque")
    )
    return ents.select("class").distinct().join(head.groupBy("class").agg(shape.alias("shape")), "class", "left").select("class", F.coalesce("shape", F.lit("empty")).alias("shape"))


def list_entities(ents: DataFrame, prefix: str) -> DataFrame:
    """Entities whose pk has this text before its first hyphen."""
    return ents.where(S.id_prefix(F.col("pk")) == prefix.upper()).select("pk", "class", "name", "ord")


def resolve_pk(ents: DataFrame, pk: str) -> DataFrame:
    return ents.where(F.col("pk") == pk)


@dataclass
class Resolution:
    how: str
    found: list[dict]  # the first of them
    total: int | None = None  # how many an exact stage has; of others, those found

    def __post_init__(self):
        self.total = len(self.found) if self.total is None else self.total

    @property
    def one(self) -> dict | None:
        return self.found[0] if len(self.found) == 1 and not self.how.startswith("ambiguous") and self.how not in ("fuzzy", "typo", "unresolved") else None


def resolve(ents: DataFrame, token: str, promoted: DataFrame | Callable[[], DataFrame] | None = None, most: int = 8, loosely: bool = True, index: TextIndex | None = None) -> Resolution:
    """Stages in order, the first with a hit decides: id, Class:name, name, promoted value, part of a name, typo.

    Several hits of an exact stage make the token ambiguous. Of typos the closest come first. Without ``loosely`` the exact stages
    only. An index of the entities answers what it can; it is built for the question if none is given. Promoted values may be
    given by a function, which is called if no exact stage has a hit.
    """
    t = token.strip()
    low = t.lower()
    index = index or text_index(ents)
    found = index.exact(t, most + 1)
    if found:
        one, several = (("id", "ambiguous_id"), ("class_name", "ambiguous_name"), ("name", "ambiguous_name"))[found[0].pop("stage")]
        for x in found[1:]:
            del x["stage"]
        return Resolution(one if len(found) == 1 else several, found[:most], index.exact_total(t) if len(found) > most else None)
    if callable(promoted):
        promoted = promoted()
    if promoted is not None:
        hit = promoted.where((F.lower("value") == low) | (F.col("promoted_id") == t)).select("promoted_id", "registry", "col", "value").limit(1).collect()
        if hit:
            r = hit[0]
            return Resolution("promoted", [{"node_key": r["promoted_id"], "class": f"{r['registry']}.{r['col']}", "pk": r["promoted_id"], "name": r["value"], "canonical": r["promoted_id"]}])
    if low and loosely:
        if held := index.parts_of_names(low, most):
            return Resolution("fuzzy", held)
        if len(low) >= 3 and (close := index.typos(t, most)):
            return Resolution("typo", close)
    return Resolution("unresolved", [])


def reference_lookup(wb: Workbook, value: str, but: str | None = None) -> DataFrame:
    """Rows of other sheets that have a cell equal to the value: (sheet, row, col)."""
    return wb.hits(value, [s for s in wb.frames if s != but]).select("sheet", "row", "col")


def evidence_jump(ents: DataFrame, wb: Workbook, pk: str) -> DataFrame:
    """(class, pk, col, value, cell_count): the row's columns that point at sources, and how often the id occurs in cells."""
    n = wb.hits(pk).count()
    row = resolve_pk(ents, pk).select("class", "pk", F.explode("metadata").alias("col", "value"))
    return row.where(F.lower("col").rlike("evidence|source|cell|ref|sheet|row")).withColumn("cell_count", F.lit(n))
