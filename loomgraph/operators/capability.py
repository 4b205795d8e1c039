"""The menu of an entity: every action that it allows, with what it is based on.

Actions come from five places: what the entity is, its edges, the ways that lead on from its class, the columns of its row,
and what can be asked of any entity. An action's identity is its source, key and target, never its label; actions of one
identity are merged by one aggregate (available if any is, the largest count and confidence, all else from the first), and
numbered in the order of the menu.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import compare, graph
from .adjacency import Adjacency

# By source of an action its provenance, the stage that discovered it, its capability, and what is its evidence.
SOURCES = {
    "attribute": ("scalar_attribute", "SchemaDiscovery", "Identity", "owner registry row"),
    "relation_direct": ("foreign_key", "RelationshipDiscovery", "Relationships", "Relationship (Universal Property Graph)"),
    "relation_discovered": ("reachability", "ReachabilityDiscovery", "Relationships", None),
    "neighbors": ("derived_relation", "RelationshipDiscovery", "Relationships", "Universal Property Graph"),
    "meta": ("scalar_attribute", "SchemaDiscovery", "Evidence", "owner registry row"),
    "analysis": ("analysis", "AnalysisDiscovery", "Analysis", "graph + registry (derived)"),
    "promoted": ("promoted_entity", "SemanticPromotion", "Identity", None),
}
# Columns whose names hold one of these are evidence, no attributes.
NO_ATTRIBUTE = ("evidence", "source", "reference", "citation")
ACTION = ["place", "canonical_source", "canonical_key", "target", "label", "query", "relation", "mode", "count", "available", "reason", "capability", "confidence", "evidence"]


def text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def entry(rows: DataFrame, stage: int, source: str, *, key: Column, label: Column, query: str, mode: str, count: Column, nth: Column | None = None, target: Column | None = None, relation: Column | None = None, reason: str | None = None, capability: str | None = None, confidence: Column | None = None, evidence: Column | None = None) -> DataFrame:
    """Actions from rows; without a count of more than 0 (or below, for unknown) they aren't available, for a reason."""
    n = F.coalesce(count.cast("long"), F.lit(0).cast("long"))
    available = n != 0
    known = text(SOURCES[source][3]) if evidence is None else evidence
    return rows.select(
        F.struct(F.lit(stage).alias("stage"), (nth if nth is not None else F.lit(0)).cast("long").alias("nth")).alias("place"),
        F.lit(source).alias("canonical_source"), key.alias("canonical_key"), (text(None) if target is None else target).alias("target"), label.alias("label"),
        F.lit(query).alias("query"), (text(None) if relation is None else relation).alias("relation"), F.lit(mode).alias("mode"), n.alias("count"), available.alias("available"),
        F.when(~available, text(reason)).alias("reason"), F.lit(capability or SOURCES[source][2]).alias("capability"),
        (F.when(available, 1.0).otherwise(0.0) if confidence is None else confidence).alias("confidence"),
        F.when(~available & F.lit(reason is not None), text(reason)).otherwise(known).alias("evidence"),
    )


def title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def relation_actions(near: DataFrame, into: DataFrame) -> DataFrame:
    """One action a relation; one of which the incoming edges come from several classes is one for each of these."""
    several = near.where("dir = 'in'").groupBy("rel").agg((F.countDistinct("other_class") > 1).alias("several"))
    rows = near.join(several, "rel", "left").withColumn("split", F.when((F.col("dir") == "in") & F.coalesce("several", F.lit(False)), F.col("other_class")))
    groups = rows.groupBy("rel", "split").agg(F.count("*").alias("n"), F.min("step").alias("first"))
    targets = into.groupBy("rel").agg(F.array_join(F.array_sort(F.collect_set("dst_class")), ",").alias("targets"))
    groups = groups.join(targets, "rel", "left").withColumn("nth", F.row_number().over(Window.orderBy("first")))  # a row a relation
    key = F.when(F.col("split").isNull(), F.col("rel")).otherwise(F.concat("rel", F.lit("::"), "split"))
    label = F.when(F.col("split").isNull(), title(F.col("rel"))).otherwise(F.concat(title(F.col("rel")), F.lit(" ← "), "split"))
    return entry(groups, 1, "relation_direct", key=key, label=label, query="REL", relation=key, mode="direct", count=F.col("n"), nth=F.col("nth"), target=F.coalesce("split", "targets"))


def discovered_actions(near: DataFrame, reach: DataFrame, cls: str) -> DataFrame:
    """The last relations of ways from the class that the entity has no edges of; the first way by its target class."""
    ways = reach.where(F.col("source_class") == cls).withColumn("rel", F.element_at("relation_pattern", -1))
    first = ways.groupBy("rel").agg(F.min_by(F.struct("target_class", "relation_pattern", "hops", "confirmed", "candidates"), "target_class").alias("w"))
    rows = first.join(near.select("rel").distinct(), "rel", "left_anti").withColumn("nth", F.row_number().over(Window.orderBy("rel")))  # a row a relation
    how = F.concat(F.array_join("w.relation_pattern", " -> "), F.lit(" ("), F.col("w.confirmed").cast("string"), F.lit("/"), F.col("w.candidates").cast("string"), F.lit(")"))
    share = F.when(F.col("w.candidates") > 0, F.bround(F.col("w.confirmed") / F.col("w.candidates"), 3)).otherwise(0.5)
    return entry(rows, 2, "relation_discovered", key=F.col("rel"), label=title(F.col("rel")), query="REL", relation=F.col("rel"), mode="discovered", count=F.lit(-1), nth=F.col("nth"), target=F.col("w.target_class"), confidence=share, evidence=how)


def attribute_actions(one: DataFrame, header: list[str], taken: DataFrame) -> DataFrame:
    """One action a filled column of the row but the first two, evidence, and columns called like a relation of the menu."""
    wanted = [(i, c) for i, c in enumerate(header[2:], 2) if not any(x in c.lower() for x in NO_ATTRIBUTE)]
    columns = one.sparkSession.createDataFrame(wanted, "nth int, col string")
    cells = one.select(F.explode("metadata").alias("col", "value")).where("value <> ''").join(F.broadcast(columns), "col")  # a row a column
    cells = cells.join(taken.select(F.lower("rel").alias("low")).distinct(), F.lower("col") == F.col("low"), "left_anti")
    return entry(cells, 3, "attribute", key=F.col("col"), label=F.col("col"), query="ASK", relation=F.col("col"), mode="fixed", count=F.lit(1), nth=F.col("nth"), capability="Attributes")


def merged(actions: DataFrame) -> DataFrame:
    """Actions of one identity as one, numbered."""
    identity = F.concat_ws("::", "canonical_source", "canonical_key", F.coalesce("target", F.lit("")))
    rest = [c for c in ACTION if c not in ("count", "available", "confidence")]
    rows = actions.withColumn("id", identity).groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("place", "label")).alias("a"), F.bool_or("available").alias("available"), F.max("count").alias("count"), F.max("confidence").alias("confidence"))
    rows = rows.withColumn("key", F.row_number().over(Window.orderBy("a.place", "id")))  # a row an action of one entity
    known = F.broadcast(actions.sparkSession.createDataFrame([(k, v[0], v[1]) for k, v in SOURCES.items()], "canonical_source string, provenance string, discovery_stage string"))
    rows = rows.select("key", "id", *(F.col(f"a.{c}").alias(c) for c in rest if c != "place"), "count", "available", "confidence")
    return rows.join(known, "canonical_source").select("key", "id", "canonical_source", "canonical_key", "target", "label", "query", "relation", "mode", "count", "available", "reason", "provenance", "discovery_stage", "capability", "confidence", "evidence")


def menu(e: DataFrame | Adjacency, ents: DataFrame, reach: DataFrame, into: DataFrame, node: str, cls: str, header: list[str]) -> DataFrame:
    """All actions of an entity: number, identity and its parts, label, query, count (-1: unknown), availability, and provenance."""
    one = ents.where(F.col("node_key") == node)
    near = graph.neighbors(e, node)
    number = lambda rows: rows.agg(F.count("*").alias("n"))
    layer = number(ents.where((F.col("class") == cls) & (F.col("node_key") != node)))
    row = one.select((F.col("class") != "").cast("int").alias("is"), (F.coalesce(F.length("name"), F.lit(0)) > 0).cast("int").alias("named"), (F.coalesce(F.length("evidence"), F.lit(0)) > 0).cast("int").alias("proved"), F.size("metadata").alias("cells"))
    direct, far = relation_actions(near, into), discovered_actions(near, reach, cls)
    taken = near.select("rel").unionAll(far.select(F.col("canonical_key").alias("rel")))

    def fixed(rows: DataFrame, stage: int, source: str, key: str, label: str, query: str, n: Column, reason: str | None = None, nth: int = 0, mode: str = "fixed") -> DataFrame:
        return entry(rows, stage, source, key=F.lit(key), label=F.lit(label), query=query, mode=mode, count=n, reason=reason, nth=F.lit(nth))

    parts = [
        fixed(row, 0, "attribute", "class", "What is", "WHAT_IS", F.col("is")),
        fixed(row, 0, "attribute", "name", "Name", "GET_NAME", F.col("named"), "No name recorded.", 1),
        direct, far, attribute_actions(one, header, taken),
        fixed(number(near), 4, "neighbors", "*", "Neighbors", "GET_NEIGHBORS", F.col("n"), "No relationships documented."),
        fixed(row, 4, "meta", "evidence", "Evidence", "GET_EVIDENCE", F.col("proved"), "No evidence documented.", 1),
        fixed(row, 4, "meta", "source_row", "Source row", "GET_SOURCE_ROW", F.col("cells"), "No source row found.", 2),
        fixed(row, 5, "analysis", "ANALYZE_ENTITY", "Analyze this entity", "ANALYZE_ENTITY", F.lit(1), None, 0, "analysis"),
        fixed(number(compare.siblings(e, node)), 5, "analysis", "COMPARE_SIBLINGS", "Compare with siblings", "COMPARE_SIBLINGS", F.col("n"), "No siblings share a direct parent.", 1, "analysis"),
        fixed(layer, 5, "analysis", "COMPARE_LAYER", "Compare with layer", "COMPARE_LAYER", F.col("n"), "No other entities in this registry.", 2, "analysis"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return merged(out)
