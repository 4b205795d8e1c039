"""Comparing entities by their outgoing relations, and the scopes they are compared within."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import written

from . import graph
from .adjacency import Adjacency


def dimensions(e: DataFrame | Adjacency, node: str) -> DataFrame:
    """(rel, dst): outgoing targets by relation."""
    return graph.neighbors(e, node, "out").select("rel", F.col("other").alias("dst"), F.col("other_class").alias("dst_class")).distinct()


def sharing(e: DataFrame | Adjacency, node: str) -> DataFrame:
    """(node, rel, dst): what has an edge of the same relation to the same target, by target; repeated edges stay."""
    mine = graph.neighbors(e, node, "out").select("rel", F.col("other").alias("node")).distinct()
    rows = graph.met(e, mine, "in", "rel").where(F.col("via") == F.col("rel")).where(F.col("other") != node)
    return rows.select(F.col("other").alias("node"), "rel", F.col("node").alias("dst"))


def siblings(e: DataFrame | Adjacency, node: str) -> DataFrame:
    """(node): what has an edge of the same relation to the same target."""
    return sharing(e, node).select("node").distinct()


def unlike(own: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """(rel, n_targets): relations of an entity, by its targets (rel, dst), none of which all its n siblings have; shared is :func:`sharing`, each row once."""
    common = shared.groupBy("rel", "dst").agg(F.count("*").alias("have")).where(F.col("have") == n).select("rel").distinct()
    return own.groupBy("rel").agg(F.countDistinct("dst").alias("n_targets")).join(common, "rel", "left_anti")


def scope(e: DataFrame | Adjacency, ents: DataFrame, node: str, kind: str) -> DataFrame:
    """(node): the same class (layer), direct targets (downstream), direct sources (upstream), or sharers of a relation's target (siblings)."""
    if kind == "layer":
        cls = ents.where(F.col("node_key") == node).select("class")
        return ents.join(cls, "class", "left_semi").where(F.col("node_key") != node).select(F.col("node_key").alias("node"))
    if kind == "downstream":
        return graph.neighbors(e, node, "out").select(F.col("other").alias("node")).distinct()
    if kind == "upstream":
        return graph.neighbors(e, node, "in").select(F.col("other").alias("node")).distinct()
    if kind == "siblings":
        return siblings(e, node)
    return ents.where(F.col("node_key") == kind).select(F.col("node_key").alias("node"))


def compare_pair(e: DataFrame | Adjacency, a: str, b: str) -> DataFrame:
    """(rel, n_common, n_left, n_right, status): common if the targets agree, different if both have some, else missing."""
    left = dimensions(e, a).select("rel", "dst", F.lit(1).alias("l"))
    right = dimensions(e, b).select("rel", "dst", F.lit(1).alias("r"))
    rows = left.join(right, ["rel", "dst"], "full_outer")
    count = lambda c: F.count_if(c).alias
    out = rows.groupBy("rel").agg(count(F.col("l").isNotNull() & F.col("r").isNotNull())("n_common"), count(F.col("r").isNull())("n_left"), count(F.col("l").isNull())("n_right"))
    status = F.when((F.col("n_left") == 0) & (F.col("n_right") == 0), "common").when((F.col("n_common") + F.col("n_left") > 0) & (F.col("n_common") + F.col("n_right") > 0), "different").otherwise("missing")
    return out.withColumn("status", status)


def compare_group(e: DataFrame | Adjacency, node: str, others: DataFrame) -> DataFrame:
    """(rel, dst, shared): the node's targets, and whether all others (column node) have them as well."""
    others = written(others.select("node").distinct(), "others")
    n = others.count()
    mine = dimensions(e, node).select("rel", "dst")
    have = graph.met(e, others, "out").select(F.col("node").alias("src"), "rel", F.col("other").alias("dst")).distinct().groupBy("rel", "dst").agg(F.count("*").alias("have"))
    return mine.join(have, ["rel", "dst"], "left").select("rel", "dst", (F.coalesce("have", F.lit(0)) == n).alias("shared"))
