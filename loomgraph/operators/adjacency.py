"""Adjacency by both ends, and searches over it.

An edge is stored at both of its ends, so that incoming and outgoing hops prune alike. A row is a block: a node, a side
(0: outgoing, 1: incoming) and up to some thousand of its edges there in their order; a hub has many blocks, which are read
and joined apart. Blocks lie in parts by a hash of the node, which are folders, and are sorted by node within them: a hop from
few nodes reads the parts and row groups of these, one from many is a join of the frontier with blocks, not with edges.

Searches go level by level; each level is written, so that lost executors cost one level. A node is in a frontier once, and
its parent is the first-found by a queue: a place in the queue is that of the parent and the edge's order (outgoing before
incoming), an array that grows by a step a level. What was reached is kept in few tables, which are merged as levels add up,
so that a level's plan doesn't grow with its depth. A path between two nodes is searched from both ends, the frontier of
fewer edges first, which leaves the surroundings of a hub in the middle alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.storage import discard, written

FEW = 200  # so many nodes of a frontier, or fewer, are looked up by their keys
SEGMENTS = 6  # tables that hold what a search reached
SIDES = {"out": (0,), "in": (1,), "both": (0, 1)}
TURNED = {"out": "in", "in": "out", "both": "both"}


@dataclass(frozen=True)
class Adjacency:
    frame: DataFrame  # node, side, block, edges, part
    parts: int

    @property
    def sparkSession(self) -> SparkSession:  # noqa: N802 - as a DataFrame has it
        return self.frame.sparkSession

    def part(self, node: Column) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(self.parts)).cast("int")


def adjacency(e: DataFrame, per_part: int = 1 << 20, per_block: int = 1024) -> Adjacency:
    """Blocks of edges (src, rel, dst, src_class, dst_class, evidence, flow, ord) at both ends, written."""
    side = lambda a, b, n: F.struct(F.lit(n).alias("side"), F.col(a).alias("node"), F.struct("ord", F.col(b).alias("other"), "rel", "evidence", "flow", F.col(f"{b}_class").alias("other_class")).alias("edge"))
    rows = e.select(F.explode(F.array(side("src", "dst", 0), side("dst", "src", 1))).alias("x")).select("x.*")
    parts = min(4096, max(8, 2 * e.count() // per_part))
    ends = e.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("src").alias("node")), F.struct(F.lit(1).alias("side"), F.col("dst").alias("node")))).alias("x")).select("x.*")
    hubs = written(ends.groupBy("node", "side").agg(F.count("*").alias("n")).where(F.col("n") > per_block), "hubs")  # a row per_block edges at most
    cut = F.coalesce(F.pmod(F.xxhash64("edge"), F.ceil(F.col("n") / per_block)), F.lit(0)).cast("int")
    rows = rows.join(hubs, ["node", "side"], "left").select("node", "side", cut.alias("block"), "edge", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("part"))
    # edges are exchanged once: what is grouped afterwards is together already
    rows = rows.withColumn("spread", F.pmod(F.col("block"), F.lit(64))).repartition("part", "spread")
    blocks = rows.groupBy("part", "spread", "node", "side", "block").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    frame = blocks.select("node", "side", "block", "edges", "part").sortWithinPartitions("part", "node", "side", "block")
    return Adjacency(written(frame, "adjacency", "part"), parts)


def exploded(blocks: DataFrame, *keep: str) -> DataFrame:
    """Edges of blocks as (node, other, rel, dir, evidence, flow, other_class, step) and what else the blocks carry."""
    rows = blocks.select("node", "side", *keep, F.explode("edges").alias("x"))
    return rows.select("node", "x.other", "x.rel", F.when(F.col("side") == 0, "out").otherwise("in").alias("dir"), "x.evidence", "x.flow", "x.other_class", F.struct("side", "x.ord").alias("step"), *keep)


def blocks_of(adj: Adjacency, direction: str = "both", nodes: Iterable[str] | None = None) -> DataFrame:
    """Blocks of a direction, of the nodes alone if there are any given: parts and row groups of others aren't read."""
    rows = adj.frame if direction == "both" else adj.frame.where(F.col("side") == SIDES[direction][0])
    if nodes is not None:
        nodes = list(nodes)
        rows = rows.where(F.col("part").isin([adj.part(F.lit(n)) for n in nodes]) & F.col("node").isin(nodes)) if nodes else rows.limit(0)
    return rows


def edges_at(adj: Adjacency, nodes: Iterable[str], direction: str = "both") -> DataFrame:
    return exploded(blocks_of(adj, direction, nodes))


def few(frontier: DataFrame) -> list[str] | None:
    """The nodes of a frontier that has few rows, none if it is empty; None of a larger one."""
    rows = frontier.select("node").limit(FEW + 1).collect()
    return None if len(rows) > FEW else sorted({r["node"] for r in rows})


def met(adj: Adjacency, frontier: DataFrame, nodes: list[str] | None, direction: str, *keep: str) -> DataFrame:
    """Edges that a frontier (node, and columns to keep) meets; nodes are :func:`few` of it."""
    return exploded(blocks_of(adj, direction, nodes).join(frontier.select("node", *keep), "node"), *keep)


def edges_ahead(adj: Adjacency, frontier: DataFrame, nodes: list[str] | None, direction: str) -> int:
    """Edges that a frontier of few nodes would meet; of more, that there is one each at least."""
    if nodes is None:
        return frontier.count()
    return blocks_of(adj, direction, nodes).agg(F.sum(F.size("edges"))).first()[0] or 0


def place(step: str = "step") -> Column:
    """The next place in a queue: that of the parent, then the edge's order."""
    return F.concat("qpos", F.array(F.col(f"{step}.side"), F.col(f"{step}.ord.sheet"), F.col(f"{step}.ord.row"), F.col(f"{step}.ord.nth")).cast("array<bigint>"))


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def bfs(adj: Adjacency, seeds: DataFrame, direction: str = "both", max_hops: int = 6, paths: bool = False, stop: Column | None = None) -> DataFrame:
    """(origin, node, hop, node_class[, parent, rel, dir, evidence, qpos]) of everything reached from (origin, node) seeds, seeds at hop 0.

    With ``paths`` each node keeps its first-found parent and the edge to it. ``stop`` is a condition on the
    result's columns that ends the search when a level satisfies it.
    """
    extra = ["parent", "rel", "dir", "evidence", "qpos"] if paths else []
    null = lambda t: F.lit(None).cast(t)
    start = seeds.select("origin", "node").distinct().withColumns({"hop": F.lit(0), "node_class": null("string")})
    if paths:
        start = start.withColumns({"parent": null("string"), "rel": null("string"), "dir": null("string"), "evidence": null("string"), "qpos": F.array().cast("array<bigint>")})
    columns = ["origin", "node", "hop", "node_class", *extra]
    frontier = written(start.select(*columns), "bfs-0")
    kept, nodes = [frontier], few(frontier)
    for hop in range(1, max_hops + 1):
        near = met(adj, frontier, nodes, direction, "origin", *(["qpos"] if paths else []))
        if paths:
            first = F.min(F.struct(place().alias("qpos"), F.col("node").alias("parent"), "rel", "dir", "evidence", F.col("other_class").alias("node_class"))).alias("first")
            level = near.groupBy("origin", F.col("other").alias("node")).agg(first).select("origin", "node", F.lit(hop).alias("hop"), *(f"first.{c}" for c in ("node_class", *extra)))
        else:
            level = near.groupBy("origin", F.col("other").alias("node")).agg(F.lit(hop).alias("hop"), F.min("other_class").alias("node_class"))
        level = level.join(union(kept).select("origin", "node"), ["origin", "node"], "left_anti")
        frontier = written(level.select(*columns), f"bfs-{hop}")
        nodes = few(frontier)
        if nodes == []:
            discard(frontier)
            break
        kept.append(frontier)
        if len(kept) > SEGMENTS:
            merged = written(union(kept), f"bfs-to-{hop}")
            discard(*kept)
            kept, frontier = [merged], merged.where(F.col("hop") == hop)
        if stop is not None and not frontier.where(stop).isEmpty():
            break
    return union(kept)


@dataclass
class Found:
    """A shortest path, hop by hop, and how many nodes were reached from each end before it was known."""

    path: list[dict] | None
    forward: int = 0
    backward: int = 0


def two_ended(adj: Adjacency, source: str, target: str, max_depth: int = 6, direction: str = "both") -> Found:
    """The first-found shortest path of a queue search from the source, by two searches that meet.

    The level that has fewer edges ahead goes on. Levels of the source's side keep places in the queue, so that of the nodes at which
    both meet the first by its place is on the path. Levels of the target's side keep each node's first edge that leads
    nearer, which is what the queue would take from there. A level's nodes are met once, so the path is that of one search.
    """
    spark = adj.sparkSession
    if source == target:
        return Found([], 1, 1)
    edge = "rel string, dir string, evidence string"
    ahead = [written(spark.createDataFrame([(source, None, None, None, None, [])], f"node string, parent string, {edge}, qpos array<long>"), "path-f")]
    back = [written(spark.createDataFrame([(target, None, None, None, None)], f"node string, next string, {edge}"), "path-b")]
    at, to = [source], [target]  # the last levels' nodes, if they are few
    n, m = edges_ahead(adj, ahead[0], at, direction), edges_ahead(adj, back[0], to, TURNED[direction])
    total = Found(None, 1, 1)
    try:
        while len(ahead) + len(back) - 2 < max_depth:
            if n <= m:
                near = met(adj, ahead[-1], at, direction, "qpos")
                first = F.min(F.struct(place().alias("qpos"), F.col("node").alias("parent"), "rel", "dir", "evidence")).alias("f")
                level = near.groupBy(F.col("other").alias("node")).agg(first).select("node", "f.parent", "f.rel", "f.dir", "f.evidence", "f.qpos")
                level = level.join(union([x.select("node") for x in ahead]), "node", "left_anti")
                ahead.append(written(level, "path-f"))
                at = few(ahead[-1])
                n = edges_ahead(adj, ahead[-1], at, direction)
                total.forward += n if at is None else len(at)
            else:
                near = met(adj, back[-1], to, TURNED[direction])
                seen_from_other = F.struct((1 - F.col("step.side")).alias("side"), F.col("step.ord").alias("ord"), F.col("node").alias("next"), "rel", F.when(F.col("dir") == "out", "in").otherwise("out").alias("dir"), "evidence")
                level = near.groupBy(F.col("other").alias("node")).agg(F.min(seen_from_other).alias("f")).select("node", "f.next", "f.rel", "f.dir", "f.evidence")
                level = level.join(union([x.select("node") for x in back]), "node", "left_anti")
                back.append(written(level, "path-b"))
                to = few(back[-1])
                m = edges_ahead(adj, back[-1], to, TURNED[direction])
                total.backward += m if to is None else len(to)
            meeting = ahead[-1].select("node", "qpos").join(back[-1].select("node"), "node").orderBy("qpos").first()
            if meeting is not None:
                total.path = joined(spark, meeting["node"], ahead, back)
                return total
            if not n or not m:  # one end leads nowhere else
                return total
        return total
    finally:
        discard(*ahead, *back)


def joined(spark: SparkSession, node: str, ahead: list[DataFrame], back: list[DataFrame]) -> list[dict]:
    """The hops through a node that both sides reached, by a join a level and one row in the end."""
    hop = lambda a, b: F.struct(F.col(a).alias("from"), F.col(b).alias("to"), F.col("rel").alias("relation"), F.col("dir").alias("direction"), "evidence")
    kind = "array<struct<from:string,to:string,relation:string,direction:string,evidence:string>>"
    row = spark.createDataFrame([(node, node)], "at string, onward string").withColumn("hops", F.array().cast(kind))
    for level in reversed(ahead[1:]):
        row = level.join(F.broadcast(row), F.col("node") == F.col("at")).select(F.col("parent").alias("at"), "onward", F.concat(F.array(hop("parent", "node")), "hops").alias("hops"))  # one row
    for level in reversed(back[1:]):
        row = level.join(F.broadcast(row), F.col("node") == F.col("onward")).select("at", F.col("next").alias("onward"), F.concat("hops", F.array(hop("node", "next"))).alias("hops"))
    return [h.asDict() for h in row.first()["hops"]]
