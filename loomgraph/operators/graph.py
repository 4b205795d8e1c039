"""The typed property graph: edges from links, neighbourhoods, perspectives, paths.

What starts at nodes takes the edges as a table or as an :class:`Adjacency`, by which it reads the edges of these nodes only.
Traversal is that of the module ``adjacency``: frontiers hold each node once, so work is bounded by the edges met, not by the
number of paths, and parents are those that a queue would find first, which makes paths the same in every run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomgraph.functions import scalars as S
from loomgraph.sources.workbook import ORD, Link, Sheet, Workbook
from loomgraph.storage import discard, written

from . import adjacency as adj
from . import discovery
from .adjacency import Adjacency
from .identity import quoted
from .reach import reachability  # noqa: F401 - class-level reachability is part of this module's operators

EDGE = ["src", "rel", "dst", "src_class", "dst_class", "evidence", "flow", "source", "ord"]


# --- edges -------------------------------------------------------------------------------------------------------


STAGES = ("key", "id in text", "name")


FEW_KEYS = 100_000  # entities of classes, all in all, whose keys are broadcast


def link_parts(wb: Workbook, wanted: Callable[[Sheet, Link], bool] = lambda s, l: True) -> DataFrame | None:
    """(src_class, src_pk, evidence, rel, target, part, at): what the cells of link columns list, separated by ; , / or |."""
    raw = None
    for s in wb.owners():
        if not any(wanted(s, l) for l in s.links):
            continue
        items = F.array(*(F.struct(F.lit(l.relation).alias("rel"), F.lit(l.target).cast("string").alias("target"), quoted(l.column).cast("string").alias("cell"), F.lit(i).alias("col")) for i, l in enumerate(s.links) if wanted(s, l)))
        df = wb.rows(s.name).select(F.lit(s.name).alias("src_class"), quoted(s.pk).cast("string").alias("src_pk"), (quoted(s.evidence).cast("string") if s.evidence else F.lit(None).cast("string")).alias("evidence"), F.col(ORD).alias("row"), F.lit(s.ix).alias("sheet"), F.explode(items).alias("l"))
        df = df.select("src_class", "src_pk", "evidence", "l.rel", "l.target", F.posexplode(F.split("l.cell", r"\s*[;,/|]\s*")).alias("nth", "part"), F.struct("sheet", "row", "l.col").alias("at"))
        raw = df if raw is None else raw.unionByName(df)
    return None if raw is None else raw.where(F.col("part") != "").withColumn("at", F.struct("at.sheet", "at.row", "at.col", "nth")).drop("nth")


def linked(wb: Workbook, ents: DataFrame) -> DataFrame | None:
    """Parts of link cells with the entities (dst, dst_class) they name and the stage that found them.

    A part is looked up as a key; where no entity has it, the identifiers within it are; where none of these is known, it is
    looked up as a name, the first entity of that name being meant. A declared target restricts all stages to its class.
    Parts that are plain keys (most are) need one join; the others' lookups are joined at once and the least stage with
    a hit stays. Only entities of the classes meant are looked at, and those of small classes are broadcast.
    """
    sizes = {r["class"]: r["n"] for r in ents.groupBy("class").agg(F.count("*").alias("n")).collect()}  # a row a class
    small, total = set(), 0
    for c in sorted(sizes, key=lambda c: (sizes[c], c)):
        total += sizes[c]
        if total <= FEW_KEYS:
            small.add(c)
    few = lambda s, l: l.target in small or (l.target is not None and l.target not in sizes)
    out = None
    for some, wanted in ((True, few), (False, lambda s, l: not few(s, l))):
        targets = {l.target for s in wb.owners() for l in s.links if wanted(s, l)}
        if not targets:
            continue
        meant = ents if None in targets else ents.where(F.col("class").isin(sorted(targets)))
        found = _linked(wb, meant, wanted, F.broadcast if some else lambda t: t)
        out = found if out is None else out.unionByName(found)
    return out


def _linked(wb: Workbook, ents: DataFrame, wanted: Callable[[Sheet, Link], bool], hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """:func:`linked` of some links, by entities of the classes that these mean."""
    parts = link_parts(wb, wanted)
    keys = ents.select(F.lit(0).alias("kind"), F.col("pk").alias("key"), F.col("node_key").alias("dst"), F.col("class").alias("dst_class"), "ord")
    ok = F.col("target").isNull() | (F.col("target") == F.col("dst_class"))
    plain = F.col("part").rlike(r"^[A-Za-z]+-\w+$") | ~F.col("part").rlike(r"\p{L}")
    kept = [*parts.columns, "dst", "dst_class", "stage"]
    simple = parts.where(plain).join(hint(keys), F.col("part") == F.col("key")).where(ok).withColumn("stage", F.lit(0)).select(*kept)
    # columns of whole numbers have plain keys only
    parts = link_parts(wb, lambda s, l: wanted(s, l) and not isinstance(wb.frame(s.name).schema[l.column].dataType, T.IntegralType))
    if parts is None:
        return simple
    clean = lambda c: F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    names = ents.where("name <> ''").select(F.lit(1).alias("kind"), clean(F.col("name")).alias("key"), F.col("node_key").alias("dst"), F.col("class").alias("dst_class"), "ord")
    lookup = lambda stage, kind, key: F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), key.alias("key"))
    inner = F.transform(F.regexp_extract_all("part", F.lit(S.ID_ANYWHERE), F.lit(0)), lambda x: lookup(1, 0, x))
    asked = parts.where(~plain).select("*", F.explode(F.concat(F.array(lookup(0, 0, F.col("part"))), inner, F.array(lookup(2, 1, clean(F.col("part")))))).alias("x")).select(*parts.columns, "x.stage", "x.kind", "x.key")
    found = asked.join(hint(keys.unionByName(names)), ["kind", "key"]).where(ok)
    order = F.when(F.col("stage") == 2, F.col("ord"))  # the first of a name; keys may be those of several classes
    found = found.withColumn("r", F.rank().over(Window.partitionBy("at").orderBy("stage", order))).where("r = 1")
    return simple.unionByName(found.select(*kept))


def link_edges(wb: Workbook, ents: DataFrame) -> DataFrame:
    """Edges of foreign-key columns, by :func:`linked`.

    A declared target restricts the lookup to its class; without one every class that has the key is a target. Parts that name
    nothing make no edge, nor does a row that names itself.
    """
    found = linked(wb, ents)
    if found is None:
        return _no_edges(wb)
    source = F.lit("declared" if wb.declared else "inferred")
    mine = ents.where(F.col("class").isin([s.name for s in wb.owners() if s.links])).select(F.col("class").alias("src_class"), F.col("pk").alias("src_pk"), F.col("node_key").alias("src"))
    # entities are many times as large as their file, by which Spark takes them for small enough to broadcast
    out = found.join(mine.hint("merge"), ["src_class", "src_pk"]).where(F.col("src") != F.col("dst"))
    return out.select("src", "rel", "dst", "src_class", "dst_class", "evidence", F.lit(None).cast("string").alias("flow"), source.alias("source"), F.struct(F.col("at.sheet").alias("sheet"), F.col("at.row").alias("row"), (F.col("at.col") * 1000 + F.col("at.nth")).alias("nth")).alias("ord"))


def relationship_edges(wb: Workbook, ents: DataFrame) -> DataFrame:
    """Edges of the first relationship sheet: columns Source (FK), Relation, Target (FK), Flow Type and an evidence column."""
    s = next((x for x in wb.catalog if x.relations and x.name in wb.frames), None)
    if s is None:
        return _no_edges(wb)
    head = wb.header(s.name)
    for need in ("Source (FK)", "Relation", "Target (FK)"):
        if need not in head:
            raise ValueError(f"the relationship sheet {s.name!r} has no column {need!r}")
    text = lambda c: quoted(c).cast("string") if c else F.lit(None).cast("string")
    evidence = next((c for c in head if c.lower().startswith("evidence")), None)
    flow = next((c for c in head if c.lower().startswith("flow type")), next((c for c in head[1:] if c.lower().startswith("flow")), None))
    rows = wb.frame(s.name).select(text("Source (FK)").alias("src_pk"), text("Relation").alias("rel"), text("Target (FK)").alias("dst_pk"), text(flow).alias("flow"), text(evidence).alias("evidence"), F.struct(F.lit(-1).alias("sheet"), F.col(ORD).alias("row"), F.lit(0).alias("nth")).alias("ord"))
    a = ents.select(F.col("pk").alias("src_pk"), F.col("node_key").alias("src"), F.col("class").alias("src_class"))
    b = ents.select(F.col("pk").alias("dst_pk"), F.col("node_key").alias("dst"), F.col("class").alias("dst_class"))
    out = rows.join(a.hint("merge"), "src_pk").join(b.hint("merge"), "dst_pk")
    return out.select("src", "rel", "dst", "src_class", "dst_class", "evidence", "flow", F.lit("declared").alias("source"), "ord")


def edges(wb: Workbook, ents: DataFrame) -> DataFrame:
    """Relationship-sheet edges, then link edges, then prose edges; duplicates stay."""
    return relationship_edges(wb, ents).unionByName(link_edges(wb, ents)).unionByName(discovery.prose_edges(wb, ents).select(*EDGE))


def _no_edges(wb: Workbook) -> DataFrame:
    return wb.spark.createDataFrame([], "src string, rel string, dst string, src_class string, dst_class string, evidence string, flow string, source string, ord struct<sheet:int,row:bigint,nth:int>")


def both_ways(e: DataFrame | Adjacency, direction: str = "both") -> DataFrame:
    """(node, other, rel, dir, evidence, flow, other_class, step): edges from the side of each end, outgoing before incoming."""
    if isinstance(e, Adjacency):
        return adj.exploded(adj.blocks_of(e, direction))
    side = lambda a, b, d, n: e.select(F.col(a).alias("node"), F.col(b).alias("other"), "rel", F.lit(d).alias("dir"), "evidence", "flow", F.col(f"{b}_class").alias("other_class"), F.struct(F.lit(n).alias("side"), "ord").alias("step"))
    out, into = side("src", "dst", "out", 0), side("dst", "src", "in", 1)
    return out if direction == "out" else into if direction == "in" else out.unionByName(into)


# --- one hop -----------------------------------------------------------------------------------------------------


def neighbors(e: DataFrame | Adjacency, node: str, direction: str = "both") -> DataFrame:
    if isinstance(e, Adjacency):
        return adj.edges_at(e, [node], direction)
    return both_ways(e, direction).where(F.col("node") == node)


def met(e: DataFrame | Adjacency, nodes: DataFrame, direction: str = "both", via: str | None = None) -> DataFrame:
    """Edges at a table of nodes, once each; a column of theirs comes along as ``via``."""
    front = nodes.select("node", *([F.col(via).alias("via")] if via else []))
    keep = ["via"] if via else []
    front = written(front, "met")  # small as the nodes are, and looked at twice
    some = adj.few(front)
    if isinstance(e, Adjacency):
        return adj.met(e, front, some, direction, *keep)
    sides = both_ways(e, direction)
    return (sides if some is None else sides.where(F.col("node").isin(some))).join(front, "node")


def _of_relation(rows: DataFrame, relation: str | None, flow: str | None) -> DataFrame:
    if relation:
        rows = rows.where(F.col("rel").contains(relation))
    return rows.where(F.col("flow") == flow) if flow else rows


def walk_from(e: DataFrame | Adjacency, node: str, direction: str = "out", relation: str | None = None, flow: str | None = None) -> DataFrame:
    """Edges at a node. The relation matches as a part of the name."""
    return _of_relation(neighbors(e, node, direction), relation, flow)


def walk_relationship(e: DataFrame | Adjacency, seeds: DataFrame, direction: str = "out", relation: str | None = None, flow: str | None = None) -> DataFrame:
    """Edges at the seeds (column node). The relation matches as a part of the name; both ends in the seeds give two rows."""
    return _of_relation(both_ways(e, direction), relation, flow).join(seeds.select("node").distinct(), "node", "left_semi")


def reverse_lookup(e: DataFrame | Adjacency, ents: DataFrame, node: str, relation: str | None = None, source_prefix: str | None = None) -> DataFrame:
    """Incoming edges of a node with the names of their sources; the relation must be equal, the prefix is that of the source's pk."""
    rows = neighbors(e, node, "in").select("rel", F.col("other").alias("src"), F.col("other_class").alias("src_class"), F.col("step.ord").alias("ord"))
    if relation:
        rows = rows.where(F.col("rel") == relation)
    rows = rows.join(ents.select(F.col("node_key").alias("src"), F.col("pk").alias("src_pk"), F.col("name").alias("src_name")), "src")
    if source_prefix:
        rows = rows.where(S.id_prefix(F.col("src_pk")) == source_prefix)
    return rows.select("rel", "src", "src_class", "src_pk", "src_name", "ord")


def count_related(e: DataFrame, relation: str, parent_class: str, child_class: str, direction: str = "out", parent: str | None = None) -> DataFrame:
    """One row: the number of distinct ends reached by the relation between two classes, from one parent or all."""
    rows = both_ways(e, direction).where((F.col("rel") == relation) & (F.col("other_class") == child_class))
    if parent is not None:
        rows = rows.where(F.col("node") == parent)
    cls = e.select(F.col("src" if direction == "out" else "dst").alias("node"), F.col("src_class" if direction == "out" else "dst_class").alias("c")).where(F.col("c") == parent_class).select("node").distinct()
    return rows.join(cls, "node", "left_semi").agg(F.countDistinct("other").alias("n"))


def cardinality(e: DataFrame) -> DataFrame:
    """(rel, cardinality): whether a source has several targets and a target several sources, as in 1→N."""
    out = e.groupBy("rel", "src").agg(F.count("*").alias("n")).groupBy("rel").agg(F.max("n").alias("most_out"))
    into = e.groupBy("rel", "dst").agg(F.count("*").alias("n")).groupBy("rel").agg(F.max("n").alias("most_in"))
    many = lambda c: F.when(F.col(c) > 1, "N").otherwise("1")
    return out.join(into, "rel").select("rel", F.concat(many("most_out"), F.lit("→"), many("most_in")).alias("cardinality"))


def degrees(e: DataFrame | Adjacency) -> DataFrame:
    """(node, degree): edges at either end."""
    if isinstance(e, Adjacency):
        return e.frame.groupBy("node").agg(F.sum(F.size("edges")).alias("degree"))
    return e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def relation_targets(e: DataFrame) -> DataFrame:
    """(rel, dst_class) pairs that occur."""
    return e.select("rel", "dst_class").distinct()


def discovery_chain(e: DataFrame | Adjacency, ents: DataFrame, node: str, items: int = 8) -> DataFrame:
    """Neighbours of a node by direction, relation and class: their count and the first few, largest groups first."""
    rows = neighbors(e, node)
    keys = ["dir", "rel", "other_class"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("step"))
    total = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    head = rows.withColumn("nth", nth).where(F.col("nth") <= items).join(ents.select(F.col("node_key").alias("other"), "pk", "name"), "other")
    listed = head.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "pk"))), lambda x: x["pk"]), ",").alias("items"))
    return total.join(listed, keys).orderBy(F.desc("n"), "dir", "rel")


def relation_view(e: DataFrame | Adjacency, node: str) -> DataFrame:
    """(dir, rel, other, evidence): incoming and outgoing edges, with evidence."""
    return neighbors(e, node).select("dir", "rel", "other", "other_class", "evidence")


def list_by_relation(e: DataFrame, ents: DataFrame, relation: str) -> DataFrame:
    """Edges of a relation, the first of each pair, with names."""
    first = F.row_number().over(Window.partitionBy("src", "dst").orderBy("ord"))
    rows = e.where(F.col("rel") == relation).withColumn("nth", first).where("nth = 1")
    name = lambda c: ents.select(F.col("node_key").alias(c), F.col("name").alias(f"{c}_name"))
    return rows.join(name("src"), "src").join(name("dst"), "dst").select("src", "src_name", "dst", "dst_name", "rel", "evidence")


# --- traversal ---------------------------------------------------------------------------------------------------


def bfs(e: DataFrame | Adjacency, seeds: DataFrame, direction: str = "both", max_hops: int = 6, paths: bool = False, stop: Column | None = None) -> DataFrame:
    """Everything reached from (origin, node) seeds: see :func:`adjacency.bfs`."""
    return adj.bfs(e if isinstance(e, Adjacency) else adj.adjacency(e), seeds, direction, max_hops, paths, stop)


def one_seed(e: DataFrame | Adjacency, node: str) -> DataFrame:
    return e.sparkSession.createDataFrame([(node, node)], "origin string, node string")


def reachable(e: DataFrame | Adjacency, node: str, depth: int | None = None) -> DataFrame:
    """(node, hop): what edges lead to from the node, itself included; without a depth, however far."""
    return bfs(e, one_seed(e, node), "out", depth if depth is not None else 1_000_000).select("node", "hop")


def path_between(e: DataFrame | Adjacency, source: str, target: str, max_depth: int = 6, direction: str = "both") -> list[dict] | None:
    """Hops of the first-found shortest path: [] if source is target, None if there is none. It is searched from both ends."""
    return adj.two_ended(e if isinstance(e, Adjacency) else adj.adjacency(e), source, target, max_depth, direction).path


def perspective(e: DataFrame | Adjacency, node: str, direction: str = "out", max_hops: int = 6) -> DataFrame:
    """(node, hop, node_class): everything around a node by distance, the node itself left out."""
    return bfs(e, one_seed(e, node), direction, max_hops).where("hop > 0").select("node", "hop", "node_class")


def bands(view: DataFrame) -> DataFrame:
    """(node_class, n, nearest): classes of a perspective, largest first."""
    return view.groupBy("node_class").agg(F.count("*").alias("n"), F.min("hop").alias("nearest")).orderBy(F.desc("n"), "node_class")


def derive_table(view: DataFrame, ents: DataFrame) -> DataFrame:
    """A perspective as a table with a strength: 1 / (1 + hop), raised for executed and evidenced entities, at most 1."""
    rows = view.join(ents.select(F.col("node_key").alias("node"), "pk", "name", "evidence", "has_evidence", "in_execution"), "node")
    raw = (1.0 / (1 + F.col("hop"))) * F.when(F.col("in_execution"), 1.25).otherwise(1.0) * F.when(F.col("has_evidence"), 1.15).otherwise(1.0)
    return rows.select("node", "node_class", "pk", "name", "hop", F.least(F.lit(1.0), F.bround(raw, 3)).alias("strength"), "evidence").orderBy(F.desc("strength"), "hop", "node")


def all_reachable(e: DataFrame | Adjacency, node: str, target_class: str, max_depth: int = 5) -> DataFrame:
    """(node, hop): nodes of a class that edges lead to."""
    return bfs(e, one_seed(e, node), "out", max_depth).where((F.col("hop") > 0) & (F.col("node_class") == target_class)).select("node", "hop")


def reached_in(e: DataFrame | Adjacency, node: str, classes: list[str], max_depth: int = 5) -> DataFrame:
    """(node, node_class, hop): nodes of some classes that edges lead to, by one search."""
    return bfs(e, one_seed(e, node), "out", max_depth if classes else 0).where((F.col("hop") > 0) & F.col("node_class").isin(classes)).select("node", "node_class", "hop")


def with_paths(found: DataFrame, rows: DataFrame, max_depth: int) -> DataFrame:
    """rows (origin, node, hop) of a search with paths, with the nodes and the relations on the way, as arrays, a join a level."""
    step = found.select("origin", F.col("node").alias("at"), "parent", "rel")
    out = rows.select("origin", "node", "hop", F.col("node").alias("at"), F.array("node").alias("path"), F.array().cast("array<string>").alias("relations"))
    for _ in range(max_depth):
        on = F.col("parent").isNotNull()
        out = out.join(step, ["origin", "at"], "left").select("origin", "node", "hop", F.when(on, F.col("parent")).otherwise(F.col("at")).alias("at"), F.when(on, F.concat(F.array("parent"), "path")).otherwise(F.col("path")).alias("path"), F.when(on, F.concat(F.array("rel"), "relations")).otherwise(F.col("relations")).alias("relations"))
    return out.drop("at")


def all_reachable_paths(e: DataFrame | Adjacency, node: str, target_class: str, max_depth: int = 5, reach: DataFrame | None = None, source_class: str | None = None) -> DataFrame:
    """(node, hop, path, relations): nodes of a class that edges lead to, with first-found shortest paths.

    With the class pairs of :func:`reachability` and the node's class, a pair that isn't among them ends the search before it begins.
    """
    if reach is not None and reach.where((F.col("source_class") == source_class) & (F.col("target_class") == target_class)).isEmpty():
        return e.sparkSession.createDataFrame([], "node string, hop int, path array<string>, relations array<string>")
    found = bfs(e, one_seed(e, node), "out", max_depth, paths=True)
    rows = found.where((F.col("hop") > 0) & (F.col("node_class") == target_class))
    return with_paths(found, rows, max_depth).drop("origin")


def path_to_class(e: DataFrame | Adjacency, node: str, target_class: str, max_depth: int = 5, reach: DataFrame | None = None, source_class: str | None = None) -> DataFrame:
    """The nearest of :func:`all_reachable_paths`, at most one row; ties to the least node."""
    return all_reachable_paths(e, node, target_class, max_depth, reach, source_class).orderBy("hop", "node").limit(1)


def discovered_by_relation(e: DataFrame | Adjacency, node: str, relation: str, reach: DataFrame, source_class: str | None, into: DataFrame, max_depth: int = 5) -> DataFrame:
    """(node, hop, path, relations): what several edges reach in the classes that relations of this name (or part) lead into.

    into are the relations' target classes, by :func:`relation_targets`.
    """
    named = into.where(F.col("rel").contains(relation)).select(F.col("dst_class").alias("target_class")).distinct()
    targets = [r["target_class"] for r in named.join(reach.where(F.col("source_class") == source_class), "target_class", "left_semi").collect()]  # a row a class
    found = bfs(e, one_seed(e, node), "out", max_depth if targets else 0, paths=True)
    rows = found.where((F.col("hop") > 0) & F.col("node_class").isin(targets))
    return with_paths(found, rows, max_depth if targets else 0).drop("origin")


def intersect_paths(e: DataFrame | Adjacency, a: str, b: str, direction: str = "out", max_hops: int = 6) -> DataFrame:
    """(node, hop_a, hop_b, distance, path_a, path_b): what both reach, with the paths, nearest first."""
    seeds = e.sparkSession.createDataFrame([(a, a), (b, b)], "origin string, node string")
    found = bfs(e, seeds, direction, max_hops, paths=True)
    rows = with_paths(found, found.where((F.col("hop") > 0) & ~F.col("node").isin(a, b)), max_hops)
    one = lambda x, n: rows.where(F.col("origin") == x).select("node", F.col("hop").alias(f"hop_{n}"), F.col("path").alias(f"path_{n}"))
    return one(a, "a").join(one(b, "b"), "node").withColumn("distance", F.col("hop_a") + F.col("hop_b")).orderBy("distance", "node")


def direct_reach(e: DataFrame | Adjacency, a: str, b: str, direction: str = "out", max_hops: int = 6) -> dict:
    """Whether each of two nodes reaches the other, and how."""
    there, back = path_between(e, a, b, max_hops, direction), path_between(e, b, a, max_hops, direction)
    return {"a_reaches_b": there is not None, "b_reaches_a": back is not None, "path_ab": there, "path_ba": back}


def intersect(e: DataFrame | Adjacency, a: str, b: str, direction: str = "out", max_hops: int = 6) -> DataFrame:
    """(node, hop_a, hop_b, distance): what both reach, themselves left out, nearest first."""
    seeds = e.sparkSession.createDataFrame([(a, a), (b, b)], "origin string, node string")
    seen = bfs(e, seeds, direction, max_hops).where((F.col("hop") > 0) & ~F.col("node").isin(a, b))
    one = lambda x, n: seen.where(F.col("origin") == x).select("node", F.col("hop").alias(n))
    return one(a, "hop_a").join(one(b, "hop_b"), "node").withColumn("distance", F.col("hop_a") + F.col("hop_b")).orderBy("distance", "node")


def suggest_next(e: DataFrame | Adjacency, ents: DataFrame, node: str, direction: str = "both", limit: int = 8) -> DataFrame:
    """Nodes within two hops by score: 1 / hop, degree against the largest, and how often they are met; at most 1."""
    e = e if isinstance(e, Adjacency) else adj.adjacency(e)
    one = neighbors(e, node, direction).where(F.col("other") != node)
    first = written(one.groupBy(F.col("other").alias("node")).agg(F.count("*").alias("n1")), "suggest-one")
    two = adj.met(e, first, adj.few(first), direction).where(F.col("other") != node).groupBy("other").agg(F.count("*").alias("n2"))
    both = first.select(F.col("node").alias("id"), "n1").join(two.select(F.col("other").alias("id"), "n2"), "id", "full_outer")
    rows = both.select("id", F.when(F.col("n1").isNotNull(), 1).otherwise(2).alias("hop"), (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("mult"))
    ends = e.frame.select(F.col("node").alias("id"), F.size("edges").alias("n"))
    rows = written(ends.join(rows, "id").groupBy("id", "hop", "mult").agg(F.sum("n").alias("degree")), "suggest")
    discard(first)
    most = rows.agg(F.max("degree")).first()[0] or 1
    score = (1.0 / F.col("hop")) * (0.5 + 0.5 * F.col("degree") / most) * (1 + 0.1 * (F.col("mult") - 1))
    rows = rows.select("id", "hop", "degree", F.least(F.lit(1.0), F.bround(score, 4)).alias("score"))
    rows = rows.orderBy(F.desc("score"), "hop", "id").limit(limit)
    return rows.join(ents.select(F.col("node_key").alias("id"), "class", "pk", "name"), "id")
