"""Exploring one entity: what can be asked of it, what stands out, its stages, and how healthy the workbook is."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import scalars as S
from loomgraph.sources.workbook import Workbook
from loomgraph.storage import written

from . import compare, derive, graph
from .adjacency import Adjacency
from .identity import quoted
from .numbering import dense_numbers


S_FILES = r"[\w./]+\.py:\d+"
NO_VALUE = ("not found", "none", "n/a")  # fixed values: what stands for nothing in a lifecycle


def walk_parent(e: DataFrame, ents: DataFrame, seeds: DataFrame) -> DataFrame:
    """Owner rows that the link columns of the seed nodes name."""
    up = e.join(seeds.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select("src", "rel", F.col("dst").alias("node_key"))
    return up.join(ents, "node_key").select("src", "rel", "node_key", "class", "pk", "name")


def walk_child(wb: Workbook, ents: DataFrame, node: str) -> DataFrame:
    """(sheet, row, col): rows of other sheets with a cell that equals the node's key."""
    mine = ents.where(F.col("node_key") == node).select("class", "pk").first()
    if mine is None:
        return wb.hits("", []).select("sheet", "row", "col")
    return wb.hits(mine["pk"], [s for s in wb.frames if s != mine["class"]]).select("sheet", "row", "col")


def relation_inventory(e: DataFrame, node: str, near: DataFrame | Adjacency | None = None) -> DataFrame:
    """(dir, rel, kind, n): an entity's relations with their groups."""
    return graph.neighbors(e if near is None else near, node).groupBy("dir", "rel").agg(F.count("*").alias("n")).join(derive.relation_groups(e), "rel").select("dir", "rel", "kind", "n")


def reachable_relations(e: DataFrame | Adjacency, reach: DataFrame, node: str, cls: str) -> DataFrame:
    """(rel, target_class): the last relations of the ways that lead from a class to others, but those that the entity has itself, in either direction."""
    far = reach.where(F.col("source_class") == cls).select(F.element_at("relation_pattern", -1).alias("rel"), "target_class")
    return far.join(graph.neighbors(e, node).select("rel").distinct(), "rel", "left_anti")


def relation_classes(into: DataFrame, reach: DataFrame, relation: str, cls: str) -> list[str]:
    """Classes that a relation leads into, by its edges or as the last of the ways from a class; into is :func:`graph.relation_targets`."""
    last = reach.where((F.col("source_class") == cls) & (F.element_at("relation_pattern", -1) == relation)).select("target_class")
    return sorted(r[0] for r in into.where(F.col("rel") == relation).select("dst_class").unionAll(last).distinct().collect())  # a row a class


def discover_relation(e: DataFrame | Adjacency, node: str, targets: list[str], max_depth: int = 5) -> DataFrame:
    """(node, hop, path): what several edges reach in the target classes of a relation, with the relations on the way as text."""
    found = graph.bfs(e, graph.one_seed(e, node), "out", max_depth if targets else 0, paths=True)
    rows = found.where((F.col("hop") > 0) & F.col("node_class").isin(targets))
    return graph.with_paths(found, rows, max_depth if targets else 0).select("node", "hop", F.array_join("relations", " -> ").alias("path"))


def strided_sample(rows: DataFrame, per: list[str], order: str, k: int = 40) -> DataFrame:
    """At most k evenly spaced rows of each group, by rank. Ranks come from sorted ranges, so that no task holds a group."""
    numbered = dense_numbers(rows, [*per, order], "_nth")
    groups = numbered.groupBy(*(F.col(c).alias(f"_of_{c}") for c in per)).agg(F.count("*").alias("_n"), F.min("_nth").alias("_from"))
    same = F.lit(True)
    for c in per:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    rows = numbered.join(written(groups, "groups"), same).withColumn("_i", F.col("_nth") - F.col("_from")).drop("_nth", "_from", *(f"_of_{c}" for c in per))
    picked = (F.floor(F.ceil(F.col("_i") * k / F.col("_n")) * F.col("_n") / k) == F.col("_i")) & (F.ceil(F.col("_i") * k / F.col("_n")) < k)
    return rows.where((F.col("_n") <= k) | picked).drop("_n", "_i")


def applicable_queries(e: DataFrame | Adjacency, reach: DataFrame, node: str, cls: str) -> DataFrame:
    """(name, rel, mode): GET_ queries that have an answer, direct or over several edges, by the names that queries have."""
    direct = graph.neighbors(e, node, "out").select("rel").distinct().withColumn("mode", F.lit("direct"))
    far = reachable_relations(e, reach, node, cls).select("rel").distinct().withColumn("mode", F.lit("discovered"))
    return direct.unionByName(far).select(derive.get_name(F.col("rel")).alias("name"), "rel", "mode")


def entity_capabilities(ents: DataFrame, e: DataFrame, node: str) -> list[dict]:
    """Each question with whether the entity can answer it, and by what."""
    one = ents.where(F.col("node_key") == node)
    row = one.select("class", "evidence").first()
    around = e.where((F.col("src") == node) | (F.col("dst") == node))
    by = {q: k for _, q, k in derive.QUESTIONS}
    out = []
    for r in derive.capabilities(one, around, derive.relation_names(e)).collect():
        ok = bool(r["supported"])
        kind = by.get(r["question"])
        why = row["evidence"] or "none" if kind == "evidence" else row["class"] if kind in ("row", "name") else ("edges" if kind else r["question"][4:].lower()) if ok else "no edges"
        out.append({"category": r["category"], "question": r["question"], "supported": ok, "evidence": why})
    return out


# Pipelines with what an entity must have, any of these, their steps, and the direction of a data flow.
PIPELINES = (
    ("OWNER_via_", ("owner",), ("seed", "walk_parent", "attach_evidence", "render"), None),
    ("PRODUCERS", ("data in",), ("seed", "walk", "attach_evidence", "render"), "in"),
    ("CONSUMERS", ("data out",), ("seed", "walk", "attach_evidence", "render"), "out"),
    ("NEIGHBORS", ("edges",), ("seed", "walk", "attach_evidence", "render"), None),
    ("EXECUTION_STAGES", ("stages",), ("seed", "stages", "render"), None),
    ("LIFECYCLE_GAP", ("lifecycle",), ("seed", "lifecycle", "walk", "stages", "gaps", "render"), None),
    ("EVIDENCE", ("sources",), ("seed", "attach_evidence", "render"), None),
    ("LIFECYCLE_RECONSTRUCT", ("stages", "edges"), ("seed", "stages", "walk", "attach_evidence", "render"), None),
)


def traits(wb: Workbook, e: DataFrame | Adjacency, ents: DataFrame, node: str) -> DataFrame:
    """(trait, item): what an entity has: an owner (by its first outgoing relation), data flows by direction, edges, rows in sheets of stages or of a lifecycle, sources."""
    one = ents.where(F.col("node_key") == node)
    near = graph.neighbors(e, node)
    none = F.lit(None).cast("string")
    at_edges = near.select("dir", "rel", "flow", "step", F.explode(F.array_compact(F.array(F.lit("edges"), F.when(F.col("dir") == "out", "owner"), F.when(F.col("flow") == "Data", F.concat(F.lit("data "), "dir"))))).alias("trait"))
    out = at_edges.groupBy("trait").agg(F.min_by("rel", "step").alias("item"))
    sourced = one.where(F.exists(F.map_values("metadata"), lambda v: F.coalesce(v.rlike(S_FILES), F.lit(False))))
    out = out.unionByName(sourced.select(F.lit("sources").alias("trait"), none.alias("item")))
    profile = next((s.name for s in wb.catalog if s.execution and s.name in wb.frames and "Profile" in s.name), None)
    status = next((s for s in wb.frames if "Lifecycle Status" in s), None)
    for trait, sheet in (("stages", profile), ("lifecycle", status)):
        if sheet is not None:
            rows = wb.rows(sheet).select(quoted(wb.header(sheet)[0]).cast("string").alias("pk")).join(one.select("pk"), "pk", "left_semi")
            out = out.unionByName(rows.groupBy().agg(F.count("*").alias("n")).where("n > 0").select(F.lit(trait).alias("trait"), none.alias("item")))
    return out


def applicable_pipelines(wb: Workbook, e: DataFrame | Adjacency, ents: DataFrame, node: str) -> list[dict]:
    """The pipelines that an entity's traits allow, in their order, with ids AQ-01 on."""
    spark = ents.sparkSession
    known = spark.createDataFrame([(i, n, list(needs), list(steps), d) for i, (n, needs, steps, d) in enumerate(PIPELINES)], "place int, name string, needs array<string>, steps array<string>, direction string")
    has = traits(wb, e, ents, node)
    fits = known.withColumn("trait", F.explode("needs")).join(has, "trait").groupBy("place", "name", "steps", "direction").agg(F.min(F.when(F.col("trait") == "owner", F.col("item"))).alias("item"))
    rows = fits.select("place", F.concat("name", F.coalesce("item", F.lit(""))).alias("name"), "steps", "direction").orderBy("place").collect()  # a row a pipeline
    return [{"id": f"AQ-{i:02d}", "name": r["name"], "pipeline": r["steps"], "bind": {"direction": r["direction"], "flow": "Data"} if r["direction"] else {}} for i, r in enumerate(rows, 1)]


def promoted_view(wb: Workbook, promoted: DataFrame, promoted_id: str) -> dict | None:
    """A repeated value as an entity: its value, column, members, and what can be asked of it."""
    r = promoted.where(F.col("promoted_id") == promoted_id).orderBy("registry", "col", "value").first()
    if r is None:
        return None
    total = promoted.where((F.col("registry") == r["registry"]) & (F.col("col") == r["col"])).agg(F.sum("members")).first()[0]
    actions = [("What is", "WHAT_IS", "Identity", 1), ("Name", "GET_NAME", "Identity", 1), (r["registry"], "REL", "Relationships", r["members"]), ("Evidence", "GET_EVIDENCE", "Evidence", 1), ("Source row", "GET_SOURCE_ROW", "Evidence", 1)]
    return {
        "id": promoted_id, "name": r["value"], "registry": r["registry"], "column": r["col"], "count": r["members"], "confidence": round(r["members"] / total, 3),
        "members": derive.promotion_members(wb, r["col"], r["value"]),
        "actions": [{"label": a, "query": q, "capability": c, "count": n, "available": n > 0} for a, q, c, n in actions],
    }


def source_rows(wb: Workbook, view: dict) -> DataFrame:
    """The rows that hold a promoted value, with all their columns."""
    return wb.rows(view["registry"]).where(quoted(view["column"]).cast("string") == view["name"])


def busiest(e: DataFrame, ents: DataFrame, limit: int = 8) -> DataFrame:
    """(id, degree, class, pk, name): the nodes of most edges, ties by node."""
    top = graph.degrees(e).orderBy(F.desc("degree"), "node").limit(limit)
    return top.join(ents.select(F.col("node_key").alias("node"), "class", "pk", "name"), "node").select(F.col("node").alias("id"), "degree", "class", "pk", "name")


def actions(e: DataFrame, reach: DataFrame, node: str, cls: str) -> DataFrame:
    """(key, label, kind, n, mode): what can be done from an entity; a relation into several classes is one action each.

    Equal actions are one: identity is direction, relation and class. Counts of discovered actions are -1.
    """
    mine = graph.neighbors(e, node).groupBy("dir", "rel", "other_class").agg(F.count("*").alias("n"))
    several = F.count("*").over(Window.partitionBy("dir", "rel")) > 1
    key = F.when(several, F.concat("rel", F.lit("::"), "other_class")).otherwise(F.col("rel"))
    arrow = F.when(F.col("dir") == "out", " → ").otherwise(" ← ")
    direct = mine.select(F.concat_ws("::", "dir", key).alias("key"), F.concat(F.lit(cls), arrow, "other_class").alias("label"), F.lit("relation").alias("kind"), "n", F.lit("direct").alias("mode"))
    far = reachable_relations(e, reach, node, cls).select(F.concat(F.lit("out::"), "rel", F.lit("::"), "target_class").alias("key"), F.concat(F.lit(f"{cls} → "), "target_class").alias("label"), F.lit("relation").alias("kind"), F.lit(-1).cast("long").alias("n"), F.lit("discovered").alias("mode"))
    # equal keys are one action: what the entity has itself comes before what is discovered
    first = F.min_by(F.struct("label", "kind", "n", "mode"), F.struct(F.col("mode") != "direct", "label")).alias("a")
    return direct.unionByName(far).groupBy("key").agg(first).select("key", "a.*")


def analyze(e: DataFrame, ents: DataFrame, reach: DataFrame, node: str) -> DataFrame:
    """(kind, item, value): observations on an entity: its registry with its size, relations, the outgoing one of most targets,
    dependencies, dependents, reach, siblings and the relations by which it differs from them, evidence, next steps.

    Differences from siblings are one row 'none' if it has siblings and each of its relations has a target that all of them have.
    The evidence of the edges behind an observation has kinds that end in _backed_by, with the number of edges.
    """
    spark = e.sparkSession
    near = written(graph.neighbors(e, node), "near")  # read by most observations
    row = ents.where(F.col("node_key") == node).select("class", "evidence").first()
    shared = written(compare.sharing(e, node).distinct(), "sharing")
    kin = shared.select("node").distinct().count()
    seen = lambda rows, kind, item, value: rows.select(F.lit(kind).alias("kind"), item.alias("item"), F.col(value).alias("value"))
    fixed = [("evidence", row["evidence"] or "none", int(row["evidence"] is not None)), ("siblings", row["class"], kin)]
    out = spark.createDataFrame(fixed, "kind string, item string, value long")
    out = out.unionByName(seen(ents.where(F.col("class") == row["class"]).groupBy("class").agg(F.count("*").alias("n")), "registry_membership", F.col("class"), "n"))
    out = out.unionByName(seen(near.groupBy("dir", "rel").agg(F.count("*").alias("n")), "direct_relationships", F.concat_ws(" ", "dir", "rel"), "n"))
    widest = near.where("dir = 'out'").groupBy("rel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel").limit(1)
    out = out.unionByName(seen(widest, "strongest_connection", F.col("rel"), "n"))
    behind = {"strongest_connection": near.where("dir = 'out'").join(widest.select("rel"), "rel", "left_semi")}
    for kind, d in (("dependencies", "out"), ("dependents", "in")):
        behind[kind] = near.where(F.col("dir") == d)
        out = out.unionByName(seen(behind[kind].groupBy("other_class").agg(F.countDistinct("other").alias("n")), kind, F.col("other_class"), "n"))
    for kind, rows in behind.items():
        out = out.unionByName(seen(rows.where("evidence <> ''").groupBy("evidence").agg(F.count("*").alias("n")), f"{kind}_backed_by", F.col("evidence"), "n"))
    if kin:
        differ = compare.unlike(near.where("dir = 'out'").select("rel", F.col("other").alias("dst")), shared, kin)
        out = out.unionByName(seen(differ, "sibling_differences", F.col("rel"), "n_targets"))
        out = out.unionByName(seen(differ.groupBy().agg(F.count("*").alias("n")).where("n = 0"), "sibling_differences", F.lit("none"), "n"))
    far = reachable_relations(e, reach, node, row["class"]).groupBy("rel").agg(F.countDistinct("target_class").alias("n"))
    steps = near.where("dir = 'out'").select(F.col("other").alias("node")).distinct().join(graph.degrees(e), "node").orderBy(F.desc("degree"), F.desc("node")).limit(5)
    return out.unionByName(seen(far, "reachable_relations", F.col("rel"), "n")).unionByName(seen(steps, "next_steps", F.col("node"), "degree"))


def lifecycle(e: DataFrame, ents: DataFrame, node: str) -> DataFrame:
    """(nth, stage, filled, status): entry, a stage a relation of the class, output and evidence.

    Statuses: filled; not_referenced, where the row says nothing of a stage; compiler_missed, where it holds an entity's key or name
    but there is no edge; genuine_metadata_gap, where it holds anything else; missing, for evidence.
    """
    row = ents.where(F.col("node_key") == node).select("class", "evidence", "metadata").first()
    cells = {k.lower(): (v or "").strip() for k, v in (row["metadata"] or {}).items()}
    rels = e.where(F.col("src_class") == row["class"]).groupBy("rel").agg(F.min("ord").alias("first"), F.max((F.col("src") == node).cast("int")).alias("filled")).orderBy("first").collect()  # a row a relation

    def cell(stage: str) -> str:
        value = next((v for k, v in cells.items() if stage.lower() in k), "")
        return "" if value.lower() in NO_VALUE else value

    def status(stage: str) -> str:
        value = cell(stage)
        if not value:
            return "not_referenced"
        known = not ents.where((F.col("pk") == value) | (F.lower("name") == value.lower())).limit(1).isEmpty()
        return "compiler_missed" if known else "genuine_metadata_gap"

    out = [(0, "Entry", bool(cell("entry")), "filled" if cell("entry") else "not_referenced")]
    for i, r in enumerate(rels, 1):
        out.append((i, r["rel"], r["filled"] == 1, "filled" if r["filled"] == 1 else status(r["rel"].replace("_", " "))))
    out.append((1_000_000, "Output", bool(cell("output")), "filled" if cell("output") else "not_referenced"))
    has = bool(row["evidence"]) and row["evidence"].lower() not in NO_VALUE
    out.append((1_000_001, "Evidence", has, "filled" if has else "missing"))
    return e.sparkSession.createDataFrame(out, "nth int, stage string, filled boolean, status string")


def gap_analysis(wb: Workbook, sheet: str, pk: str, done: str = "✅") -> DataFrame:
    """(stage, value): columns of a status row that aren't done."""
    return derive.stages(wb, sheet, pk, 1).where(F.coalesce(F.col("value") != done, F.lit(True))).select("stage", "value")


@dataclass
class Diagnosis:
    """Verdicts by layer and a health score."""

    layers: dict[str, str] = field(default_factory=dict)

    @property
    def health(self) -> int:
        # What a verdict counts.
        worth = {"PASS": 1.0, "PARTIAL": 0.5, "FAIL": 0.0}
        known = [worth[v] for v in self.layers.values() if v in worth]
        return int(100 * sum(known) / len(known)) if known else 0

    @property
    def band(self) -> str:
        return "green" if self.health >= 85 else "yellow" if self.health >= 55 else "red"


def diagnose(checks: dict[str, int], resolved: bool, operations: list[str], has_result: bool) -> Diagnosis:
    """Six layers: structure, identity, relationships, evidence, the question's plan, its result."""
    return Diagnosis({
        "structure": "PASS" if checks["schema_catalog"] and not checks["empty_registries"] else "PARTIAL" if checks["types"] else "FAIL",
        "identity": "PASS" if not checks["duplicate_pk"] else "PARTIAL",
        "relationships": "FAIL" if not checks["relationships"] else "PARTIAL" if checks["broken_fk"] else "PASS",
        "evidence": "PASS" if checks["missing_evidence_pct"] <= 20 else "PARTIAL" if checks["missing_evidence_pct"] < 100 else "FAIL",
        "plan": "PASS" if operations else "FAIL",
        "result": "PASS" if has_result else "PARTIAL" if resolved else "FAIL",
    })


def canonicalization_report(wb: Workbook, sheet: str, column: str, ents: DataFrame) -> DataFrame:
    """(outcome, n): whether a column's references name an entity exactly, in part, or not at all."""
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    names = ents.select(F.explode(F.array("pk", "name")).alias("name")).where("name IS NOT NULL").select(clean(F.col("name")).alias("k")).distinct()
    rows = wb.rows(sheet).select(quoted(column).cast("string").alias("v")).withColumn("id", F.monotonically_increasing_id())
    parts = rows.select("id", "v", F.explode_outer(F.split("v", "/")).alias("p")).select("id", "v", clean(F.col("p")).alias("part"), clean(F.col("v")).alias("whole"))
    whole = parts.join(names.withColumnRenamed("k", "whole").withColumn("w", F.lit(1)), "whole", "left").join(names.withColumnRenamed("k", "part").withColumn("p", F.lit(1)), "part", "left")
    best = whole.groupBy("id").agg(F.first("v").alias("v"), F.max("w").alias("w"), F.max("p").alias("p"))
    outcome = F.when(F.col("v").isNull() | (F.trim("v") == "") | S.is_null_word(F.col("v")), "absent").when(F.col("w") == 1, "resolved").when(F.col("p") == 1, "component").otherwise("not_found")
    return best.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
