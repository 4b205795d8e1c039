"""Derived knowledge: invariants, rules, queries, capabilities, relation groups, repeated values as entities, evidence tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import scalars as S
from loomgraph.sources.workbook import ORD, Workbook

from .identity import quoted
from .relational import PREDICATES

# Questions that any entity can be asked, by category, with what answers them.
QUESTIONS = (
    ("Identity", "WHAT_IS", "row"),
    ("Identity", "GET_NAME", "name"),
    ("Identity", "GET_PURPOSE", "row"),
    ("Relationships", "GET_NEIGHBORS", "edges"),
    ("Relationships", "GET_INCOMING", "edges"),
    ("Relationships", "GET_OUTGOING", "edges"),
    ("Dependency", "GET_UPSTREAM", "edges"),
    ("Dependency", "GET_DOWNSTREAM", "edges"),
    ("Dependency", "IS_ROOT", "edges"),
    ("Dependency", "IS_LEAF", "edges"),
    ("Integrity", "CHECK_FK", "row"),
    ("Integrity", "IS_ORPHAN", "row"),
    ("Integrity", "IS_DUPLICATE", "row"),
    ("Coverage", "MISSING_EVIDENCE", "row"),
    ("Coverage", "EMPTY_FIELDS", "row"),
    ("Evidence", "GET_EVIDENCE", "evidence"),
    ("Evidence", "GET_SOURCE_ROW", "evidence"),
)
RELATION_CATEGORY = "Relations (workbook)"
# Canonical queries: name, objective, relation (* for any) or attribute, direction, form of the answer.
QUERIES = (
    ("GET_HANDLER", "traverse", "handler", "out", "tree"),
    ("GET_GATE", "traverse", "gate", "out", "tree"),
    ("GET_PIPELINE", "traverse", "pipeline", "out", "tree"),
    ("GET_BRIDGE", "traverse", "bridge", "out", "tree"),
    ("GET_VALIDATOR", "traverse", "validator", "out", "tree"),
    ("GET_OWNER", "traverse", "module", "out", "tree"),
    ("GET_CATEGORY", "traverse", "category", "out", "tree"),
    ("GET_PRODUCERS", "traverse", "produces", "in", "graph"),
    ("GET_CONSUMERS", "traverse", "consumes", "out", "graph"),
    ("GET_UPSTREAM", "traverse", "*", "in", "graph"),
    ("GET_DOWNSTREAM", "traverse", "*", "out", "graph"),
    ("GET_EVIDENCE", "attribute", "evidence", None, "table"),
    ("VALIDATE_REFERENCES", "validate", None, None, "table"),
    ("GET_NEIGHBORS", "traverse", "*", "both", "graph"),
)
# What each kind of invariant becomes as a rule, and each kind of rule as queries.
RULE_TEMPLATES = (
    ("attribute", "Every {scope} MUST have {property}.", "{property} is present on the {scope} row", "flag {scope} rows missing {property}", "ERROR"),
    ("relationship", "Every {scope} MUST reference an existing {target}.", "{property} resolves to an existing {target} PK", "flag {scope} rows whose {property} is missing/dangling", "ERROR"),
)
QUERY_FAMILIES = (
    ("attribute", "LIST_MISSING_{PROP}", "find_missing_evidence → render_table"),
    ("attribute", "VALIDATE_{SCOPE}_{PROP}", "check_fk → render_table"),
    ("relationship", "TRACE_OWNER_{TARGET}", "resolve_entity → walk_parent → attach_evidence → render_tree"),
    ("relationship", "VALIDATE_{SCOPE}_REFERENCE", "check_fk → render_table"),
    ("relationship", "LIST_{SCOPE}_ORPHANS", "find_orphan → render_list"),
)
# Properties that entities of a class are examined for: name, kind, column, predicate, its value.
PROPERTIES = (
    ("has_PK", "attribute", "pk", "not_null", None),
    ("has_Evidence", "attribute", "evidence", "matches", S.EVIDENCE),
    ("has_Reference", "relationship", None, "non_empty", None),
)


def registry(wb: Workbook, sheet: str, columns: dict[str, str], default: tuple[tuple, ...]) -> DataFrame:
    """A table of definitions: a sheet of the workbook that has the given columns (new name: header), or the default rows.

    So a workbook can bring properties, rule templates and query families of its own.
    """
    if sheet in wb.frames and set(columns.values()) <= set(wb.header(sheet)):
        rows = wb.rows(sheet).select(*(quoted(h).cast("string").alias(n) for n, h in columns.items()))
        if not rows.isEmpty():
            return rows
    return wb.spark.createDataFrame(list(default), ", ".join(f"{n} string" for n in columns))


def property_registry(wb: Workbook) -> DataFrame:
    return registry(wb, "Property Registry", {"property": "Property", "kind": "Kind", "field": "Field", "operator": "Operator", "value": "Value"}, PROPERTIES)


def rule_templates(wb: Workbook) -> DataFrame:
    return registry(wb, "Rule Template Registry", {"kind": "Kind", "purpose": "Purpose Template", "condition": "Condition Template", "action": "Action Template", "severity": "Severity"}, RULE_TEMPLATES)


def query_families(wb: Workbook) -> DataFrame:
    return registry(wb, "Query Family Registry", {"kind": "Kind", "template": "Query Name Template", "pipeline": "Opcode Pipeline"}, QUERY_FAMILIES)


def property_invariants(wb: Workbook, ents: DataFrame, e: DataFrame, threshold: float = 1.0, properties: DataFrame | None = None) -> DataFrame:
    """(scope, property, kind, target, support, confidence): properties of the registry that at least this share of a class has.

    Attribute properties apply a predicate to an entity's column, or to a cell of its row; relationship properties stand for
    each relation and the class it leads to, counted by the edges' sources.
    """
    size = ents.groupBy("class").agg(F.count("*").alias("n"))
    out = wb.spark.createDataFrame([], "scope string, property string, kind string, target string, hits long")
    for p in (properties if properties is not None else property_registry(wb)).collect():  # a row a property
        if p["kind"] == "relationship":
            linked = e.groupBy("src_class", "rel", "dst_class").agg(F.countDistinct("src").alias("hits"))
            out = out.unionByName(linked.select(F.col("src_class").alias("scope"), F.concat(F.lit("references::"), "rel").alias("property"), F.lit("relationship").alias("kind"), F.col("dst_class").alias("target"), "hits"))
            continue
        if p["operator"] not in PREDICATES:
            raise ValueError(f"the property {p['property']!r} has an unknown operator {p['operator']!r}; known are {', '.join(PREDICATES)}")
        field = p["field"] or "pk"
        value = F.col(field) if field in ents.columns else F.element_at("metadata", F.lit(field))
        has = ents.groupBy("class").agg(F.count_if(PREDICATES[p["operator"]](value, p["value"])).alias("hits"))
        out = out.unionByName(has.select(F.col("class").alias("scope"), F.lit(p["property"]).alias("property"), F.lit(p["kind"]).alias("kind"), F.lit(None).cast("string").alias("target"), "hits"))
    rows = out.join(size.withColumnRenamed("class", "scope"), "scope").where(F.col("hits") / F.col("n") >= threshold)
    return rows.select("scope", "property", "kind", "target", F.concat_ws("/", F.col("hits").cast("string"), F.col("n").cast("string")).alias("support"), F.bround(F.col("hits") / F.col("n"), 3).alias("confidence"))


def filled_in(template: Column, **values: Column) -> Column:
    """A template with its {names} replaced."""
    for name, v in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), v)
    return template


def rules_by_templates(found: DataFrame, templates: DataFrame) -> DataFrame:
    """(kind, scope, property, target, purpose, condition, action, severity): a rule for each invariant of a kind that has a template."""
    rows = found.select("kind", "scope", F.trim(F.replace("property", F.lit("references::"), F.lit(""))).alias("property"), F.coalesce("target", F.lit("referent")).alias("target"))
    words = {n: F.col(n) for n in ("scope", "property", "target")}
    rows = rows.join(F.broadcast(templates), "kind")  # a row a kind
    return rows.select("kind", "scope", "property", "target", *(filled_in(F.col(c), **words).alias(c) for c in ("purpose", "condition", "action")), "severity")


def queries_by_families(found: DataFrame, families: DataFrame) -> DataFrame:
    """(name, kind, scope, pipeline): the queries that each rule's kind has."""
    words = {"PROP": S.upper_slug(F.col("property")), "SCOPE": S.upper_slug(F.col("scope")), "TARGET": S.upper_slug(F.col("target"))}
    return found.select("kind", "scope", "property", "target").join(F.broadcast(families), "kind").select(filled_in(F.col("template"), **words).alias("name"), "kind", "scope", "pipeline")


def invariants(wb: Workbook, ents: DataFrame, e: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(scope, property, kind, target, support): attributes and relations that at least this share of a class has."""
    size = ents.groupBy("class").agg(F.count("*").alias("size"))
    filled = ents.select("class", F.explode("metadata").alias("property", "value")).where("value <> ''").groupBy("class", "property").agg(F.count("*").alias("n"))
    attribute = filled.select("class", "property", F.lit("attribute").alias("kind"), F.lit(None).cast("string").alias("target"), "n")
    linked = e.groupBy(F.col("src_class").alias("class"), F.col("rel").alias("property"), F.col("dst_class").alias("target")).agg(F.countDistinct("src").alias("n"))
    relation = linked.select("class", "property", F.lit("relationship").alias("kind"), "target", "n")
    rows = attribute.unionByName(relation).join(size, "class")
    return rows.select(F.col("class").alias("scope"), "property", "kind", "target", F.bround(F.col("n") / F.col("size"), 4).alias("support")).where(F.col("support") >= threshold)


def get_name(rel: Column) -> Column:
    """The name of a relation's query or question."""
    return F.concat(F.lit("GET_"), F.replace(F.upper(rel), F.lit(" "), F.lit("_")))


def relation_queries(e: DataFrame) -> DataFrame:
    """(name, rel): a GET_ query for each relation."""
    return e.select("rel").distinct().select(get_name(F.col("rel")).alias("name"), "rel")


def workbook_queries(e: DataFrame) -> DataFrame:
    """(name, objective, relation, attribute, direction, render): the canonical queries and, under other names, one a relation."""
    schema = "name string, objective string, what string, direction string, render string"
    given = e.sparkSession.createDataFrame(list(QUERIES), schema)
    own = relation_queries(e).join(given.select("name"), "name", "left_anti").select("name", F.lit("traverse").alias("objective"), F.col("rel").alias("what"), F.lit("out").alias("direction"), F.lit("tree").alias("render"))
    is_ = lambda k: F.when(F.col("objective") == k, F.col("what"))
    return given.unionByName(own).select("name", "objective", is_("traverse").alias("relation"), is_("attribute").alias("attribute"), "direction", "render")


def relation_groups(e: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(rel, kind) by what a relation joins: structural if a class is at both of its ends, classification if it leads into one class, association otherwise.

    Relations that are only named (column rel), without an edge, are references if they are called ..._name or ..._path, else other.
    """
    rows = e.groupBy("rel").agg(F.collect_set("src_class").alias("into"), F.collect_set("dst_class").alias("out"))  # names of classes
    found = rows.select("rel", F.when(F.arrays_overlap("into", "out"), "Structural").when(F.size("out") == 1, "Classification").otherwise("Association").alias("kind"))
    if named is None:
        return found
    alone = named.select("rel").distinct().join(found, "rel", "left_anti")
    return found.unionByName(alone.select("rel", F.when(F.col("rel").rlike("_(name|path)$"), "Reference").otherwise("Other").alias("kind")))


def relation_names(e: DataFrame) -> list[str]:
    """A name a relation, in order."""
    return [r["rel"] for r in e.select("rel").distinct().orderBy("rel").collect()]


def capabilities(ents: DataFrame, e: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """(class, category, question, supported): of each class, how many entities can answer each question.

    A relation's question is answered by entities with an edge, at either end, of a relation whose name holds the relation's.
    """
    relations = relation_names(e) if relations is None else relations
    ends = e.select("rel", F.explode(F.array("src", "dst")).alias("node_key")).distinct()
    linked = ents.join(ends.select("node_key").distinct().withColumn("linked", F.lit(True)), "node_key", "left")
    yes = {"row": F.lit(True), "name": F.coalesce(F.col("name") != "", F.lit(False)), "edges": F.coalesce("linked", F.lit(False)), "evidence": F.coalesce(F.col("evidence") != "", F.lit(False))}
    counts = linked.groupBy("class").agg(*(F.count_if(c).alias(f"has_{k}") for k, c in yes.items()))
    items = [F.struct(F.lit(c).alias("category"), F.lit(q).alias("question"), F.col(f"has_{k}").alias("supported")) for c, q, k in QUESTIONS]
    fixed = counts.select("class", F.explode(F.array(*items)).alias("x")).select("class", "x.*")
    if not relations:
        return fixed
    # which relations' questions an edge of a relation answers: a row a pair of names that fit
    answers = [(r, q) for r in relations for q in relations if q in r]
    answers = e.sparkSession.createDataFrame(answers, "rel string, asked string")
    hits = ends.join(F.broadcast(answers), "rel").select("node_key", "asked").distinct().join(ents.select("node_key", "class"), "node_key").groupBy("class", "asked").agg(F.count("*").alias("supported"))
    asked = counts.select("class", F.explode(F.array(*(F.lit(r) for r in relations))).alias("asked"))
    rows = asked.join(hits, ["class", "asked"], "left").select("class", F.lit(RELATION_CATEGORY).alias("category"), get_name(F.col("asked")).alias("question"), F.coalesce("supported", F.lit(0)).cast("long").alias("supported"))
    return fixed.unionByName(rows)


def capability_universe(caps: DataFrame) -> DataFrame:
    """(category, question, supported): over all classes."""
    return caps.groupBy("category", "question").agg(F.sum("supported").alias("supported"))


def answerable_by_class(caps: DataFrame) -> DataFrame:
    """(class, questions): how many questions some entity of the class can answer."""
    return caps.groupBy("class").agg(F.count_if(F.col("supported") > 0).alias("questions"))


def promotion_candidates(wb: Workbook, repeat: int = 2, lists: float = 0.2, share: float = 0.6) -> DataFrame:
    """(registry, col, value, members, promoted_id): repeated values of plain columns, which act as entities.

    A column qualifies with at least two values, at most a share of cells that list several, and at most
    max(3, share of rows) distinct ones; keys, names, links and evidence columns don't.
    """
    cells = None
    for s in wb.owners():
        skip = {s.pk, s.label, s.evidence, *(x.column for x in s.links)}
        plain = [c for c in wb.header(s.name) if c not in skip]
        if not plain:
            continue
        items = F.array(*(F.struct(F.lit(c).alias("col"), quoted(c).cast("string").alias("value")) for c in plain))
        part = wb.rows(s.name).select(F.lit(s.name).alias("registry"), F.explode(items).alias("x")).select("registry", "x.col", "x.value")
        cells = part if cells is None else cells.unionByName(part)
    if cells is None:
        return wb.spark.createDataFrame([], "registry string, col string, value string, members long, promoted_id string")
    cells = cells.where((F.trim("value") != "") & ~S.is_null_word(F.col("value")))
    values = cells.groupBy("registry", "col", "value").agg(F.count("*").alias("members"))
    columns = values.groupBy("registry", "col").agg(F.count("*").alias("d"), F.sum("members").alias("n"), F.sum(F.when(F.col("value").contains(";"), F.col("members")).otherwise(0)).alias("listed"), F.max("members").alias("most"))
    fit = columns.where((F.col("d") >= 2) & (F.col("most") >= repeat) & (F.col("listed") <= lists * F.col("n")) & (F.col("d") <= F.greatest(F.lit(3), F.floor(share * F.col("n")))))
    rows = values.where(F.col("members") >= repeat).join(fit.select("registry", "col"), ["registry", "col"])
    return rows.select("registry", "col", "value", "members", F.concat_ws(":", F.lit("VPROM"), S.upper_slug(F.col("col")), S.upper_slug(F.col("value"))).alias("promoted_id"))


def promotion_members(wb: Workbook, column: str, value: str) -> DataFrame:
    """(registry, pk): owner rows that have the value in a column of this name."""
    out = wb.spark.createDataFrame([], "registry string, pk string")
    for s in wb.owners():
        if column in wb.header(s.name):
            out = out.unionByName(wb.rows(s.name).where(quoted(column).cast("string") == value).select(F.lit(s.name).alias("registry"), quoted(s.pk).cast("string").alias("pk")))
    return out


def tier(source: Column) -> Column:
    """The tier of an edge by where it comes from."""
    return F.when(source == "declared", "L1").otherwise("L4")


def tier_confidence(source: Column) -> Column:
    return F.when(source == "declared", S.TIERS["L1"]).otherwise(S.TIERS["L4"])


def relation_tiers(e: DataFrame) -> DataFrame:
    """(rel, tier, confidence): declared wins where a relation has both kinds of edges."""
    best = F.min(F.when(F.col("source") == "declared", "declared").otherwise("inferred"))
    rows = e.groupBy("rel").agg(best.alias("source"))
    return rows.select("rel", tier(F.col("source")).alias("tier"), tier_confidence(F.col("source")).alias("confidence"))


def attach_evidence(e: DataFrame, ents: DataFrame) -> DataFrame:
    """(key, evidence) of entities, by pk, and of edges, by src->dst."""
    rows = ents.where("evidence IS NOT NULL").select(F.col("pk").alias("key"), "evidence")
    links = e.where("evidence IS NOT NULL").select(F.concat("src", F.lit("->"), "dst").alias("key"), "evidence")
    return rows.unionByName(links)


def registry_universe(ents: DataFrame, e: DataFrame) -> DataFrame:
    """(class, entities, outgoing, incoming): sizes of registries and of their relations."""
    n = ents.groupBy("class").agg(F.count("*").alias("entities"))
    out = e.groupBy(F.col("src_class").alias("class")).agg(F.count("*").alias("outgoing"))
    into = e.groupBy(F.col("dst_class").alias("class")).agg(F.count("*").alias("incoming"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(out, "class", "left").join(into, "class", "left").select("class", "entities", zero("outgoing"), zero("incoming"))


def registry_previews(ents: DataFrame, first: int = 6) -> DataFrame:
    """(class, preview): the first few names of each class (keys where there is no name), in entity order."""
    nth = F.row_number().over(Window.partitionBy("class").orderBy("ord"))
    head = ents.withColumn("nth", nth).where(F.col("nth") <= first)
    return head.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("name", "pk").alias("name")))), lambda x: x["name"]).alias("preview"))


def relation_universe(e: DataFrame) -> DataFrame:
    """(rel, n, kind): relations with their numbers of edges and their groups."""
    return e.groupBy("rel").agg(F.count("*").alias("n")).join(relation_groups(e), "rel")


def edge_line(a: str, b: str) -> Column:
    return F.concat(a, F.lit(" -"), "rel", F.lit("-> "), b)


def render_list(rows: DataFrame) -> DataFrame:
    """(pk, name) of entities."""
    return rows.select("pk", "name")


def render_tree(sides: DataFrame, root: str | None) -> DataFrame:
    """(nth, line): the root, then its edges as text, in their order; from rows of both_ways."""
    way = F.when(F.col("dir") == "out", edge_line("node", "other")).otherwise(edge_line("other", "node"))
    lines = sides.select((F.row_number().over(Window.orderBy("step"))).alias("nth"), way.alias("line"))  # the edges of one node
    return sides.sparkSession.createDataFrame([(0, root)], "nth int, line string").unionByName(lines)


def render_edges(sides: DataFrame) -> DataFrame:
    """(line): edges as text, from rows of both_ways."""
    return sides.select(F.when(F.col("dir") == "out", edge_line("node", "other")).otherwise(edge_line("other", "node")).alias("line"))


def render_graph(e: DataFrame, node: str) -> DataFrame:
    """(line): edges at a node as text."""
    return e.where((F.col("src") == node) | (F.col("dst") == node)).select(edge_line("src", "dst").alias("line"))


def stages(wb: Workbook, sheet: str, pk: str, first: int, last: int | None = None) -> DataFrame:
    """(stage, value): one row's columns from a place on, as a timeline."""
    head = wb.header(sheet)[first:last]
    row = wb.rows(sheet).where(quoted(wb.header(sheet)[0]).cast("string") == pk).orderBy(ORD).limit(1)
    return row.select(F.posexplode(F.array(*(F.struct(F.lit(c).alias("stage"), quoted(c).cast("string").alias("value")) for c in head))).alias("nth", "x")).select("nth", "x.stage", "x.value")
