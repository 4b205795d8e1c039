"""Registered queries over a registry workbook made of the driver's tables: prefixed keys, marked links, evidence, states, prose
and flaws (broken links, repeated rows, names that two classes share), so that what looks for flaws has some to find.

Four sheets own entities: Region, Nation, Supplier and Customer Registry; a fifth holds flows from every third customer. Every seventh supplier names a nation that isn't there, every
fifth is dead, every tenth row comes twice, every ninth is called like a nation; odd suppliers have no evidence.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import derive, discovery, explore, graph, identity, integrity, relational
from loomgraph.operators.textindex import normal
from loomgraph.sources.workbook import ORD, Link, Sheet, Workbook, from_csv
from loomgraph.storage import scratch

from . import language, planner
from .session import Engine

CATALOG = (
    Sheet("Region Registry", prefix="REG", evidence="Evidence", entity="Region"),
    Sheet("Nation Registry", prefix="NAT", evidence="Evidence", entity="Nation", links=(Link("Region (FK)", "Region Registry"),)),
    Sheet("Supplier Registry", prefix="SUP", evidence="Evidence", entity="Supplier", links=(Link("Nation (FK)", "Nation Registry"),)),
    Sheet("Customer Registry", prefix="CUS", evidence="Evidence", entity="Customer", links=(Link("Nation (FK)", "Nation Registry"),)),
    Sheet("Flow Registry", owner=False, relations=True),
)
# The sheets in SQL: text keys, links, evidence; supplier rows that come twice have a place after all others.
SHEETS = {
    "Region Registry": "SELECT 'REG-' || r_regionkey AS \"Region ID\", r_name AS \"Name\", CAST(NULL AS STRING) AS \"Evidence\", CAST(r_regionkey AS BIGINT) AS _ord FROM region",
    "Nation Registry": "SELECT 'NAT-' || n_nationkey AS \"Nation ID\", n_name AS \"Name\", 'REG-' || n_regionkey AS \"Region (FK)\", 'geo.py:' || n_nationkey AS \"Evidence\", CAST(n_nationkey AS BIGINT) AS _ord FROM nation",
    "Supplier Registry": """SELECT 'SUP-' || s_suppkey AS "Supplier ID", CASE WHEN s_suppkey % 9 = 0 THEN 'NATION_' || s_suppkey % 25 ELSE s_name END AS "Name",
        CASE WHEN s_suppkey % 7 = 0 THEN 'NAT-99' ELSE 'NAT-' || s_nationkey END AS "Nation (FK)", CASE WHEN s_suppkey % 5 = 0 THEN 'Dead since 1997' ELSE 'Active' END AS "Status",
        'formerly (until 1999); NATION_' || (s_suppkey + 1) % 25 AS "Nation Notes", CASE WHEN s_suppkey % 2 = 0 THEN 'sup.py:' || s_suppkey END AS "Evidence",
        CAST(s_suppkey AS BIGINT) + again * 1000000000 AS _ord FROM supplier, (SELECT 0 AS again UNION ALL SELECT 1) AS t WHERE again = 0 OR s_suppkey % 10 = 0""",
    "Customer Registry": "SELECT 'CUS-' || c_custkey AS \"Customer ID\", c_name AS \"Name\", 'NAT-' || c_nationkey AS \"Nation (FK)\", c_mktsegment AS \"Segment\", 'crm.py:' || c_custkey AS \"Evidence\", CAST(c_custkey AS BIGINT) AS _ord FROM customer",
    "Flow Registry": "SELECT 'FLOW-' || c_custkey AS \"Flow ID\", 'CUS-' || c_custkey AS \"Source (FK)\", 'ships to' AS \"Relation\", 'NAT-' || c_nationkey AS \"Target (FK)\", CASE WHEN c_custkey % 2 = 0 THEN 'Data' ELSE 'Control' END AS \"Flow Type\", 'flow.py:' || c_custkey AS \"Evidence\", CAST(c_custkey AS BIGINT) AS _ord FROM customer WHERE c_custkey % 3 = 0",
}
_engines: dict[tuple[str, str], Engine] = {}


def workbook(spark: SparkSession, sf_dir: str) -> Workbook:
    frames = {}
    for name, sql in SHEETS.items():
        for t in ("region", "nation", "supplier", "customer"):
            sql = sql.replace(f" FROM {t}", f" FROM parquet.`{sf_dir}/{t}.parquet`")
        frames[name] = spark.sql(sql.replace('"', "`"))
    return Workbook(spark, frames).with_catalog(CATALOG)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The compiled registry workbook of a folder, kept for the session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        _engines[key] = Engine(workbook(spark, sf_dir))
    return _engines[key]


PRELUDE = (
    "WITH RECURSIVE "
    + ", ".join(f"{n.split()[0].lower()}_sheet AS ({sql.replace('AS STRING', 'AS VARCHAR')})" for n, sql in SHEETS.items())
    + """,
all_rows AS (
  SELECT 'Region Registry' AS class, "Region ID" AS pk, "Name" AS name, "Evidence" AS evidence, 0 AS sheet, _ord FROM region_sheet
  UNION ALL SELECT 'Nation Registry', "Nation ID", "Name", "Evidence", 1, _ord FROM nation_sheet
  UNION ALL SELECT 'Supplier Registry', "Supplier ID", "Name", "Evidence", 2, _ord FROM supplier_sheet
  UNION ALL SELECT 'Customer Registry', "Customer ID", "Name", "Evidence", 3, _ord FROM customer_sheet),
ent AS (SELECT * FROM all_rows QUALIFY row_number() OVER (PARTITION BY pk ORDER BY sheet, _ord) = 1),
raw AS (
  SELECT 'Nation Registry' AS sc, "Nation ID" AS sp, 'Region (FK)' AS col, 'region' AS rel, "Region (FK)" AS dp, "Evidence" AS evidence, 'declared' AS source FROM nation_sheet
  UNION ALL SELECT 'Supplier Registry', "Supplier ID", 'Nation (FK)', 'nation', "Nation (FK)", "Evidence", 'declared' FROM supplier_sheet
  UNION ALL SELECT 'Customer Registry', "Customer ID", 'Nation (FK)', 'nation', "Nation (FK)", "Evidence", 'declared' FROM customer_sheet
  UNION ALL SELECT 'Customer Registry', "Source (FK)", 'Flow', 'ships to', "Target (FK)", "Evidence", 'declared' FROM flow_sheet
  UNION ALL SELECT 'Supplier Registry', s."Supplier ID", 'Nation Notes', 'nation_notes', n."Nation ID", s."Evidence", 'inferred'
    FROM supplier_sheet s JOIN nation_sheet n ON lower(n."Name") = lower(trim(split_part(s."Nation Notes", ';', 2)))),
edges AS (SELECT sp AS src, rel, e.pk AS dst, sc AS src_class, e.class AS dst_class, raw.evidence, source FROM raw JOIN ent e ON e.pk = dp),
sides AS (
  SELECT src AS node, dst AS other, rel, 'out' AS dir, dst_class AS other_class, evidence FROM edges
  UNION ALL SELECT dst, src, rel, 'in', src_class, evidence FROM edges)
"""
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = PRELUDE + sql
        return f

    return add


def one(spark: SparkSession, value: object, kind: str = "long", name: str = "value") -> DataFrame:
    return spark.createDataFrame([(value,)], f"{name} {kind}")


# --- entities and edges ----------------------------------------------------------------------------------------------


@query("SELECT pk AS node_key, class, pk, name, evidence, coalesce(regexp_matches(evidence, '\\.py:\\d+|:\\d+'), FALSE) AS has_evidence FROM ent")
def reg_entities(spark, d):
    return engine(spark, d).entities.select("node_key", "class", "pk", "name", "evidence", "has_evidence")


@query("SELECT src, rel, dst, src_class, dst_class, evidence, source FROM edges")
def reg_edges(spark, d):
    """Links and, from the notes, names in prose."""
    return engine(spark, d).edges.select("src", "rel", "dst", "src_class", "dst_class", "evidence", "source")


# Orders, customers, nations and regions, of which some orders name a nation and some customers a region themselves: pairs
# of classes that an edge joins for a part of their entities only.
MIXED = {
    "region": "SELECT CAST(r_regionkey AS BIGINT) AS _ord, 'R' || r_regionkey AS id, r_name AS name FROM region",
    "nation": "SELECT CAST(n_nationkey AS BIGINT) AS _ord, 'N' || n_nationkey AS id, n_name AS name, 'R' || n_regionkey AS region FROM nation",
    "customer": "SELECT CAST(c_custkey AS BIGINT) AS _ord, 'C' || c_custkey AS id, c_name AS name, 'N' || c_nationkey AS nation, CASE WHEN c_custkey % 3 = 0 THEN 'R' || c_custkey % 5 END AS region FROM customer",
    "orders": "SELECT CAST(o_orderkey AS BIGINT) AS _ord, 'O' || o_orderkey AS id, o_orderstatus AS name, CASE WHEN o_orderkey % 4 > 0 THEN 'C' || o_custkey END AS customer, CASE WHEN o_orderkey % 5 = 0 THEN 'N' || o_orderkey % 25 END AS nation FROM orders",
}
MIXED_CATALOG = (
    Sheet("region", pk="id", label="name"),
    Sheet("nation", pk="id", label="name", links=(Link("region", "region"),)),
    Sheet("customer", pk="id", label="name", links=(Link("nation", "nation"), Link("region", "region"))),
    Sheet("orders", pk="id", label="name", links=(Link("customer", "customer"), Link("nation", "nation"))),
)


def mixed_engine(spark: SparkSession, sf_dir: str) -> Engine:
    key = (spark.sparkContext.applicationId, f"mixed {sf_dir}")
    if key not in _engines:
        frames = {n: spark.sql(sql.replace(f" FROM {n}", f" FROM parquet.`{sf_dir}/{n}.parquet`")) for n, sql in MIXED.items()}
        _engines[key] = Engine(Workbook(spark, frames).with_catalog(MIXED_CATALOG))
    return _engines[key]


MIXED_SQL = "WITH RECURSIVE " + ", ".join(f"{n}_sheet AS ({sql})" for n, sql in MIXED.items()) + """,
cls AS (SELECT id, 'region' AS class FROM region_sheet UNION ALL SELECT id, 'nation' FROM nation_sheet UNION ALL SELECT id, 'customer' FROM customer_sheet UNION ALL SELECT id, 'orders' FROM orders_sheet),
links AS (
  SELECT id AS src, 'region' AS rel, region AS dst, 0 AS nth FROM nation_sheet UNION ALL SELECT id, 'nation', nation, 0 FROM customer_sheet
  UNION ALL SELECT id, 'region', region, 1 FROM customer_sheet UNION ALL SELECT id, 'customer', customer, 0 FROM orders_sheet UNION ALL SELECT id, 'nation', nation, 1 FROM orders_sheet),
e AS (SELECT src, rel, dst, nth, a.class AS sc, b.class AS dc FROM links JOIN cls a ON a.id = src JOIN cls b ON b.id = dst),
near AS (SELECT src AS id, dc AS other FROM e UNION SELECT dst, sc FROM e),
walk AS (
  SELECT src AS origin, dst AS at, dc, 1 AS hop, [nth] AS place, rel AS relations, src || ' ' || dst AS path FROM e
  UNION ALL SELECT origin, e.dst, e.dc, hop + 1, list_append(place, e.nth), relations || ' ' || e.rel, path || ' ' || e.dst FROM walk JOIN e ON e.src = walk.at WHERE hop < 5),
short AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY origin, dc ORDER BY hop, place) = 1),
hits AS (SELECT c.class AS sc, s.* FROM short s JOIN cls c ON c.id = s.origin WHERE c.class <> s.dc AND NOT EXISTS (SELECT 1 FROM near WHERE near.id = s.origin AND near.other = s.dc)),
sizes AS (SELECT a.class AS sc, b.class AS dc, count(*) FILTER (NOT EXISTS (SELECT 1 FROM near WHERE near.id = a.id AND near.other = b.class)) AS candidates FROM cls a, (SELECT DISTINCT class FROM cls) b GROUP BY ALL)
"""


def _reach_query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    ORACLES[f.__name__] = MIXED_SQL + """
SELECT sc AS source_class, dc AS target_class, arg_min(relations, origin) AS relation_pattern, arg_min(hop, origin) AS hops, min(origin) AS example_source,
       arg_min(path, origin) AS example_path, count(*) AS confirmed, any_value(candidates) AS candidates, round(1.0 / arg_min(hop, origin), 2) AS confidence
FROM hits JOIN sizes USING (sc, dc) GROUP BY sc, dc"""
    return f


@_reach_query
def reg_mixed_reachability(spark, d):
    """Ways between classes that some entities have an edge for, and examples of them."""
    rows = mixed_engine(spark, d).reachability
    return rows.withColumns({c: F.array_join(c, " ") for c in ("relation_pattern", "example_path")})


@query("SELECT src, dst, 0 AS how FROM edges WHERE source = 'inferred'")
def reg_prose_edges(spark, d):
    e = engine(spark, d)
    return discovery.prose_edges(e.wb, e.entities).select("src", "dst", "how")


@query("SELECT rel, CASE WHEN bool_or(source = 'declared') THEN 'L1' ELSE 'L4' END AS tier, CASE WHEN bool_or(source = 'declared') THEN 1.0::DOUBLE ELSE 0.62::DOUBLE END AS confidence FROM edges GROUP BY rel")
def reg_relation_tiers(spark, d):
    return derive.relation_tiers(engine(spark, d).edges)


@query("SELECT pk, class, name FROM ent WHERE split_part(pk, '-', 1) = 'NAT'")
def reg_list_entities(spark, d):
    return engine(spark, d).list_entities("nat").select("pk", "class", "name")


@query("SELECT split_part(pk, '-', 1) AS prefix, CASE split_part(pk, '-', 1) WHEN 'NAT' THEN 'Nation Registry' WHEN 'REG' THEN 'Region Registry' WHEN 'SUP' THEN 'Supplier Registry' WHEN 'CUS' THEN 'Customer Registry' END AS name, count(*) AS n FROM ent GROUP BY 1")
def reg_owner_of_prefix(spark, d):
    """The sheets that own the prefixes that entities have."""
    e = engine(spark, d)
    found = e.entities.groupBy(S.id_prefix(F.col("pk")).alias("prefix")).agg(F.count("*").alias("n")).collect()  # a row a prefix
    return spark.createDataFrame([(r["prefix"], (o := e.wb.owner_of_prefix(r["prefix"])) and o.name, r["n"]) for r in found], "prefix string, name string, n long")


# Two sheets without a catalog: their keys are found, numbered and rewritten, and so is the column that holds the other's keys.
UNKNOWN = {
    "Nations": "SELECT CAST(n_nationkey AS BIGINT) + 100 AS _ord, n_nationkey * 7 AS \"Nation Key\", n_name AS \"Name\" FROM nation",
    "Vendors": "SELECT CAST(s_suppkey AS BIGINT) * 3 AS _ord, 'V' || s_suppkey AS \"Vendor Code\", s_name AS \"Name\", s_nationkey * 7 AS \"Home\" FROM supplier",
}


def reg_rewritten_keys(spark, d):
    """Keys as PREFIX-nnn by the row's number, and links rewritten alike, of sheets that declare nothing."""
    frames = {n: spark.sql(sql.replace('"', "`").replace(" FROM nation", f" FROM parquet.`{d}/nation.parquet`").replace(" FROM supplier", f" FROM parquet.`{d}/supplier.parquet`")) for n, sql in UNKNOWN.items()}
    wb = discovery.discovered(Workbook(spark, frames))
    rows = [wb.frame(s.name).select(F.lit(s.name).alias("sheet"), F.col(f"`{s.pk}`").alias("pk"), F.col("Name").alias("name"), (F.col(f"`{s.links[0].column}`") if s.links else F.lit(None).cast("string")).alias("link")) for s in wb.catalog]
    return rows[0].unionByName(rows[1])


QUERIES["reg_rewritten_keys"] = reg_rewritten_keys
ORACLES["reg_rewritten_keys"] = f"""WITH n AS ({UNKNOWN["Nations"]}), v AS ({UNKNOWN["Vendors"]}),
nk AS (SELECT *, 'NATI-' || lpad(CAST(row_number() OVER (ORDER BY _ord) AS VARCHAR), 3, '0') AS pk FROM n)
SELECT 'Nations' AS sheet, pk, "Name" AS name, NULL AS link FROM nk
UNION ALL SELECT 'Vendors', 'VEND-' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END, v."Name", nk.pk
FROM (SELECT *, row_number() OVER (ORDER BY _ord) AS r FROM v) v JOIN nk ON nk."Nation Key" = v."Home\""""


@query("""
, t(token, how, found) AS (VALUES ('NAT-3', 'id', 1), ('Supplier:supplier#000000001', 'class_name', 1), ('supplier#000000002', 'name', 1), ('Active', 'promoted', 1), ('zzqx-77', 'unresolved', 0))
SELECT token, how, CAST(found AS BIGINT) AS found FROM t UNION ALL
SELECT 'nation_0', CASE WHEN count(*) = 1 THEN 'name' ELSE 'ambiguous_name' END, count(*) FROM ent WHERE lower(name) = 'nation_0'
UNION ALL SELECT 'plier#00000000', 'fuzzy', least(8, count(*)) FROM ent WHERE contains(lower(name), 'plier#00000000')""")
def reg_resolution_stages(spark, d):
    e = engine(spark, d)
    rows = []
    for token in ("NAT-3", "Supplier:supplier#000000001", "supplier#000000002", "Active", "zzqx-77", "nation_0", "plier#00000000"):
        r = e.resolve(token)
        rows.append((token, r.how, r.total))
    return spark.createDataFrame(rows, "token string, how string, found long")


# Suppliers with names of several words, of which some are shared.
PHRASES = "SELECT CAST(s_suppkey AS BIGINT) AS _ord, 'S-' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 1 THEN 'Left Shoulder ' || s_suppkey ELSE 'Upper  Arm, ' || s_suppkey % 4 END AS name, 'sup.py:' || s_suppkey AS Evidence FROM supplier"
QUESTION = "evidence left shoulder 3, upper arm 2 and Upper Arm 77 of S-2"


def phrase_engine(spark: SparkSession, sf_dir: str) -> Engine:
    key = (spark.sparkContext.applicationId, f"phrases {sf_dir}")
    if key not in _engines:
        frame = spark.sql(PHRASES.replace(" FROM supplier", f" FROM parquet.`{sf_dir}/supplier.parquet`"))
        _engines[key] = Engine(Workbook(spark, {"Part Registry": frame}).with_catalog([Sheet("Part Registry", pk="id", label="name", evidence="Evidence", entity="Part")]))
    return _engines[key]


def _phrase_query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH p AS ({PHRASES}), n AS (SELECT *, regexp_replace(lower(name), '[\\s,]+', ' ', 'g') AS phrase FROM p)\n" + sql
        return f

    return add


@_phrase_query("SELECT phrase, id AS pk FROM n WHERE phrase IN ('left shoulder 3', 'upper arm 2', 'upper arm 77') QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY _ord) <= 8")
def reg_phrases(spark, d):
    """Names of several words in a question; of a shared name the first eight entities."""
    e = phrase_engine(spark, d)
    found = e.names.phrases(normal(r) for r in language.runs(QUESTION, 5))
    return spark.createDataFrame([(p, x["pk"]) for p, xs in found.items() for x in xs], "phrase string, pk string")


@_phrase_query("""SELECT 'evidence' AS text, 'concept' AS kind, 0 AS n UNION ALL SELECT 'left shoulder 3,', 'entity', 0 UNION ALL SELECT 'S-2', 'entity', 0 UNION ALL SELECT 'of', 'concept', 0
UNION ALL SELECT 'and', 'concept', 0 UNION ALL SELECT 'upper arm 2', CASE WHEN count(*) = 1 THEN 'entity' ELSE 'ambiguous' END, CASE WHEN count(*) = 1 THEN 0 ELSE least(8, count(*)) END FROM n WHERE phrase = 'upper arm 2'
UNION ALL SELECT 'Upper', 'unresolved', 0 UNION ALL SELECT 'Arm', 'unresolved', 0 UNION ALL SELECT '77', 'number', 0""")
def reg_phrase_meanings(spark, d):
    """What the words of a question mean, names of several words and shared ones included."""
    made = phrase_engine(spark, d).plan(QUESTION)
    return spark.createDataFrame([(m.text, m.kind, len(m.candidates) if m.kind == "ambiguous" else 0) for m in made["meanings"]], "text string, kind string, n int")


@query("SELECT pk, class FROM ent WHERE pk = 'SUP-2'")
def reg_typo(spark, d):
    """A mistyped name finds its entity."""
    e = engine(spark, d)
    found = e.resolve("Suplier#000000002")
    near = spark.createDataFrame([(found.found[0]["pk"], found.found[0]["class"])], "pk string, class string")
    return near.where(F.lit(found.how == "typo"))


@query("""SELECT kind, count(*) AS n FROM (VALUES ('number'), ('concept'), ('workbook'), ('entity'), ('unresolved')) AS t(kind) GROUP BY kind""")
def reg_classify_words(spark, d):
    e = engine(spark, d)
    return spark.createDataFrame([(e.classify_word(w).kind,) for w in ("12", "count", "suppliers", "SUP-1", "blorp")], "kind string").groupBy("kind").agg(F.count("*").alias("n"))


@query("""
, mine AS (SELECT * FROM sides WHERE node = 'CUS-3'), sib AS (SELECT count(DISTINCT src) AS n FROM edges WHERE src <> 'CUS-3' AND (rel, dst) IN (SELECT (rel, dst) FROM edges WHERE src = 'CUS-3')),
  far AS (SELECT count(DISTINCT c.src) AS confirmed, min(c.src) AS first FROM edges c JOIN edges n ON n.src = c.dst AND n.dst_class = 'Region Registry' WHERE c.src_class = 'Customer Registry'),
  size AS (SELECT count(*) AS n FROM ent WHERE class = 'Customer Registry'),
  a(id, label, mode, count, capability, confidence, evidence) AS (
    SELECT 'attribute::class::', 'What is', 'fixed', 1, 'Identity', 1.0, 'owner registry row' UNION ALL SELECT 'attribute::name::', 'Name', 'fixed', 1, 'Identity', 1.0, 'owner registry row'
    UNION ALL SELECT 'relation_direct::' || rel || '::Nation Registry', CASE rel WHEN 'nation' THEN 'Nation' ELSE 'Ships To' END, 'direct', count(*), 'Relationships', 1.0, 'Relationship (Universal Property Graph)' FROM mine GROUP BY rel
    UNION ALL SELECT 'relation_discovered::region::Region Registry', 'Region', 'discovered', -1, 'Relationships', round_even(CAST(confirmed AS DOUBLE) / n, 3), CASE WHEN first IN (SELECT src FROM edges WHERE rel = 'ships to') THEN 'ships to' ELSE 'nation' END || ' -> region (' || confirmed || '/' || n || ')' FROM far, size
    UNION ALL SELECT 'attribute::' || c || '::', c, 'fixed', 1, 'Attributes', 1.0, 'owner registry row' FROM (VALUES ('Nation (FK)'), ('Segment')) AS t(c)
    UNION ALL SELECT 'neighbors::*::', 'Neighbors', 'fixed', count(*), 'Relationships', 1.0, 'Universal Property Graph' FROM mine
    UNION ALL SELECT 'meta::evidence::', 'Evidence', 'fixed', 1, 'Evidence', 1.0, 'owner registry row' UNION ALL SELECT 'meta::source_row::', 'Source row', 'fixed', 5, 'Evidence', 1.0, 'owner registry row'
    UNION ALL SELECT 'analysis::ANALYZE_ENTITY::', 'Analyze this entity', 'analysis', 1, 'Analysis', 1.0, 'graph + registry (derived)'
    UNION ALL SELECT 'analysis::COMPARE_SIBLINGS::', 'Compare with siblings', 'analysis', n, 'Analysis', CAST(n > 0 AS INTEGER), CASE WHEN n > 0 THEN 'graph + registry (derived)' ELSE 'No siblings share a direct parent.' END FROM sib
    UNION ALL SELECT 'analysis::COMPARE_LAYER::', 'Compare with layer', 'analysis', n - 1, 'Analysis', 1.0, 'graph + registry (derived)' FROM size)
SELECT id, label, mode, CAST(count AS BIGINT) AS count, capability, CAST(confidence AS DOUBLE) AS confidence, evidence FROM a""")
def reg_entity_menu(spark, d):
    """All actions of a customer that has flows."""
    return engine(spark, d).menu("CUS-3").select("id", "label", "mode", "count", "capability", "confidence", "evidence")


@query("""
, c AS (
  SELECT 'Nation Registry' AS sheet, _ord AS row, 'Nation ID' AS col FROM nation_sheet WHERE "Nation ID" = 'NAT-3' UNION ALL SELECT 'Supplier Registry', _ord, 'Nation (FK)' FROM supplier_sheet WHERE "Nation (FK)" = 'NAT-3'
  UNION ALL SELECT 'Customer Registry', _ord, 'Nation (FK)' FROM customer_sheet WHERE "Nation (FK)" = 'NAT-3' UNION ALL SELECT 'Flow Registry', _ord, 'Target (FK)' FROM flow_sheet WHERE "Target (FK)" = 'NAT-3'),
  others AS (SELECT string_agg(DISTINCT sheet, ',' ORDER BY sheet) AS s FROM c WHERE sheet <> 'Nation Registry')
SELECT 'occurrences' AS observation, CAST(count(*) AS VARCHAR) AS value FROM c UNION ALL SELECT 'sheets', string_agg(DISTINCT sheet, ',' ORDER BY sheet) FROM c
UNION ALL SELECT 'columns', string_agg(DISTINCT sheet || '.' || col, ',' ORDER BY sheet || '.' || col) FROM c UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT sheet, row FROM c)
UNION ALL SELECT 'files', 'geo.py:3' UNION ALL SELECT 'keys', 'Nation Registry <- ' || s FROM others UNION ALL SELECT 'neighbors', CAST(count(*) AS VARCHAR) FROM sides WHERE node = 'NAT-3'
UNION ALL SELECT 'hierarchy', 'Region (FK)=' || "Region (FK)" || ' > ' || s FROM nation_sheet, others WHERE "Nation ID" = 'NAT-3'
UNION ALL SELECT 'duplicates', CAST(count(DISTINCT sheet) AS VARCHAR) FROM c UNION ALL SELECT 'metadata', 'NAT-3,' || "Name" || ',' || "Region (FK)" || ',' || "Evidence" FROM nation_sheet WHERE "Nation ID" = 'NAT-3'""")
def reg_observations(spark, d):
    """The ten observations of a nation."""
    e = engine(spark, d)
    o = e.observe("NAT-3")
    rows = [("occurrences", str(o["occurrences"])), ("sheets", ",".join(o["sheets"])), ("columns", ",".join(o["columns"])), ("rows", str(o["rows"])), ("files", ",".join(f for f in o["files"] if f.startswith("geo"))), ("keys", f"{o['keys']['pk_in']} <- {','.join(o['keys']['fk_in'])}"), ("neighbors", str(o["neighbors"].count()))]
    rows += [("hierarchy", ",".join(f"{p['role']}={p['id']}" for p in o["hierarchy"]["parents"]) + " > " + ",".join(o["hierarchy"]["children"])), ("duplicates", str(o["duplicates"]["count"])), ("metadata", ",".join(o["metadata"][c] for c in e.wb.header("Nation Registry")))]
    return spark.createDataFrame(rows, "observation string, value string")


# Parts that name their nation by key, by an identifier within a text, by name, and not at all.
STAGED = {
    "Place Registry": "SELECT CAST(n_nationkey AS BIGINT) AS _ord, 'PLC-' || n_nationkey AS id, n_name AS name FROM nation",
    "Part Registry": """SELECT CAST(s_suppkey AS BIGINT) AS _ord, 'PRT-' || s_suppkey AS id, s_name AS name, CASE s_suppkey % 5 WHEN 0 THEN 'PLC-' || s_nationkey || '; PLC-0'
        WHEN 1 THEN 'see PLC-' || s_nationkey || ' (new)' WHEN 2 THEN 'nation_' || s_nationkey || ' / NATION_1' WHEN 3 THEN 'PLC-777' ELSE 'nowhere at all' END AS place FROM supplier""",
}


def staged_engine(spark: SparkSession, sf_dir: str) -> Engine:
    key = (spark.sparkContext.applicationId, f"staged {sf_dir}")
    if key not in _engines:
        frames = {n: spark.sql(sql.replace(" FROM nation", f" FROM parquet.`{sf_dir}/nation.parquet`").replace(" FROM supplier", f" FROM parquet.`{sf_dir}/supplier.parquet`")) for n, sql in STAGED.items()}
        _engines[key] = Engine(Workbook(spark, frames).with_catalog([Sheet("Place Registry", pk="id", label="name"), Sheet("Part Registry", pk="id", label="name", links=(Link("place"),))]))
    return _engines[key]


def reg_link_stages(spark, d):
    """Entities that the parts of link cells name, with the stage that found them."""
    e = staged_engine(spark, d)
    rows = graph.linked(e.wb, e.entities)
    return rows.select("src_pk", F.col("at.nth").alias("nth"), "part", "dst", F.element_at(F.array(*(F.lit(x) for x in graph.STAGES)), F.col("stage") + 1).alias("stage"))


QUERIES["reg_link_stages"] = reg_link_stages
ORACLES["reg_link_stages"] = f"""WITH place AS ({STAGED["Place Registry"]}), part AS ({STAGED["Part Registry"]}),
parts AS (SELECT id AS src_pk, trim(unnest(string_split_regex(place, '[;,/|]'))) AS part, generate_subscripts(string_split_regex(place, '[;,/|]'), 1) - 1 AS nth FROM part),
hits AS (
  SELECT parts.*, place.id AS dst, 'key' AS stage, 0 AS k FROM parts JOIN place ON place.id = part
  UNION ALL SELECT parts.*, place.id, 'id in text', 1 FROM parts JOIN place ON list_contains(regexp_extract_all(part, '[A-Za-z]+-\\w+'), place.id)
  UNION ALL SELECT parts.*, arg_min(place.id, place._ord), 'name', 2 FROM parts JOIN place ON lower(place.name) = lower(part) GROUP BY ALL)
SELECT src_pk, CAST(nth AS INTEGER) AS nth, part, dst, stage FROM hits QUALIFY k = min(k) OVER (PARTITION BY src_pk, nth)"""


# --- flaws -----------------------------------------------------------------------------------------------------------


@query("SELECT sc AS registry, sp AS pk, col AS \"column\", dp AS token FROM raw WHERE source = 'declared' AND dp NOT IN (SELECT pk FROM ent)")
def reg_check_fk(spark, d):
    e = engine(spark, d)
    return integrity.check_fk(e.wb, e.entities)


@query("SELECT 'Supplier Registry' AS registry, \"Supplier ID\" AS pk, 'Status' AS \"column\", \"Status\" AS value FROM supplier_sheet WHERE starts_with(lower(\"Status\"), 'dead')")
def reg_find_dead(spark, d):
    return integrity.find_dead(engine(spark, d).wb)


@query("SELECT class AS registry, pk, count(*) AS n FROM all_rows GROUP BY ALL HAVING count(*) > 1")
def reg_duplicate_pks(spark, d):
    return integrity.duplicate_pks(engine(spark, d).wb)


@query("SELECT pk, count(*) AS n FROM all_rows GROUP BY pk HAVING count(*) > 1")
def reg_shared_pks(spark, d):
    return integrity.shared_pks(engine(spark, d).wb)


@query("SELECT name, count(DISTINCT class) AS n_classes FROM ent WHERE name <> '' GROUP BY name HAVING count(DISTINCT class) > 1")
def reg_duplicate_names(spark, d):
    return integrity.duplicate_names(engine(spark, d).entities)


CHANGES = ", changed AS (SELECT lower(trim(name)) AS name, class <> lag(class) OVER (PARTITION BY lower(trim(name)) ORDER BY sheet, _ord) AS other FROM ent WHERE trim(name) <> '')\n"


@query(CHANGES + "SELECT name, count(*) AS n FROM changed WHERE other GROUP BY name")
def reg_name_changes(spark, d):
    return integrity.name_changes(engine(spark, d).entities)


CHECKS = CHANGES + """, m AS (SELECT count(*) AS n, count(*) FILTER (NOT coalesce(regexp_matches(evidence, '\\.py:\\d+|:\\d+'), FALSE)) AS missing FROM ent),
c AS (
  SELECT 'objects' AS metric, n AS value FROM m UNION ALL SELECT 'types', 4 UNION ALL SELECT 'relationships', count(*) FROM edges
  UNION ALL SELECT 'duplicate_pk', count(*) FROM (SELECT pk FROM all_rows GROUP BY pk HAVING count(*) > 1)
  UNION ALL SELECT 'broken_fk', count(*) FROM raw WHERE source = 'declared' AND dp NOT IN (SELECT pk FROM ent)
  UNION ALL SELECT 'empty_registries', 4 - count(DISTINCT class) FROM all_rows
  UNION ALL SELECT 'missing_evidence', missing FROM m UNION ALL SELECT 'missing_evidence_pct', CAST(round_even(100.0 * missing / n, 0) AS BIGINT) FROM m
  UNION ALL SELECT 'duplicate_names', count(*) FROM changed WHERE other
  UNION ALL SELECT 'schema_catalog', 1 UNION ALL SELECT 'schema_evidence', 1 UNION ALL SELECT 'schema_fk', CAST(count(*) > 0 AS BIGINT) FROM edges)
"""


@query(CHECKS + "SELECT metric, CAST(value AS BIGINT) AS value FROM c")
def reg_validation_checks(spark, d):
    return spark.createDataFrame(list(engine(spark, d).checks().items()), "metric string, value long")


@query(CHECKS + """, v AS (SELECT max(value) FILTER (metric = 'broken_fk') AS f, max(value) FILTER (metric = 'duplicate_pk') AS d, max(value) FILTER (metric = 'empty_registries') AS e, max(value) FILTER (metric = 'missing_evidence_pct') AS p FROM c)
SELECT CAST(greatest(0, 100 - least(20, 2 * f) - least(20, 5 * d) - least(10, 3 * e) - CASE WHEN p > 20 THEN least(15, (p - 20) // 5) ELSE 0 END) AS BIGINT) AS value FROM v""")
def reg_confidence(spark, d):
    return one(spark, engine(spark, d).confidence())


@query("""SELECT class AS registry, pk FROM all_rows JOIN (SELECT "Region ID" AS pk FROM region_sheet UNION ALL SELECT DISTINCT "Supplier ID" FROM supplier_sheet WHERE "Evidence" IS NULL) USING (pk)""")
def reg_missing_evidence(spark, d):
    return integrity.find_missing_evidence(engine(spark, d).wb, None)


# --- derivation ------------------------------------------------------------------------------------------------------

INVARIANTS = """
, n AS (SELECT class, count(*) AS n FROM ent GROUP BY class),
found AS (
  SELECT class AS scope, 'has_PK' AS property, 'attribute' AS kind, CAST(NULL AS VARCHAR) AS target, count(pk) AS hits FROM ent GROUP BY class
  UNION ALL SELECT class, 'has_Evidence', 'attribute', NULL, count(*) FILTER (regexp_matches(evidence, '\\.py:\\d+|:\\d+')) FROM ent GROUP BY class
  UNION ALL SELECT src_class, 'references::' || rel, 'relationship', dst_class, count(DISTINCT src) FROM edges GROUP BY ALL),
inv AS (SELECT scope, property, kind, target, hits || '/' || n AS support, round(hits / n, 3) AS confidence FROM found JOIN n ON class = scope WHERE hits / n >= 1),
rules AS (
  SELECT kind, scope, replace(property, 'references::', '') AS property, coalesce(target, 'referent') AS target, 'ERROR' AS severity,
    CASE kind WHEN 'attribute' THEN 'Every ' || scope || ' MUST have ' || property || '.' ELSE 'Every ' || scope || ' MUST reference an existing ' || target || '.' END AS purpose,
    CASE kind WHEN 'attribute' THEN property || ' is present on the ' || scope || ' row' ELSE replace(property, 'references::', '') || ' resolves to an existing ' || target || ' PK' END AS condition,
    CASE kind WHEN 'attribute' THEN 'flag ' || scope || ' rows missing ' || property ELSE 'flag ' || scope || ' rows whose ' || replace(property, 'references::', '') || ' is missing/dangling' END AS action
  FROM inv)
"""


@query(INVARIANTS + "SELECT * FROM inv")
def reg_property_invariants(spark, d):
    return engine(spark, d).property_invariants()


@query(INVARIANTS + "SELECT * FROM rules")
def reg_rules(spark, d):
    return engine(spark, d).derive_all()["rules"]


@query(INVARIANTS + """, s AS (SELECT kind, scope, replace(upper(scope), ' ', '_') AS u, replace(upper(property), ' ', '_') AS p, replace(upper(target), ' ', '_') AS t FROM rules)
SELECT 'LIST_MISSING_' || p AS name, kind, scope, 'find_missing_evidence → render_table' AS pipeline FROM s WHERE kind = 'attribute'
UNION ALL SELECT 'VALIDATE_' || u || '_' || p, kind, scope, 'check_fk → render_table' FROM s WHERE kind = 'attribute'
UNION ALL SELECT 'TRACE_OWNER_' || t, kind, scope, 'resolve_entity → walk_parent → attach_evidence → render_tree' FROM s WHERE kind = 'relationship'
UNION ALL SELECT 'VALIDATE_' || u || '_REFERENCE', kind, scope, 'check_fk → render_table' FROM s WHERE kind = 'relationship'
UNION ALL SELECT 'LIST_' || u || '_ORPHANS', kind, scope, 'find_orphan → render_list' FROM s WHERE kind = 'relationship'""")
def reg_derived_queries(spark, d):
    return engine(spark, d).derive_all()["queries"]


@query("""
, given(name, objective, relation, attribute, direction, render) AS (VALUES
  ('GET_HANDLER', 'traverse', 'handler', NULL, 'out', 'tree'), ('GET_GATE', 'traverse', 'gate', NULL, 'out', 'tree'), ('GET_PIPELINE', 'traverse', 'pipeline', NULL, 'out', 'tree'),
  ('GET_BRIDGE', 'traverse', 'bridge', NULL, 'out', 'tree'), ('GET_VALIDATOR', 'traverse', 'validator', NULL, 'out', 'tree'), ('GET_OWNER', 'traverse', 'module', NULL, 'out', 'tree'),
  ('GET_CATEGORY', 'traverse', 'category', NULL, 'out', 'tree'), ('GET_PRODUCERS', 'traverse', 'produces', NULL, 'in', 'graph'), ('GET_CONSUMERS', 'traverse', 'consumes', NULL, 'out', 'graph'),
  ('GET_UPSTREAM', 'traverse', '*', NULL, 'in', 'graph'), ('GET_DOWNSTREAM', 'traverse', '*', NULL, 'out', 'graph'), ('GET_EVIDENCE', 'attribute', NULL, 'evidence', NULL, 'table'),
  ('VALIDATE_REFERENCES', 'validate', NULL, NULL, NULL, 'table'), ('GET_NEIGHBORS', 'traverse', '*', NULL, 'both', 'graph'))
SELECT * FROM given UNION ALL SELECT DISTINCT 'GET_' || replace(upper(rel), ' ', '_'), 'traverse', rel, NULL, 'out', 'tree' FROM edges""")
def reg_workbook_queries(spark, d):
    return derive.workbook_queries(engine(spark, d).edges)


CAPABILITIES = """
, q(category, question, kind) AS (VALUES
  ('Identity', 'WHAT_IS', 'row'), ('Identity', 'GET_NAME', 'name'), ('Identity', 'GET_PURPOSE', 'row'), ('Relationships', 'GET_NEIGHBORS', 'edges'), ('Relationships', 'GET_INCOMING', 'edges'),
  ('Relationships', 'GET_OUTGOING', 'edges'), ('Dependency', 'GET_UPSTREAM', 'edges'), ('Dependency', 'GET_DOWNSTREAM', 'edges'), ('Dependency', 'IS_ROOT', 'edges'), ('Dependency', 'IS_LEAF', 'edges'),
  ('Integrity', 'CHECK_FK', 'row'), ('Integrity', 'IS_ORPHAN', 'row'), ('Integrity', 'IS_DUPLICATE', 'row'), ('Coverage', 'MISSING_EVIDENCE', 'row'), ('Coverage', 'EMPTY_FIELDS', 'row'),
  ('Evidence', 'GET_EVIDENCE', 'evidence'), ('Evidence', 'GET_SOURCE_ROW', 'evidence')),
n AS (SELECT class, count(*) AS row_n, count(*) FILTER (name <> '') AS name_n, count(*) FILTER (evidence <> '') AS evidence_n, count(*) FILTER (pk IN (SELECT node FROM sides)) AS edges_n FROM ent GROUP BY class),
caps AS (
  SELECT class, category, question, CASE kind WHEN 'row' THEN row_n WHEN 'name' THEN name_n WHEN 'evidence' THEN evidence_n ELSE edges_n END AS supported FROM n, q
  UNION ALL
  SELECT n.class, 'Relations (workbook)', 'GET_' || replace(upper(a.rel), ' ', '_'), (SELECT count(DISTINCT e.pk) FROM ent e JOIN sides s ON s.node = e.pk WHERE e.class = n.class AND contains(s.rel, a.rel)) FROM n, (SELECT DISTINCT rel FROM edges) a)
"""


@query(CAPABILITIES + "SELECT * FROM caps")
def reg_capabilities(spark, d):
    return engine(spark, d).capabilities()


@query(CAPABILITIES + "SELECT class, count(*) FILTER (supported > 0) AS questions FROM caps GROUP BY class")
def reg_answerable(spark, d):
    return derive.answerable_by_class(engine(spark, d).capabilities())


@query("""SELECT category, question, bool_or(ok) AS supported FROM (
  SELECT 'Evidence' AS category, 'GET_EVIDENCE' AS question, evidence <> '' AS ok FROM ent WHERE pk = 'SUP-2' UNION ALL SELECT 'Relations (workbook)', 'GET_REGION', FALSE
  UNION ALL SELECT 'Relationships', 'GET_OUTGOING', TRUE) GROUP BY ALL""")
def reg_entity_capabilities(spark, d):
    got = engine(spark, d).describe("SUP-2")
    return spark.createDataFrame([(x["category"], x["question"], x["supported"]) for x in got], "category string, question string, supported boolean").where(F.col("question").isin("GET_EVIDENCE", "GET_REGION", "GET_OUTGOING"))


@query("""SELECT * FROM (VALUES ('Cross-Sheet Reference (FK)', 'Customer Registry,Flow Registry,Nation Registry'), ('Directed Edge (relationship)', 'Flow Registry'), ('Edge Attribute', 'Flow Registry'), ('Descriptive Metadata', 'Customer Registry,Supplier Registry'), ('Entity-Identity (PK)', 'Customer Registry,Flow Registry,Nation Registry'),
 ('Hierarchy (parent/child)', 'Customer Registry,Flow Registry,Nation Registry'), ('Occurrence Frequency', 'ALL'), ('Provenance (file:line)', 'Customer Registry,Flow Registry,Nation Registry'), ('Row/Column Location', 'ALL')) AS t(feature, detected_in)""")
def reg_features(spark, d):
    return engine(spark, d).features().select("feature", F.array_join("detected_in", ",").alias("detected_in"))


@query("SELECT 9 AS value, 0 AS gaps")
def reg_closure(spark, d):
    return engine(spark, d).closure().agg(F.count("*").alias("value"), F.count_if(~F.col("covered")).alias("gaps"))


@query("SELECT class, count(*) AS entities, list_aggregate(list(coalesce(name, pk) ORDER BY _ord)[1:6], 'string_agg', ',') AS preview FROM ent GROUP BY class")
def reg_previews(spark, d):
    e = engine(spark, d)
    return derive.registry_previews(e.entities).join(e.registry_universe().select("class", "entities"), "class").select("class", "entities", F.array_join("preview", ",").alias("preview"))


@query("SELECT rel, count(*) AS n, CASE WHEN len(list_intersect(list(src_class), list(dst_class))) > 0 THEN 'Structural' WHEN count(DISTINCT dst_class) = 1 THEN 'Classification' ELSE 'Association' END AS kind FROM edges GROUP BY rel")
def reg_relation_universe(spark, d):
    return derive.relation_universe(engine(spark, d).edges)


@query("""SELECT 'Supplier Registry' AS registry, "Supplier ID" AS pk FROM supplier_sheet WHERE "Status" = 'Active'""")
def reg_promoted_members(spark, d):
    """The rows that a repeated value stands for, found by its id."""
    return engine(spark, d).promoted_entity("VPROM:STATUS:ACTIVE")["members"]


@query("""SELECT "Supplier ID", "Status" FROM supplier_sheet WHERE "Status" = 'Active'""")
def reg_promoted_rows(spark, d):
    e = engine(spark, d)
    return explore.source_rows(e.wb, e.promoted_entity("VPROM:STATUS:ACTIVE")).select("Supplier ID", "Status")


# --- around an entity ------------------------------------------------------------------------------------------------


@query("""SELECT e.class, e.pk, 'Evidence' AS col, e.evidence AS value, (SELECT count(*) FROM supplier_sheet WHERE "Supplier ID" = 'SUP-2') AS cell_count FROM ent e WHERE pk = 'SUP-2'""")
def reg_evidence_jump(spark, d):
    e = engine(spark, d)
    return identity.evidence_jump(e.entities, e.wb, "SUP-2").select("class", "pk", "col", "value", F.col("cell_count").cast("long").alias("cell_count"))


@query("SELECT pk AS key, evidence FROM ent WHERE evidence IS NOT NULL UNION ALL SELECT src || '->' || dst, evidence FROM edges WHERE evidence IS NOT NULL")
def reg_attach_evidence(spark, d):
    e = engine(spark, d)
    return derive.attach_evidence(e.edges, e.entities)


@query("SELECT pk, class FROM ent WHERE pk IN (SELECT \"Nation (FK)\" FROM supplier_sheet)")
def reg_expanded(spark, d):
    """Entities that the identifiers in a column's cells name."""
    e = engine(spark, d)
    return relational.expanded(e.wb.rows("Supplier Registry"), "Nation (FK)", e.entities).select("pk", "class").distinct()


@query("SELECT \"Status\" AS key, count(*) AS n FROM supplier_sheet GROUP BY 1")
def reg_ordered_metrics(spark, d):
    return relational.ordered_metrics(relational.grouped_count(engine(spark, d).wb.rows("Supplier Registry"), "Status"), "n", True)


@query("SELECT stage, value FROM (SELECT \"Status\" AS a, \"Nation Notes\" AS b, \"Name\" AS n, \"Nation (FK)\" AS f, \"Evidence\" AS v FROM supplier_sheet WHERE \"Supplier ID\" = 'SUP-1'), (VALUES ('Name'), ('Nation (FK)'), ('Nation Notes'), ('Evidence')) AS t(stage), LATERAL (SELECT CASE stage WHEN 'Name' THEN n WHEN 'Nation (FK)' THEN f WHEN 'Nation Notes' THEN b ELSE v END AS value)")
def reg_gap_analysis(spark, d):
    """Columns of a row whose value isn't the one that stands for done."""
    return explore.gap_analysis(engine(spark, d).wb, "Supplier Registry", "SUP-1", "Active")


@query("SELECT dst AS node, least_hop.n AS hop FROM (SELECT DISTINCT b.dst FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src = 'SUP-1'), (SELECT 2 AS n) least_hop")
def reg_reachable_paths(spark, d):
    """Regions of a supplier, over nations, with their paths."""
    rows = engine(spark, d).reachable("SUP-1", "Region Registry")
    return rows.where((F.size("path") == 3) & (F.element_at("path", 1) == "SUP-1") & (F.element_at("path", -1) == F.col("node"))).select("node", "hop")


@query("SELECT min(b.dst) AS node, 2 AS hop FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src = 'SUP-1'")
def reg_path_to_class(spark, d):
    e = engine(spark, d)
    return graph.path_to_class(e.edges, "SUP-1", "Region Registry", reach=e.reachability, source_class="Supplier Registry").select("node", "hop")


@query("SELECT DISTINCT b.dst AS node FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src = 'SUP-1'")
def reg_walk_discovery(spark, d):
    """A relation that the entity lacks becomes a discovery in the plan."""
    e = engine(spark, d)
    plan = planner.query_plan_for(e, e.queries["GET_REGION"], "SUP-1")
    state = planner.run(e, plan, "SUP-1")
    return state.nodes.where(F.lit("walk_discovery" in state.trace)).select("node")


@query("SELECT dst AS other FROM edges WHERE src = 'SUP-1' AND contains(rel, 'nation')")
def reg_walk(spark, d):
    state = planner.run(engine(spark, d), [("seed", {}), ("walk", {"direction": "out", "relation": "nation"})], "SUP-1")
    return state.edges.select("other")


@query("""
, reach AS (SELECT src AS origin, dst AS node, 1 AS hop FROM edges WHERE src IN ('NAT-1', 'NAT-6') UNION SELECT a.src, b.dst, 2 FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src IN ('NAT-1', 'NAT-6')),
r AS (SELECT origin, node, min(hop) AS hop FROM reach GROUP BY ALL)
SELECT a.node, a.hop AS hop_a, b.hop AS hop_b, a.hop + b.hop AS distance FROM r a JOIN r b ON a.node = b.node AND a.origin = 'NAT-1' AND b.origin = 'NAT-6'""")
def reg_intersect(spark, d):
    """What two nations both reach; paths begin at each and end at the node."""
    e = engine(spark, d)
    rows = graph.intersect_paths(e.edges, "NAT-1", "NAT-6")
    ends = (F.element_at("path_a", 1) == "NAT-1") & (F.element_at("path_b", 1) == "NAT-6") & (F.size("path_a") == F.col("hop_a") + 1) & (F.size("path_b") == F.col("hop_b") + 1)
    return rows.where(ends).select("node", "hop_a", "hop_b", "distance")


@query("SELECT node AS id, count(*) AS degree FROM sides GROUP BY node ORDER BY degree DESC, id LIMIT 8")
def reg_busiest(spark, d):
    """What is suggested where a token means nothing."""
    return engine(spark, d).suggest("zzqx")["items"].select("id", "degree")


@query("SELECT pk, name FROM ent WHERE class = 'Nation Registry'")
def reg_render_list(spark, d):
    e = engine(spark, d)
    return derive.render_list(e.entities.where("class = 'Nation Registry'"))


@query("SELECT 'NAT-3' AS line UNION ALL SELECT CASE dir WHEN 'out' THEN node || ' -' || rel || '-> ' || other ELSE other || ' -' || rel || '-> ' || node END FROM sides WHERE node = 'NAT-3'")
def reg_render_tree(spark, d):
    return derive.render_tree(graph.neighbors(engine(spark, d).edges, "NAT-3"), "NAT-3").select("line")


@query("SELECT * FROM (VALUES ('AQ-01', 'OWNER_via_nation'), ('AQ-02', 'NEIGHBORS'), ('AQ-03', 'EVIDENCE'), ('AQ-04', 'LIFECYCLE_RECONSTRUCT')) AS t(id, name)")
def reg_pipelines(spark, d):
    return spark.createDataFrame([(x["id"], x["name"]) for x in engine(spark, d).pipelines("CUS-2")], "id string, name string")


@query("""SELECT 'Entry' AS stage, 'not_referenced' AS status UNION ALL SELECT 'nation', 'compiler_missed' UNION ALL SELECT 'nation_notes', 'filled' UNION ALL SELECT 'Output', 'not_referenced' UNION ALL SELECT 'Evidence', 'filled'""")
def reg_lifecycle(spark, d):
    """A supplier whose key names no nation but whose notes do: the link is broken."""
    e = engine(spark, d)
    # the cell is taken as known by giving the missing nation an entity without edges
    ghost = e.entities.where("pk = 'NAT-0'").withColumns({"pk": F.lit("NAT-99"), "node_key": F.lit("NAT-99")})
    return explore.lifecycle(e.edges, e.entities.unionByName(ghost), "SUP-0").select("stage", "status")


# --- questions in words ----------------------------------------------------------------------------------------------


@query("SELECT count(*) AS value FROM supplier_sheet")
def reg_ask_count(spark, d):
    return one(spark, engine(spark, d).ask("count suppliers")["result"])


@query("SELECT count(DISTINCT src) AS value FROM edges WHERE dst = 'NAT-3' AND src_class = 'Customer Registry' AND rel = 'ships to'")
def reg_ask_count_related(spark, d):
    """'count customers NAT-3': the relation between the classes is the first in the edges, that of the flows."""
    got = engine(spark, d).ask("count customers NAT-3")
    return one(spark, got["result"]).where(F.lit(got["operations"] == ["COUNT_RELATED"]))


@query("SELECT count(DISTINCT src) AS value FROM edges WHERE src_class = 'Nation Registry' AND rel = 'region'")
def reg_ask_count_of_classes(spark, d):
    return one(spark, engine(spark, d).ask("how many nations regions")["result"])


@query("SELECT src, rel FROM edges WHERE dst = 'NAT-3' AND src_class = 'Customer Registry'")
def reg_ask_scoped_filter(spark, d):
    return engine(spark, d).ask("customers in NAT-3")["result"].select("src", "rel")


@query("SELECT a.dst AS hop_1, b.dst AS hop_2 FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src = 'CUS-2' AND b.rel = 'region'")
def reg_ask_path(spark, d):
    e = engine(spark, d)
    target = graph.all_reachable_paths(e.edges, "CUS-2", "Region Registry").first()["node"]
    hops = e.ask(f"path CUS-2 to {target}")["result"]
    return spark.createDataFrame([tuple(h["to"] for h in hops)], "hop_1 string, hop_2 string")


@query("SELECT \"Supplier ID\", \"Name\" FROM supplier_sheet ORDER BY \"Name\" DESC, _ord LIMIT 3")
def reg_ask_top(spark, d):
    return engine(spark, d).ask("top 3 suppliers")["result"].select("Supplier ID", "Name")


@query("SELECT count(DISTINCT \"Supplier ID\") AS value FROM supplier_sheet")
def reg_ask_distinct(spark, d):
    return one(spark, engine(spark, d).ask("distinct suppliers")["result"].count())


@query("SELECT src, rel FROM edges WHERE dst = 'NAT-3'")
def reg_ask_used_by(spark, d):
    return engine(spark, d).ask("used by NAT-3")["result"].select("src", "rel")


@query("SELECT class, pk, evidence FROM ent WHERE pk = 'NAT-3'")
def reg_ask_evidence(spark, d):
    return engine(spark, d).ask("evidence NAT-3")["result"].select("class", "pk", "evidence")


@query("SELECT other, rel FROM sides WHERE node = 'NAT-3' AND dir = 'in'")
def reg_ask_dependency(spark, d):
    return engine(spark, d).ask("dependency NAT-3")["result"].select("other", "rel")


@query("""
, l AS (SELECT DISTINCT rel, dst FROM edges WHERE src = 'SUP-1'), r AS (SELECT DISTINCT rel, dst FROM edges WHERE src = 'SUP-2'),
j AS (SELECT coalesce(l.rel, r.rel) AS rel, l.dst AS ld, r.dst AS rd FROM l FULL JOIN r ON l.rel = r.rel AND l.dst = r.dst)
SELECT rel, count(*) FILTER (ld IS NOT NULL AND rd IS NOT NULL) AS n_common, count(*) FILTER (rd IS NULL) AS n_left, count(*) FILTER (ld IS NULL) AS n_right FROM j GROUP BY rel""")
def reg_ask_compare(spark, d):
    return engine(spark, d).ask("compare SUP-1 SUP-2")["result"].select("rel", "n_common", "n_left", "n_right")


@query("SELECT \"Region ID\" FROM region_sheet")
def reg_open_registry(spark, d):
    return engine(spark, d).open_entity("Region Registry").select("Region ID")


@query("""SELECT * FROM (VALUES ('count suppliers', 'seed,group,aggregate'), ('top 3 suppliers', 'seed,sort,limit'), ('average suppliers', 'seed,group,aggregate'), ('count customers NAT-3', 'seed,count_related'),
  ('path CUS-2 to NAT-3', 'seed,path'), ('suppliers', 'open'), ('find blorp', 'search'), ('evidence NAT-3', 'seed,evidence')) AS t(question, plan)""")
def reg_plans(spark, d):
    """The opcodes that run for questions of each kind."""
    e = engine(spark, d)
    asked = ("count suppliers", "top 3 suppliers", "average suppliers", "count customers NAT-3", "path CUS-2 to NAT-3", "suppliers", "find blorp", "evidence NAT-3")
    return spark.createDataFrame([(q, ",".join(e.ask(q)["trace"])) for q in asked], "question string, plan string")


@query("""SELECT * FROM (VALUES ('GET_NATION', 'seed,walk,attach_evidence,render'), ('GET_EVIDENCE', 'seed,attach_evidence,render'), ('VALIDATE_REFERENCES', 'seed,check_keys,render'), ('NONE', 'seed')) AS t(name, plan)""")
def reg_query_plans(spark, d):
    e = engine(spark, d)
    return spark.createDataFrame([(n, ",".join(op for op, _ in planner.query_plan(e.queries.get(n)))) for n in ("GET_NATION", "GET_EVIDENCE", "VALIDATE_REFERENCES", "NONE")], "name string, plan string")


@query("SELECT 'Supplier Registry' AS registry, \"Supplier ID\" AS pk, 'Nation (FK)' AS \"column\", 'NAT-99' AS token FROM supplier_sheet WHERE \"Supplier ID\" = 'SUP-7'")
def reg_answer_validate(spark, d):
    return engine(spark, d).answer("VALIDATE_REFERENCES", "SUP-7")["items"]


@query("SELECT 'SUP-2' AS key, evidence FROM ent WHERE pk = 'SUP-2'")
def reg_answer_evidence(spark, d):
    return engine(spark, d).answer("GET_EVIDENCE", "SUP-2")["items"]


@query("""SELECT "Supplier ID" AS pk, t.text, t.a AS "start", t.b AS "end" FROM supplier_sheet, (VALUES ('How', 0, 3), ('many', 4, 8), ('orders', 9, 15), ('of', 16, 18)) AS t(text, a, b) WHERE _ord < 1000000000
UNION ALL SELECT "Supplier ID", "Name", 19, 19 + length("Name") FROM supplier_sheet WHERE _ord < 1000000000""")
def reg_tokens(spark, d):
    """Words of a question about each supplier, with their places."""

    def tokens(batches):
        for b in batches:
            found = [(k, t.text, t.start, t.end) for k, n in zip(b["pk"], b["name"], strict=True) for t in language.tokenize(f"How many orders of {n}?", language.Vocabulary())]
            yield pd.DataFrame(found, columns=["pk", "text", "start", "end"])

    return engine(spark, d).entities.where("class = 'Supplier Registry'").select("pk", "name").mapInPandas(tokens, "pk string, text string, start long, end long")


@query("""SELECT DISTINCT header, CASE WHEN slug = '' THEN 'references' ELSE slug END AS slug FROM (
  SELECT header, trim(regexp_replace(lower(regexp_replace(header, '\\(FK\\)|\\(s\\)', '', 'gi')), '[^a-z0-9]+', '_', 'g'), '_') AS slug
  FROM (SELECT "Name" || ' (FK)' AS header FROM customer_sheet UNION ALL SELECT "Segment" || '(s)' FROM customer_sheet UNION ALL SELECT '(' || upper('fk') || ')' FROM region_sheet))""")
def reg_slugs(spark, d):
    """Names of relations from headers, which here are made of names and segments."""
    rows = engine(spark, d).wb.rows("Customer Registry")
    headers = rows.select(F.explode(F.array(F.concat("Name", F.lit(" (FK)")), F.concat("Segment", F.lit("(s)")), F.lit("(FK)"))).alias("header")).distinct()
    return headers.withColumn("slug", F.udf(S.relation_slug)("header"))


@query("SELECT \"Region ID\" AS pk, \"Name\" AS name FROM region_sheet")
def reg_inferred_catalog(spark, d):
    """The catalog of a workbook that declares none, from its identifiers."""
    wb = discovery.infer_catalog(workbook(spark, d))
    owners = {s.name: s.prefix for s in wb.owners()}
    links = {(s.name, x.column): x.target for s in wb.catalog for x in s.links}
    right = owners.get("Region Registry") == "REG" and links.get(("Nation Registry", "Region (FK)")) == "Region Registry" and "Supplier Registry" not in owners
    return identity.entities(wb).where((F.col("class") == "Region Registry") & F.lit(right)).select("pk", "name")


# --- flows and requests ----------------------------------------------------------------------------------------------


@query("SELECT \"Source (FK)\" AS src, \"Relation\" AS rel, \"Target (FK)\" AS dst, \"Flow Type\" AS flow FROM flow_sheet")
def reg_flow_edges(spark, d):
    return engine(spark, d).edges.where("flow IS NOT NULL").select("src", "rel", "dst", "flow")


@query("SELECT \"Target (FK)\" AS node, \"Source (FK)\" AS other FROM flow_sheet WHERE \"Flow Type\" = 'Data'")
def reg_flow_walk(spark, d):
    """Data flows into nations."""
    e = engine(spark, d)
    seeds = e.entities.where("class = 'Nation Registry'").select(F.col("node_key").alias("node"))
    return graph.walk_relationship(e.edges, seeds, "in", flow="Data").select("node", "other")


@query("SELECT * FROM (VALUES ('AQ-01', 'OWNER_via_ships to'), ('AQ-02', 'CONSUMERS'), ('AQ-03', 'NEIGHBORS'), ('AQ-04', 'EVIDENCE'), ('AQ-05', 'LIFECYCLE_RECONSTRUCT')) AS t(id, name)")
def reg_flow_pipelines(spark, d):
    return spark.createDataFrame([(x["id"], x["name"]) for x in engine(spark, d).pipelines("CUS-6")], "id string, name string")


@query("SELECT \"Source (FK)\" AS node, \"Target (FK)\" AS other FROM flow_sheet WHERE \"Source (FK)\" = 'CUS-6' AND \"Flow Type\" = 'Data'")
def reg_request_flow(spark, d):
    return engine(spark, d).request("trace the flow", "CUS-6")["result"].select("node", "other")


@query("SELECT pk, class FROM ent WHERE pk NOT IN (SELECT src FROM edges) ORDER BY sheet, _ord LIMIT 200")
def reg_request_orphans(spark, d):
    return engine(spark, d).request("orphan audit")["result"].select("pk", "class")


@query("""SELECT "Supplier ID" AS pk, "Status" AS value FROM supplier_sheet WHERE "Status" LIKE 'Dead%'""")
def reg_request_dead(spark, d):
    return engine(spark, d).request("audit what is dead")["result"].select("pk", "value")


@query("SELECT CASE CAST(split_part(pk, '-', 2) AS BIGINT) % 7 WHEN 0 THEN 'Q-03' WHEN 1 THEN 'Q-05' WHEN 2 THEN 'Q-04' WHEN 3 THEN 'Q-07' WHEN 4 THEN 'Q-08' WHEN 5 THEN 'Q-02' ELSE 'Q-01' END AS class, count(*) AS n FROM ent WHERE class IN ('Supplier Registry', 'Customer Registry') GROUP BY 1")
def reg_request_classes(spark, d):
    """Classes of a request for each supplier and customer."""
    asked = F.array(*(F.lit(x) for x in ("trace data of", "which command runs", "how does it run", "audit keys of", "why is it so with", "used by whom:", "what is")))
    rows = engine(spark, d).entities.where(F.col("class").isin("Supplier Registry", "Customer Registry"))
    text = F.concat_ws(" ", F.get(asked, (F.split_part("pk", F.lit("-"), F.lit(2)).cast("long") % 7).cast("int")), "pk")
    return rows.select(F.udf(language.request_class)(text).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query(CHECKS + """, v AS (SELECT max(value) FILTER (metric = 'broken_fk') AS f, max(value) FILTER (metric = 'duplicate_pk') AS d, max(value) FILTER (metric = 'missing_evidence_pct') AS p FROM c)
SELECT 'structure' AS layer, 'PASS' AS verdict FROM v UNION ALL SELECT 'identity', CASE WHEN d > 0 THEN 'PARTIAL' ELSE 'PASS' END FROM v UNION ALL SELECT 'relationships', CASE WHEN f > 0 THEN 'PARTIAL' ELSE 'PASS' END FROM v
UNION ALL SELECT 'evidence', CASE WHEN p <= 20 THEN 'PASS' WHEN p < 100 THEN 'PARTIAL' ELSE 'FAIL' END FROM v UNION ALL SELECT 'plan', 'PASS' UNION ALL SELECT 'result', 'PASS'""")
def reg_diagnose(spark, d):
    return spark.createDataFrame(list(engine(spark, d).diagnose("count suppliers").layers.items()), "layer string, verdict string")


@query("SELECT DISTINCT rel AS canonical, replace(rel, '_', ' ') AS word FROM edges")
def reg_vocabulary_of_relations(spark, d):
    found = [(c.canonical, c.word) for held in engine(spark, d).vocabulary.entries.values() for c in held if c.type == "relation"]
    return spark.createDataFrame(found, "canonical string, word string")


@query("SELECT rel AS word, version, status FROM (SELECT DISTINCT rel FROM edges), (VALUES (1, 'superseded'), (2, 'deprecated'), (3, 'active')) AS t(version, status)")
def reg_vocabulary_history(spark, d):
    """Meanings, here of the workbook's relations, are marked and added, never changed."""
    v = language.Vocabulary()
    words = derive.relation_names(engine(spark, d).edges)
    for w in words:
        v.add(w, w, "relation")
        v.deprecate(w, w, "renamed")
        v.add(w, w, "relation")
    return spark.createDataFrame([(w, c.version, c.status) for w in words for c in v.history(w)], "word string, version int, status string")


# --- sources and schemas ---------------------------------------------------------------------------------------------


@query("SELECT \"Nation ID\", \"Name\", \"Region (FK)\", \"Evidence\" FROM nation_sheet")
def reg_csv_workbook(spark, d):
    """A sheet written as CSV and read as a workbook."""
    path = f"{scratch(spark, 'csv')}/nations.csv"
    workbook(spark, d).frame("Nation Registry").orderBy(ORD).drop(ORD).coalesce(1).write.csv(path, header=True)
    return from_csv(spark, path).frame("nations").drop(ORD)


@query("SELECT * FROM (VALUES ('registry sheets', 'Registry'), ('one flat sheet', 'Tabular'), ('a few rows', 'Unknown')) AS t(what, strategy)")
def reg_strategies(spark, d):
    flat = spark.range(40).selectExpr("id AS a", "id % 3 AS b", "'x' AS c", f"id AS {ORD}")
    cases = {"registry sheets": workbook(spark, d), "one flat sheet": Workbook(spark, {"t": flat}), "a few rows": Workbook(spark, {"t": flat.limit(3)})}
    return spark.createDataFrame([(k, discovery.strategy(w)) for k, w in cases.items()], "what string, strategy string")


@query("SELECT * FROM (VALUES ('Nation Registry', 'Region (FK)', 'Region Registry'), ('Customer Registry', 'Nation (FK)', 'Nation Registry'), ('Flow Registry', 'Source (FK)', 'Customer Registry'), ('Flow Registry', 'Target (FK)', 'Nation Registry'), ('Supplier Registry', 'Nation (FK)', 'Nation Registry')) AS t(sheet, \"column\", target)")
def reg_inferred_links(spark, d):
    wb = discovery.infer_catalog(workbook(spark, d))
    return spark.createDataFrame([(s.name, x.column, x.target) for s in wb.catalog for x in s.links], "sheet string, column string, target string")


@query("SELECT * FROM (VALUES ('Region Registry', 'REG', 0), ('Nation Registry', 'NAT', 1), ('Customer Registry', 'CUS', 1)) AS t(name, prefix, links)")
def reg_declared_catalog(spark, d):
    """The catalog that a workbook declares in a sheet of its own."""
    head = ["Registry (self)", "Role in Model", "PK Prefix", "FK Edges (→ owner registry)", "Evidence Col"]
    rows = [("Region Registry", "Owner (entity: Region)", "REG", "", "Evidence", 0), ("Nation Registry", "Owner (entity: Nation)", "NAT", "Region → Region Registry", "Evidence", 1), ("Customer Registry", "Owner (entity: Customer)", "CUS", "Nation → Nation Registry", "Evidence", 2)]
    frames = workbook(spark, d).frames | {"Registry Catalog": spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in head) + f", {ORD} long")}
    wb = discovery.catalog_from_sheet(Workbook(spark, frames))
    return spark.createDataFrame([(s.name, s.prefix, sum(x.target is not None for x in s.links)) for s in wb.owners()], "name string, prefix string, links int")


@query("SELECT DISTINCT split_part(class, ' ', 1) || ' Notes' AS header, class AS target FROM ent UNION ALL SELECT DISTINCT split_part(class, ' ', 1) || 's served', class FROM ent UNION ALL SELECT DISTINCT \"Segment\", NULL FROM customer_sheet")
def reg_prose_targets(spark, d):
    """The registries that headers speak of; headers are made of the classes of entities and of segments."""
    e = engine(spark, d)
    first = F.split_part("class", F.lit(" "), F.lit(1))
    headers = e.entities.select(F.explode(F.array(F.concat(first, F.lit(" Notes")), F.concat(first, F.lit("s served")))).alias("header")).union(e.wb.rows("Customer Registry").select("Segment")).distinct().collect()  # a row a class or segment
    return spark.createDataFrame([(r["header"], (t := discovery.prose_target(e.wb, r["header"])) and t.name) for r in headers], "header string, target string")


@query("""SELECT "Supplier ID" AS pk, trim(regexp_replace(upper("Status"), '[^A-Z0-9]+', '_', 'g'), '_') AS slug, split_part("Supplier ID", '-', 1) AS prefix, lower(trim("Status")) IN ('none', 'unknown') AS no_value, TRY_CAST("Name" AS DOUBLE) IS NOT NULL AS is_number FROM supplier_sheet""")
def reg_scalars(spark, d):
    c = F.col
    return engine(spark, d).wb.rows("Supplier Registry").select(c("Supplier ID").alias("pk"), S.upper_slug(c("Status")).alias("slug"), S.id_prefix(c("Supplier ID")).alias("prefix"), S.is_null_word(c("Status")).alias("no_value"), S.is_number(c("Name")).alias("is_number"))


@query("""SELECT word, CASE WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%s' AND NOT w LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS "one" FROM (
  SELECT DISTINCT word, lower(word) AS w FROM (SELECT "Name" || 's' AS word FROM customer_sheet UNION ALL SELECT "Segment" || 'ies' FROM customer_sheet UNION ALL SELECT "Segment" || 'ss' FROM customer_sheet))""")
def reg_singulars(spark, d):
    """The singular of names and segments in the plural."""
    rows = engine(spark, d).wb.rows("Customer Registry")
    words = rows.select(F.explode(F.array(F.concat("Name", F.lit("s")), F.concat("Segment", F.lit("ies")), F.concat("Segment", F.lit("ss")))).alias("word")).distinct()
    return words.withColumn("one", F.udf(S.singular)("word"))


@query("SELECT CASE WHEN \"Nation (FK)\" IN (SELECT pk FROM ent) THEN 'resolved' ELSE 'not_found' END AS outcome, count(*) AS n FROM supplier_sheet GROUP BY 1")
def reg_canonicalization(spark, d):
    e = engine(spark, d)
    return explore.canonicalization_report(e.wb, "Supplier Registry", "Nation (FK)", e.entities)


@query("SELECT a.pk AS source, CAST(2 AS INTEGER) AS distance, 'L1' AS weakest_tier, 1.0::DOUBLE AS confidence FROM ent a WHERE pk = 'CUS-2'")
def reg_discover(spark, d):
    """From a customer to its region, over declared edges."""
    e = engine(spark, d)
    target = graph.all_reachable_paths(e.edges, "CUS-2", "Region Registry").first()["node"]
    x = e.discover(target, "CUS-2")
    return spark.createDataFrame([(x["source"], x["distance"], x["weakest_tier"], x["confidence"])], "source string, distance int, weakest_tier string, confidence double")


@query("SELECT 'SUP-2' AS src, \"dst\" AS other, rel FROM edges WHERE src = 'SUP-2' UNION ALL SELECT 'SUP-2', src, rel FROM edges WHERE dst = 'SUP-2'")
def reg_query_entity(spark, d):
    got = engine(spark, d).query_entity("SUP-2")["result"]
    return got.select(F.lit("SUP-2").alias("src"), "other", "rel")
