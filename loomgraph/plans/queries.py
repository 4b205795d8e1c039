"""Registered queries of the engine over the driver's tables, each with its SQL twin where SQL can express it.

The tables are sheets of one workbook with a declared catalog: region, nation, customer, supplier, part and orders own
entities; nation, customer, supplier and orders link to their parents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import compare, derive, discovery, explore, graph, identity, integrity, relational
from loomgraph.sources.workbook import ORD, Link, Sheet, Workbook, from_parquet

from .session import Engine

CATALOG = (
    Sheet("region", pk="r_regionkey", label="r_name"),
    Sheet("nation", pk="n_nationkey", label="n_name", links=(Link("n_regionkey", "region"),)),
    Sheet("customer", pk="c_custkey", label="c_name", links=(Link("c_nationkey", "nation"),)),
    Sheet("supplier", pk="s_suppkey", label="s_name", links=(Link("s_nationkey", "nation"),)),
    Sheet("part", pk="p_partkey", label="p_name"),
    Sheet("orders", pk="o_orderkey", label="o_orderkey", links=(Link("o_custkey", "customer"),)),
)
_engines: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The compiled workbook of a folder, kept for the session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        _engines[key] = Engine(from_parquet(spark, sf_dir, CATALOG))
    return _engines[key]


def sheet(spark: SparkSession, sf_dir: str, name: str, pk: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn(ORD, F.col(pk).cast("long") if pk else F.monotonically_increasing_id())


def cid(cls: str, pk: int | str) -> str:
    import hashlib

    return "CID-" + hashlib.sha1(f"{cls}::{pk}".encode()).hexdigest()[:16]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Entities and edges in SQL, shared by the twins below.
PRELUDE = """
WITH RECURSIVE ent0 AS (
  SELECT 'region' AS class, CAST(r_regionkey AS VARCHAR) AS pk, r_name AS name, 0 AS sheet, CAST(r_regionkey AS BIGINT) AS rn FROM region
  UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name, 1, n_nationkey FROM nation
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name, 2, c_custkey FROM customer
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, 3, s_suppkey FROM supplier
  UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name, 4, p_partkey FROM part
  UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), NULL, 5, o_orderkey FROM orders),
ent AS (
  SELECT *, 'CID-' || substr(sha1(class || '::' || pk), 1, 16) AS canonical,
         CASE WHEN count(*) OVER (PARTITION BY pk) > 1 THEN 'CID-' || substr(sha1(class || '::' || pk), 1, 16) ELSE pk END AS node_key
  FROM ent0),
raw AS (
  SELECT 'nation' AS sc, CAST(n_nationkey AS VARCHAR) AS sp, 'n_regionkey' AS rel, 'region' AS dc, CAST(n_regionkey AS VARCHAR) AS dp FROM nation
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'c_nationkey', 'nation', CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 's_nationkey', 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'o_custkey', 'customer', CAST(o_custkey AS VARCHAR) FROM orders),
edges AS (
  SELECT a.node_key AS src, rel, b.node_key AS dst, sc AS src_class, dc AS dst_class
  FROM raw JOIN ent a ON a.class = sc AND a.pk = sp JOIN ent b ON b.class = dc AND b.pk = dp),
sides AS (
  SELECT src AS node, dst AS other, rel, 'out' AS dir, dst_class AS other_class FROM edges
  UNION ALL SELECT dst, src, rel, 'in', src_class FROM edges)
"""


def query(sql: str | None = None, prelude: bool = True):
    """Registers a function of (spark, sf_dir) as a query under its name, with its twin."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (PRELUDE if prelude else "") + sql
        return f

    return add


NATION, REGION, CUSTOMER = cid("nation", 7), cid("region", 2), cid("customer", 10)
SUPPLIER = cid("supplier", 3)

# --- relational ------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'", False)
def op_filter(spark, d):
    return relational.filtered(sheet(spark, d, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02", False)
def op_filter_predicate(spark, d):
    return relational.filtered(sheet(spark, d, "lineitem"), predicate=lambda df: (F.col("l_quantity") > 45) & (F.col("l_discount") < 0.02)).select("l_orderkey", "l_quantity")


@query("SELECT s_suppkey, s_name FROM supplier", False)
def op_project(spark, d):
    return relational.projected(sheet(spark, d, "supplier"), ["s_suppkey", "s_name"])


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY CAST(s_acctbal AS VARCHAR), s_suppkey", False)
def op_sort(spark, d):
    return relational.ordered(sheet(spark, d, "supplier", "s_suppkey"), "s_acctbal").select("s_suppkey", "s_acctbal")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10", False)
def op_limit(spark, d):
    return relational.limited(sheet(spark, d, "part", "p_partkey"), "ten").select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 25", False)
def op_top(spark, d):
    return relational.top(sheet(spark, d, "orders", "o_orderkey"), "o_orderpriority", 25).select("o_orderkey", "o_orderpriority")


@query("SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey", False)
def op_distinct(spark, d):
    return relational.distinct_entities(sheet(spark, d, "orders", "o_orderkey"), "o_custkey").select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("SELECT class, pk, name FROM ent WHERE contains(lower(name), 'an')")
def op_search(spark, d):
    return relational.searched(engine(spark, d).entities, "AN").select("class", "pk", "name")


@query("""
, r AS (SELECT class, pk, name, sheet, rn, CASE WHEN lower(pk) = '12' OR lower(coalesce(name, '')) = '12' THEN 0
         WHEN starts_with(lower(pk), '12') OR starts_with(lower(coalesce(name, '')), '12') THEN 1 END AS rank FROM ent)
SELECT rank, class, pk, name FROM r WHERE rank IS NOT NULL ORDER BY rank, sheet, rn LIMIT 50""")
def topk_search_rank(spark, d):
    return engine(spark, d).search("12")


@query("SELECT c_mktsegment AS key, count(*) AS n FROM customer GROUP BY 1", False)
def op_group_count(spark, d):
    return relational.grouped_count(sheet(spark, d, "customer"), "c_mktsegment")


def _aggregate(fn: str) -> None:
    def run(spark, d):
        return relational.aggregate(sheet(spark, d, "lineitem"), fn, "l_extendedprice", "l_returnflag").select("key", F.round("value", 2).alias("value"))

    run.__name__ = f"op_agg_{fn}"
    value = "CAST(count(l_extendedprice) AS DOUBLE)" if fn == "count" else f"{fn}(l_extendedprice)"
    query(f"SELECT l_returnflag AS key, round({value}, 2) AS value FROM lineitem GROUP BY 1", False)(run)


for _fn in relational.FUNCTIONS:
    _aggregate(_fn)


@query("SELECT round(avg(o_totalprice), 4) AS value FROM orders", False)
def op_aggregate_global(spark, d):
    return relational.aggregate(sheet(spark, d, "orders"), "avg", "o_totalprice").select(F.round("value", 4).alias("value"))


@query("SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'", False)
def op_join(spark, d):
    left = sheet(spark, d, "customer").where("c_mktsegment = 'MACHINERY'")
    return relational.joined(left, sheet(spark, d, "orders"), "c_custkey", "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT s_suppkey AS from_row, class, pk FROM ent JOIN supplier ON pk = CAST(s_nationkey AS VARCHAR)")
def op_expand(spark, d):
    e = engine(spark, d)
    return relational.expanded_list(sheet(spark, d, "supplier", "s_suppkey"), "s_nationkey", e.entities).select("from_row", "class", "pk")


@query("SELECT c_nationkey AS key, count(*) FILTER (c_mktsegment = 'BUILDING') AS BUILDING, count(*) FILTER (c_mktsegment = 'MACHINERY') AS MACHINERY FROM customer GROUP BY 1", False)
def op_pivot(spark, d):
    return relational.pivoted(sheet(spark, d, "customer"), "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY"]).na.fill(0)


@query("SELECT CAST(l_orderkey AS VARCHAR) AS pk, CAST(sum(l_extendedprice * (1 - l_discount)) AS DECIMAL(18,2)) AS revenue FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, pk LIMIT 20", False)
def op_sort_metrics(spark, d):
    m = sheet(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("pk")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return m.orderBy(F.desc("revenue"), "pk").limit(20).select("pk", F.col("revenue").cast("decimal(18,2)").alias("revenue"))


# --- identity --------------------------------------------------------------------------------------------------------


@query("SELECT class, pk, name, canonical, node_key FROM ent")
def entities(spark, d):
    return engine(spark, d).entities.select("class", "pk", "name", "canonical", "node_key")


@query("SELECT class, pk, canonical FROM ent WHERE class = 'supplier'")
def canonical_key(spark, d):
    return sheet(spark, d, "supplier").select(F.lit("supplier").alias("class"), F.col("s_suppkey").cast("string").alias("pk"), S.canonical_key(F.lit("supplier"), F.col("s_suppkey").cast("string")).alias("canonical"))


@query("SELECT DISTINCT class, 'numeric' AS shape FROM ent")
def pk_schema(spark, d):
    return identity.pk_schema(engine(spark, d).entities)


@query("SELECT pk, count(*) AS n_classes, string_agg(class, ',' ORDER BY class) AS classes FROM ent GROUP BY pk HAVING count(*) > 1")
def node_key_collision(spark, d):
    return identity.collisions(engine(spark, d).entities).select("pk", "n_classes", F.array_join("classes", ",").alias("classes"))


@query("SELECT class, node_key, canonical FROM ent WHERE pk = '3'")
def classes_for_pk(spark, d):
    return identity.classes_for_pk(engine(spark, d).entities, "3")


@query("SELECT pk, class, name FROM ent WHERE split_part(pk, '-', 1) = '12'")
def list_entities(spark, d):
    return identity.list_entities(engine(spark, d).entities, "12").select("pk", "class", "name")


@query("SELECT class, pk, name FROM ent WHERE pk = '1500'")
def resolve_pk(spark, d):
    return identity.resolve_pk(engine(spark, d).entities, "1500").select("class", "pk", "name")


@query("SELECT 'name' AS how, class, pk FROM ent WHERE lower(name) = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 7)")
def resolve_name(spark, d):
    e = engine(spark, d)
    name = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey = 7").first()["n_name"]
    r = e.resolve(name)
    return spark.createDataFrame([(r.how, x["class"], x["pk"]) for x in r.found], "how string, class string, pk string")


@query("""SELECT 'customer' AS sheet, CAST(c_custkey AS BIGINT) AS row, 'c_nationkey' AS col FROM customer WHERE c_nationkey = 7
UNION ALL SELECT 'supplier', s_suppkey, 's_nationkey' FROM supplier WHERE s_nationkey = 7
UNION ALL SELECT 'customer', c_custkey, 'c_custkey' FROM customer WHERE c_custkey = 7
UNION ALL SELECT 'supplier', s_suppkey, 's_suppkey' FROM supplier WHERE s_suppkey = 7
UNION ALL SELECT 'part', p_partkey, 'p_partkey' FROM part WHERE p_partkey = 7
UNION ALL SELECT 'part', p_partkey, 'p_size' FROM part WHERE p_size = 7
UNION ALL SELECT 'orders', o_orderkey, 'o_orderkey' FROM orders WHERE o_orderkey = 7
UNION ALL SELECT 'orders', o_orderkey, 'o_custkey' FROM orders WHERE o_custkey = 7
UNION ALL SELECT 'region', r_regionkey, 'r_regionkey' FROM region WHERE r_regionkey = 7""", False)
def reference_lookup(spark, d):
    return identity.reference_lookup(engine(spark, d).wb, "7", but="nation")


# --- graph -----------------------------------------------------------------------------------------------------------


@query("SELECT src, rel, dst, src_class, dst_class FROM edges")
def fk_edges(spark, d):
    return engine(spark, d).edges.select("src", "rel", "dst", "src_class", "dst_class")


@query(f"SELECT node, other, rel, dir, other_class FROM sides WHERE node = '{NATION}'")
def neighbors(spark, d):
    return graph.neighbors(engine(spark, d).edges, NATION).select("node", "other", "rel", "dir", "other_class")


def _walk(direction: str) -> None:
    def run(spark, d):
        e = engine(spark, d)
        seeds = e.entities.where("class = 'nation'").select(F.col("node_key").alias("node"))
        return graph.walk_relationship(e.edges, seeds, direction, "nationkey" if direction != "out" else "regionkey").select("node", "other", "rel", "dir")

    run.__name__ = f"walk_relationship_{direction}"
    where = "" if direction == "both" else f" AND dir = '{direction}'"
    rel = "regionkey" if direction == "out" else "nationkey"
    query(f"SELECT node, other, rel, dir FROM sides WHERE node IN (SELECT node_key FROM ent WHERE class = 'nation') AND contains(rel, '{rel}'){where}")(run)


for _d in ("out", "in", "both"):
    _walk(_d)


@query(f"SELECT rel, src, src_class, e.pk AS src_pk, e.name AS src_name FROM edges JOIN ent e ON e.node_key = src WHERE dst = '{NATION}' AND rel = 's_nationkey'")
def reverse_lookup(spark, d):
    e = engine(spark, d)
    return graph.reverse_lookup(e.edges, e.entities, NATION, "s_nationkey").drop("ord")


@query(f"SELECT count(DISTINCT src) AS n FROM edges WHERE rel = 'c_nationkey' AND dst = '{NATION}'")
def count_related(spark, d):
    return graph.count_related(engine(spark, d).edges, "c_nationkey", "nation", "customer", "in", NATION)


@query("""
, o AS (SELECT rel, max(n) AS m FROM (SELECT rel, src, count(*) AS n FROM edges GROUP BY ALL) GROUP BY rel),
  i AS (SELECT rel, max(n) AS m FROM (SELECT rel, dst, count(*) AS n FROM edges GROUP BY ALL) GROUP BY rel)
SELECT rel, (CASE WHEN o.m > 1 THEN 'N' ELSE '1' END) || '→' || (CASE WHEN i.m > 1 THEN 'N' ELSE '1' END) AS cardinality FROM o JOIN i USING (rel)""")
def cardinality(spark, d):
    return graph.cardinality(engine(spark, d).edges)


@query("SELECT node, count(*) AS degree FROM sides GROUP BY node")
def degree_importance(spark, d):
    return graph.degrees(engine(spark, d).edges)


@query("SELECT DISTINCT rel, dst_class FROM edges")
def relation_target_map(spark, d):
    return graph.relation_targets(engine(spark, d).edges)


CHAIN = f"""
, s AS (SELECT dir, rel, other_class, e.pk, row_number() OVER (PARTITION BY dir, rel, other_class ORDER BY CASE WHEN dir = 'out' THEN 0 ELSE e.rn END) AS nth
        FROM sides JOIN ent e ON e.node_key = other WHERE node = '{NATION}')
SELECT dir, rel, other_class, count(*) AS n, string_agg(pk, ',' ORDER BY nth) FILTER (nth <= 8) AS items FROM s GROUP BY ALL"""


@query(CHAIN)
def discovery_chain(spark, d):
    return engine(spark, d).discovery_chain(NATION)


@query(f"SELECT dir, rel, other, other_class FROM sides WHERE node = '{CUSTOMER}'")
def relation_view(spark, d):
    return engine(spark, d).relation_view(CUSTOMER).select("dir", "rel", "other", "other_class")


@query("SELECT DISTINCT src, a.name AS src_name, dst, b.name AS dst_name, rel FROM edges JOIN ent a ON a.node_key = src JOIN ent b ON b.node_key = dst WHERE rel = 's_nationkey'")
def list_by_relation(spark, d):
    return engine(spark, d).list_by_relation("s_nationkey").drop("evidence")


BFS = """
, bfs AS (
  SELECT '{0}' AS node, 0 AS hop
  UNION
  SELECT s.other, hop + 1 FROM bfs JOIN sides s USING (node) WHERE hop < {1}{2}),
reached AS (SELECT node, min(hop) AS hop FROM bfs GROUP BY node)
"""


def bfs_sql(node: str, hops: int, direction: str | None = None) -> str:
    return BFS.format(node, hops, f" AND s.dir = '{direction}'" if direction else "")


@query(bfs_sql(SUPPLIER, 3) + "SELECT node, hop, e.class AS node_class FROM reached JOIN ent e ON e.node_key = node WHERE hop > 0")
def perspective_hops(spark, d):
    return engine(spark, d).perspective(SUPPLIER, "both", 3)


@query(bfs_sql(REGION, 3, "in") + "SELECT e.class AS node_class, count(*) AS n, min(hop) AS nearest FROM reached JOIN ent e ON e.node_key = node WHERE hop > 0 GROUP BY 1")
def perspective_bands(spark, d):
    return graph.bands(engine(spark, d).perspective(REGION, "in", 3))


@query(bfs_sql(CUSTOMER, 2, "out") + "SELECT node, e.class AS node_class, e.pk, e.name, hop, round(1.0 / (1 + hop), 3) AS strength FROM reached JOIN ent e ON e.node_key = node WHERE hop > 0")
def derive_table_strength(spark, d):
    return engine(spark, d).derive_table(CUSTOMER, "out", 2).drop("evidence")


@query(bfs_sql(CUSTOMER, 5, "out") + "SELECT node, hop FROM reached")
def reachable_depth(spark, d):
    return graph.reachable(engine(spark, d).edges, CUSTOMER, 5)


@query(bfs_sql(SUPPLIER, 4) + f"SELECT min(hop) AS distance FROM reached WHERE node = '{NATION}'")
def path_between_hops(spark, d):
    hops = graph.path_between(engine(spark, d).edges, SUPPLIER, NATION, 4)
    return spark.createDataFrame([(len(hops) if hops is not None else None,)], "distance int")


@query(bfs_sql(CUSTOMER, 5, "out") + "SELECT node, hop FROM reached JOIN ent e ON e.node_key = node WHERE hop > 0 AND e.class = 'region'")
def all_reachable(spark, d):
    return graph.all_reachable(engine(spark, d).edges, CUSTOMER, "region")


@query(f"""
, a AS (SELECT dst AS node FROM edges WHERE src = '{CUSTOMER}'), a2 AS (SELECT dst AS node FROM edges WHERE src IN (SELECT node FROM a)),
  b AS (SELECT dst AS node FROM edges WHERE src = '{SUPPLIER}'), b2 AS (SELECT dst AS node FROM edges WHERE src IN (SELECT node FROM b)),
  ra AS (SELECT node, min(h) AS hop_a FROM (SELECT node, 1 AS h FROM a UNION ALL SELECT node, 2 FROM a2) GROUP BY node),
  rb AS (SELECT node, min(h) AS hop_b FROM (SELECT node, 1 AS h FROM b UNION ALL SELECT node, 2 FROM b2) GROUP BY node)
SELECT node, hop_a, hop_b, hop_a + hop_b AS distance FROM ra JOIN rb USING (node)""")
def intersect_two(spark, d):
    return engine(spark, d).intersect(CUSTOMER, SUPPLIER, "out", 2)


@query("""
, p AS (
  SELECT o.src AS node, 'orders' AS sc, c.dst AS mid, n.dst AS far FROM edges o JOIN edges c ON c.src = o.dst JOIN edges n ON n.src = c.dst WHERE o.rel = 'o_custkey'),
pairs AS (
  SELECT 'orders' AS source_class, 'nation' AS target_class, 2 AS hops, count(DISTINCT node) AS confirmed FROM p
  UNION ALL SELECT 'orders', 'region', 3, count(DISTINCT node) FROM p
  UNION ALL SELECT 'customer', 'region', 2, count(DISTINCT c.src) FROM edges c JOIN edges n ON n.src = c.dst WHERE c.rel = 'c_nationkey'
  UNION ALL SELECT 'supplier', 'region', 2, count(DISTINCT c.src) FROM edges c JOIN edges n ON n.src = c.dst WHERE c.rel = 's_nationkey')
SELECT source_class, target_class, hops, confirmed, (SELECT count(*) FROM ent WHERE class = source_class) AS candidates, round(1.0 / hops, 2) AS confidence FROM pairs""")
def reachability_pairs(spark, d):
    return engine(spark, d).reachability.select("source_class", "target_class", "hops", "confirmed", "candidates", "confidence")


@query(f"""
, one AS (SELECT other AS id, count(*) AS n1 FROM sides WHERE node = '{NATION}' AND other <> '{NATION}' GROUP BY 1),
  two AS (SELECT s.other AS id, count(*) AS n2 FROM one JOIN sides s ON s.node = one.id WHERE s.other <> '{NATION}' GROUP BY 1),
  deg AS (SELECT node AS id, count(*) AS degree FROM sides GROUP BY 1),
  r AS (SELECT id, CASE WHEN n1 IS NULL THEN 2 ELSE 1 END AS hop, coalesce(n1, 0) + coalesce(n2, 0) AS mult, degree FROM (one FULL JOIN two USING (id)) JOIN deg USING (id)),
  s AS (SELECT id, hop, degree, least(1.0, round((1.0 / hop) * (0.5 + 0.5 * CAST(degree AS DOUBLE) / max(degree) OVER ()) * (1 + 0.1 * (mult - 1)), 4)) AS score FROM r)
SELECT id, hop, degree, CAST(score AS DOUBLE) AS score, class, pk, name FROM (SELECT * FROM s ORDER BY score DESC, hop, id LIMIT 8) JOIN ent ON node_key = id""")
def suggest_next(spark, d):
    return engine(spark, d).suggest_next(NATION)


# --- comparison ------------------------------------------------------------------------------------------------------

A, B = cid("nation", 3), cid("nation", 4)


@query(f"""
, l AS (SELECT DISTINCT rel, dst FROM edges WHERE src = '{A}'), r AS (SELECT DISTINCT rel, dst FROM edges WHERE src = '{B}'),
  j AS (SELECT coalesce(l.rel, r.rel) AS rel, l.dst AS ld, r.dst AS rd FROM l FULL JOIN r ON l.rel = r.rel AND l.dst = r.dst),
  g AS (SELECT rel, count(*) FILTER (ld IS NOT NULL AND rd IS NOT NULL) AS n_common, count(*) FILTER (rd IS NULL) AS n_left, count(*) FILTER (ld IS NULL) AS n_right FROM j GROUP BY rel)
SELECT *, CASE WHEN n_left = 0 AND n_right = 0 THEN 'common' WHEN n_common + n_left > 0 AND n_common + n_right > 0 THEN 'different' ELSE 'missing' END AS status FROM g""")
def compare_pair(spark, d):
    return engine(spark, d).compare(A, B)


@query(f"""
, o AS (SELECT DISTINCT src FROM edges WHERE src <> '{A}' AND (rel, dst) IN (SELECT (rel, dst) FROM edges WHERE src = '{A}')),
  h AS (SELECT rel, dst, count(DISTINCT src) AS have FROM edges WHERE src IN (SELECT src FROM o) GROUP BY ALL)
SELECT DISTINCT m.rel, m.dst, coalesce(h.have, 0) = (SELECT count(*) FROM o) AS shared FROM edges m LEFT JOIN h USING (rel, dst) WHERE m.src = '{A}'""")
def compare_group(spark, d):
    return engine(spark, d).compare(A, "siblings")


@query(f"SELECT DISTINCT src AS node FROM edges WHERE src <> '{A}' AND (rel, dst) IN (SELECT (rel, dst) FROM edges WHERE src = '{A}')")
def siblings(spark, d):
    e = engine(spark, d)
    return compare.scope(e.edges, e.entities, A, "siblings")


@query(f"SELECT node_key AS node FROM ent WHERE class = 'nation' AND node_key <> '{A}'")
def layer_scope(spark, d):
    e = engine(spark, d)
    return compare.scope(e.edges, e.entities, A, "layer")


@query(f"SELECT DISTINCT rel, dst, dst_class FROM edges WHERE src = '{CUSTOMER}'")
def dimensions(spark, d):
    return engine(spark, d).dimensions(CUSTOMER)


# --- integrity -------------------------------------------------------------------------------------------------------


@query("SELECT sc AS registry, sp AS pk, rel AS \"column\", dp AS token FROM raw WHERE dp IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ent WHERE class = dc AND pk = dp)")
def check_fk(spark, d):
    e = engine(spark, d)
    return integrity.check_fk(e.wb, e.entities)


@query("SELECT node_key, class, pk FROM ent WHERE node_key NOT IN (SELECT src FROM edges) ORDER BY sheet, rn LIMIT 200")
def find_orphan(spark, d):
    e = engine(spark, d)
    return integrity.find_orphan(e.edges, e.entities).drop("ord")


@query("SELECT node_key, class, pk FROM ent WHERE node_key NOT IN (SELECT src FROM edges)")
def find_missing_lifecycle(spark, d):
    e = engine(spark, d)
    return integrity.find_orphan(e.edges, e.entities, None).drop("ord")


@query("SELECT 'orders' AS registry, CAST(o_orderkey AS VARCHAR) AS pk, 'o_orderstatus' AS \"column\", o_orderstatus AS value FROM orders WHERE starts_with(lower(o_orderstatus), 'dead')", False)
def find_dead(spark, d):
    return integrity.find_dead(engine(spark, d).wb)


# Order dates hold colons before digits, so orders count as evidenced.
@query("SELECT class AS registry, pk FROM ent WHERE class <> 'orders' ORDER BY class, pk LIMIT 50")
def find_missing_evidence(spark, d):
    return integrity.find_missing_evidence(engine(spark, d).wb)


@query("SELECT class AS registry, pk, count(*) AS n FROM ent0 GROUP BY ALL HAVING count(*) > 1")
def duplicate_pk(spark, d):
    return integrity.duplicate_pks(engine(spark, d).wb)


@query("SELECT name, count(DISTINCT class) AS n_classes FROM ent WHERE name <> '' GROUP BY name HAVING count(DISTINCT class) > 1")
def duplicate_names(spark, d):
    return integrity.duplicate_names(engine(spark, d).entities)


@query("""
, changed AS (SELECT class <> lag(class) OVER (PARTITION BY lower(trim(name)) ORDER BY sheet, rn) AS other FROM ent WHERE trim(name) <> '')
SELECT 'objects' AS metric, count(*) AS value FROM ent UNION ALL SELECT 'types', 6 UNION ALL SELECT 'relationships', count(*) FROM edges
UNION ALL SELECT 'duplicate_pk', count(*) FROM (SELECT pk FROM ent0 GROUP BY pk HAVING count(*) > 1)
UNION ALL SELECT 'broken_fk', (SELECT count(*) FROM raw WHERE NOT EXISTS (SELECT 1 FROM ent WHERE class = dc AND pk = dp))
UNION ALL SELECT 'empty_registries', 6 - count(DISTINCT class) FROM ent UNION ALL SELECT 'missing_evidence', count(*) FROM ent UNION ALL SELECT 'missing_evidence_pct', 100
UNION ALL SELECT 'duplicate_names', count(*) FROM changed WHERE other UNION ALL SELECT 'schema_catalog', 1 UNION ALL SELECT 'schema_evidence', 0 UNION ALL SELECT 'schema_fk', 1""")
def validation_checks(spark, d):
    return spark.createDataFrame(list(engine(spark, d).checks().items()), "metric string, value long")


@query("""
, v AS (SELECT (SELECT count(*) FROM raw WHERE NOT EXISTS (SELECT 1 FROM ent WHERE class = dc AND pk = dp)) AS f, (SELECT count(*) FROM (SELECT pk FROM ent0 GROUP BY pk HAVING count(*) > 1)) AS d)
SELECT CAST(100 - least(20, 2 * f) - least(20, 5 * d) - least(15, (100 - 20) // 5) AS INTEGER) AS score FROM v""")
def confidence_score(spark, d):
    return spark.createDataFrame([(engine(spark, d).confidence(),)], "score int")


@query("""SELECT 'customer' AS sheet, (SELECT count(*) FROM customer WHERE c_custkey = 7) + (SELECT count(*) FROM customer WHERE c_nationkey = 7) AS n
UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier WHERE s_suppkey = 7) + (SELECT count(*) FROM supplier WHERE s_nationkey = 7)
UNION ALL SELECT 'nation', 1
UNION ALL SELECT 'part', (SELECT count(*) FROM part WHERE p_partkey = 7) + (SELECT count(*) FROM part WHERE p_size = 7)
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders WHERE o_orderkey = 7) + (SELECT count(*) FROM orders WHERE o_custkey = 7)""", False)
def observe_occurrences(spark, d):
    return integrity.find_sheets(engine(spark, d).wb, "7")


# --- derivation ------------------------------------------------------------------------------------------------------


COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
}
ATTRIBUTES = " UNION ALL ".join(f"SELECT '{t}' AS scope, '{c}' AS property, 'attribute' AS kind, CAST(NULL AS VARCHAR) AS target, count(nullif(CAST({c} AS VARCHAR), '')) / count(*) AS support FROM {t}" for t, cs in COLUMNS.items() for c in cs.split())
FOUND = f"""
, size AS (SELECT class, count(*) AS n FROM ent GROUP BY class),
  found AS (
    SELECT * FROM ({ATTRIBUTES}) UNION ALL
    SELECT src_class, rel, 'relationship', dst_class, count(DISTINCT src) / any_value(size.n) FROM edges JOIN size ON size.class = src_class GROUP BY src_class, rel, dst_class),
  inv AS (SELECT scope, property, kind, target, round(support, 4) AS support FROM found WHERE round(support, 4) >= 1.0)
"""


@query(FOUND + "SELECT * FROM inv")
def invariants(spark, d):
    return engine(spark, d).invariants()


@query("SELECT 'GET_' || upper(rel) AS name, rel FROM (SELECT DISTINCT rel FROM edges)")
def relation_queries(spark, d):
    return derive.relation_queries(engine(spark, d).edges)


@query("SELECT rel, CASE WHEN len(list_intersect(list(src_class), list(dst_class))) > 0 THEN 'Structural' WHEN count(DISTINCT dst_class) = 1 THEN 'Classification' ELSE 'Association' END AS kind FROM edges GROUP BY rel")
def relation_groups(spark, d):
    return derive.relation_groups(engine(spark, d).edges)


CAPABILITIES = """
, q(category, question, kind) AS (VALUES
  ('Identity', 'WHAT_IS', 'row'), ('Identity', 'GET_NAME', 'name'), ('Identity', 'GET_PURPOSE', 'row'), ('Relationships', 'GET_NEIGHBORS', 'edges'), ('Relationships', 'GET_INCOMING', 'edges'),
  ('Relationships', 'GET_OUTGOING', 'edges'), ('Dependency', 'GET_UPSTREAM', 'edges'), ('Dependency', 'GET_DOWNSTREAM', 'edges'), ('Dependency', 'IS_ROOT', 'edges'), ('Dependency', 'IS_LEAF', 'edges'),
  ('Integrity', 'CHECK_FK', 'row'), ('Integrity', 'IS_ORPHAN', 'row'), ('Integrity', 'IS_DUPLICATE', 'row'), ('Coverage', 'MISSING_EVIDENCE', 'row'), ('Coverage', 'EMPTY_FIELDS', 'row'),
  ('Evidence', 'GET_EVIDENCE', 'none'), ('Evidence', 'GET_SOURCE_ROW', 'none')),
n AS (SELECT class, count(*) AS row_n, count(*) FILTER (name <> '') AS name_n, count(*) FILTER (node_key IN (SELECT node FROM sides)) AS edges_n FROM ent GROUP BY class),
ends AS (SELECT DISTINCT e.class, s.node, s.rel FROM sides s JOIN ent e ON e.node_key = s.node),
caps AS (
  SELECT class, category, question, CASE kind WHEN 'row' THEN row_n WHEN 'name' THEN name_n WHEN 'edges' THEN edges_n ELSE 0 END AS supported FROM n, q
  UNION ALL
  SELECT n.class, 'Relations (workbook)', 'GET_' || upper(a.rel), count(DISTINCT ends.node) FROM n CROSS JOIN (SELECT DISTINCT rel FROM edges) a LEFT JOIN ends ON ends.class = n.class AND contains(ends.rel, a.rel) GROUP BY n.class, a.rel)
"""


@query(CAPABILITIES + "SELECT * FROM caps")
def capability_matrix(spark, d):
    return engine(spark, d).capabilities()


@query(CAPABILITIES + "SELECT category, question, CAST(sum(supported) AS BIGINT) AS supported FROM caps GROUP BY ALL")
def capability_universe(spark, d):
    return derive.capability_universe(engine(spark, d).capabilities())


@query("""
SELECT n.class, n.entities, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming FROM (SELECT class, count(*) AS entities FROM ent GROUP BY class) n
LEFT JOIN (SELECT src_class AS class, count(*) AS n FROM edges GROUP BY 1) o USING (class)
LEFT JOIN (SELECT dst_class AS class, count(*) AS n FROM edges GROUP BY 1) i USING (class)""")
def registry_universe(spark, d):
    return engine(spark, d).registry_universe()


PLAIN = {"customer": "c_acctbal c_mktsegment", "supplier": "s_acctbal", "part": "p_brand p_type p_size p_retailprice", "orders": "o_orderstatus o_totalprice o_orderdate o_orderpriority"}
VALUES = " UNION ALL ".join(f"SELECT '{t}' AS registry, '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM {t}" for t, cs in PLAIN.items() for c in cs.split())


@query(f"""
WITH cells AS (SELECT * FROM ({VALUES}) WHERE trim(value) <> ''),
v AS (SELECT registry, col, value, count(*) AS members FROM cells GROUP BY ALL),
fit AS (SELECT registry, col FROM v GROUP BY ALL HAVING count(*) >= 2 AND max(members) >= 2 AND count(*) <= greatest(3, floor(0.6 * sum(members))))
SELECT registry, col, value, members, 'VPROM:' || upper(col) || ':' || trim(regexp_replace(upper(value), '[^A-Z0-9]+', '_', 'g'), '_') AS promoted_id FROM v JOIN fit USING (registry, col) WHERE members >= 2""", False)
def promotion_candidates(spark, d):
    return engine(spark, d).promoted


@query("SELECT 'customer' AS registry, CAST(c_custkey AS VARCHAR) AS pk FROM customer WHERE c_mktsegment = 'BUILDING'", False)
def promotion_members(spark, d):
    return derive.promotion_members(engine(spark, d).wb, "c_mktsegment", "BUILDING")


@query("SELECT DISTINCT rel, 'L1' AS tier, CAST(1.0 AS DOUBLE) AS confidence FROM edges")
def tier_confidence(spark, d):
    return derive.relation_tiers(engine(spark, d).edges)


@query(f"SELECT src || ' -' || rel || '-> ' || dst AS line FROM edges WHERE src = '{NATION}' OR dst = '{NATION}'")
def render_graph_edges(spark, d):
    return derive.render_graph(engine(spark, d).edges, NATION)


@query(f"SELECT dir, other FROM sides WHERE node = '{NATION}' AND rel = 's_nationkey'")
def explain_relation(spark, d):
    return engine(spark, d).explain_relation(NATION, "s_nationkey")["items"].drop("evidence")


@query(f"SELECT dir, other FROM sides WHERE node = '{NATION}' AND rel = 'n_regionkey'")
def answer_get_relation(spark, d):
    return engine(spark, d).answer("GET_N_REGIONKEY", NATION)["items"].drop("evidence")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name DESC, c_custkey LIMIT 12", False)
def ask_top_n(spark, d):
    return engine(spark, d).ask("Top 12 customers")["result"].select("c_custkey", "c_name")


# --- discovery -------------------------------------------------------------------------------------------------------

SMALL = ("region", "nation", "customer", "supplier", "part", "orders")


@query("""SELECT * FROM (VALUES ('region','r_regionkey',18),('nation','n_nationkey',18),('customer','c_custkey',18),('supplier','s_suppkey',18),('part','p_partkey',18),('orders','o_orderkey',18)) AS t(sheet, col, score)""", False)
def pk_detection(spark, d):
    return discovery.detect_pks(discovery.profile(engine(spark, d).wb, SMALL))


ALL_CELLS = " UNION ".join(f"SELECT DISTINCT '{t}' AS sheet, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {t}" for t, cs in COLUMNS.items() for c in cs.split() if c not in ("c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "o_orderdate"))


@query(f"""
WITH c AS (SELECT * FROM ({ALL_CELLS}) WHERE v <> ''),
k AS (SELECT sheet AS target, v FROM c WHERE col IN ('r_regionkey', 'n_nationkey', 'c_custkey', 's_suppkey', 'p_partkey', 'o_orderkey')),
h AS (SELECT sheet, col, target, count(*) AS hits FROM c JOIN k USING (v) WHERE sheet <> target AND col NOT IN ('r_regionkey', 'n_nationkey', 'c_custkey', 's_suppkey', 'p_partkey', 'o_orderkey') GROUP BY ALL),
n AS (SELECT sheet, col, count(*) AS total FROM c GROUP BY ALL)
SELECT sheet, col, target, round(hits / total, 4) AS overlap FROM h JOIN n USING (sheet, col)
WHERE hits / total >= 0.5 OR (contains(col, substr(target, 1, 8)) AND hits / total >= 0.3)""", False)
def fk_overlap(spark, d):
    """All sheets, detected keys and columns. The twin leaves out amounts and dates, whose texts are no whole numbers."""
    wb = engine(spark, d).wb
    keys = {r["sheet"]: r["col"] for r in discovery.detect_pks(discovery.profile(wb)).collect()}  # a row a sheet
    return discovery.fk_overlap(wb, keys)


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders),
v AS (SELECT 'o_orderstatus' AS col, o_orderstatus AS value, min(o_orderkey) AS seen FROM o GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, min(o_orderkey) FROM o GROUP BY 2)
SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY seen) AS number FROM v""", False)
def tabular_dimensions(spark, d):
    return discovery.dimension_values(engine(spark, d).wb, "orders", ["o_orderstatus", "o_orderpriority"])


@query("SELECT 'Business Dataset' AS kind", False)
def classify_workbook(spark, d):
    return spark.createDataFrame([(discovery.classify(engine(spark, d).wb)["kind"],)], "kind string")


# --- exploring one entity ------------------------------------------------------------------------------------------------


@query(f"SELECT src, rel, dst AS node_key, e.class, e.pk, e.name FROM edges JOIN ent e ON e.node_key = dst WHERE src = '{CUSTOMER}'")
def walk_parent(spark, d):
    e = engine(spark, d)
    return explore.walk_parent(e.edges, e.entities, spark.createDataFrame([(CUSTOMER,)], "node string"))


@query("""SELECT 'customer' AS sheet, CAST(c_custkey AS BIGINT) AS row, 'c_nationkey' AS col FROM customer WHERE c_nationkey = 7
UNION ALL SELECT 'supplier', s_suppkey, 's_nationkey' FROM supplier WHERE s_nationkey = 7
UNION ALL SELECT 'customer', c_custkey, 'c_custkey' FROM customer WHERE c_custkey = 7
UNION ALL SELECT 'supplier', s_suppkey, 's_suppkey' FROM supplier WHERE s_suppkey = 7
UNION ALL SELECT 'part', p_partkey, 'p_partkey' FROM part WHERE p_partkey = 7
UNION ALL SELECT 'part', p_partkey, 'p_size' FROM part WHERE p_size = 7
UNION ALL SELECT 'orders', o_orderkey, 'o_orderkey' FROM orders WHERE o_orderkey = 7
UNION ALL SELECT 'orders', o_orderkey, 'o_custkey' FROM orders WHERE o_custkey = 7""", False)
def walk_child(spark, d):
    e = engine(spark, d)
    return explore.walk_child(e.wb, e.entities, NATION)


@query(f"SELECT dir, rel, 'Classification' AS kind, count(*) AS n FROM sides WHERE node = '{NATION}' GROUP BY ALL")
def relation_inventory(spark, d):
    return engine(spark, d).relation_inventory(NATION)


@query("SELECT 'n_regionkey' AS rel, 'region' AS target_class", False)
def reachable_relations(spark, d):
    return engine(spark, d).reachable_relations(CUSTOMER)


@query(f"SELECT b.dst AS node, 2 AS hop, a.rel || ' -> ' || b.rel AS path FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src = '{CUSTOMER}' AND b.rel = 'n_regionkey'")
def discover_relation(spark, d):
    return engine(spark, d).discover_relation(CUSTOMER, "n_regionkey")


@query("SELECT 'GET_C_NATIONKEY' AS name, 'c_nationkey' AS rel, 'direct' AS mode UNION ALL SELECT 'GET_N_REGIONKEY', 'n_regionkey', 'discovered'", False)
def applicable_queries(spark, d):
    return engine(spark, d).applicable_queries(CUSTOMER)


@query(f"SELECT dir || '::' || rel AS key, 'nation' || CASE dir WHEN 'out' THEN ' → ' ELSE ' ← ' END || other_class AS label, 'relation' AS kind, count(*) AS n, 'direct' AS mode FROM sides WHERE node = '{NATION}' GROUP BY dir, rel, other_class")
def entity_actions(spark, d):
    return engine(spark, d).entity_actions(NATION)


@query(f"""
, c AS (SELECT '{CUSTOMER}' AS id), mine AS (SELECT * FROM sides, c WHERE node = id), deg AS (SELECT node, count(*) AS degree FROM sides GROUP BY node),
  kin AS (SELECT DISTINCT src, rel, dst FROM edges, c WHERE src <> id AND (rel, dst) IN (SELECT (rel, dst) FROM edges, c WHERE src = id)),
  differ AS (SELECT rel, count(DISTINCT other) AS n FROM mine WHERE dir = 'out' AND (SELECT count(*) FROM kin) > 0
    AND rel NOT IN (SELECT rel FROM kin GROUP BY rel, dst HAVING count(*) = (SELECT count(DISTINCT src) FROM kin)) GROUP BY rel)
SELECT 'registry_membership' AS kind, class AS item, count(*) AS value FROM ent WHERE class IN (SELECT class FROM ent, c WHERE node_key = id) GROUP BY class UNION ALL SELECT 'evidence', 'none', 0
UNION ALL SELECT 'direct_relationships', dir || ' ' || rel, count(*) FROM mine GROUP BY dir, rel
UNION ALL SELECT 'strongest_connection', rel, n FROM (SELECT rel, count(*) AS n FROM mine WHERE dir = 'out' GROUP BY rel ORDER BY n DESC, rel LIMIT 1)
UNION ALL SELECT CASE dir WHEN 'out' THEN 'dependencies' ELSE 'dependents' END, other_class, count(DISTINCT other) FROM mine GROUP BY dir, other_class
UNION ALL SELECT 'siblings', 'customer', count(DISTINCT src) FROM kin
UNION ALL SELECT 'sibling_differences', rel, n FROM differ
UNION ALL SELECT 'sibling_differences', 'none', 0 WHERE (SELECT count(*) FROM kin) > 0 AND (SELECT count(*) FROM differ) = 0
UNION ALL SELECT 'reachable_relations', 'n_regionkey', 1
UNION ALL SELECT * FROM (SELECT 'next_steps', node, degree FROM deg WHERE node IN (SELECT other FROM mine WHERE dir = 'out') ORDER BY degree DESC, node DESC LIMIT 5)""")
def analyze(spark, d):
    return engine(spark, d).analyze(CUSTOMER)


@query("SELECT 0 AS nth, 'Entry' AS stage, FALSE AS filled, 'not_referenced' AS status UNION ALL SELECT 1, 'c_nationkey', c_nationkey IS NOT NULL, 'filled' FROM customer WHERE c_custkey = 10 UNION ALL SELECT 1000000, 'Output', FALSE, 'not_referenced' UNION ALL SELECT 1000001, 'Evidence', FALSE, 'missing'", False)
def lifecycle(spark, d):
    return engine(spark, d).lifecycle(CUSTOMER)


@query("""
, r AS (SELECT class, pk, row_number() OVER (PARTITION BY class ORDER BY pk) - 1 AS i, count(*) OVER (PARTITION BY class) AS n FROM ent),
  k AS (SELECT DISTINCT n, CAST(floor(j * n / 40.0) AS BIGINT) AS i FROM (SELECT DISTINCT n FROM r), range(40) t(j))
SELECT class, pk FROM r WHERE n <= 40 OR (n, i) IN (SELECT (n, i) FROM k)""")
def strided_sample(spark, d):
    return explore.strided_sample(engine(spark, d).entities.select("class", "pk"), ["class"], "pk")


FIRST_TEXTS = " UNION ALL ".join(
    f"SELECT '{t}' AS sheet, v FROM (SELECT {c} AS v FROM {t} ORDER BY {cs.split()[0]} LIMIT 1)"
    for t, cs in {"region": "r_regionkey r_name", "nation": "n_nationkey n_name", "customer": "c_custkey c_name c_mktsegment", "supplier": "s_suppkey s_name", "part": "p_partkey p_name p_brand p_type", "orders": "o_orderkey o_orderstatus o_orderpriority"}.items()
    for c in cs.split()[1:]
)


@query(f"""
WITH t AS ({FIRST_TEXTS}), m AS (SELECT DISTINCT sheet FROM t WHERE length(v) > 12 AND NOT regexp_matches(v, '^[A-Z]+-\\w') AND NOT regexp_matches(v, ':\\d+$'))
SELECT 'Descriptive Metadata' AS feature, list_aggregate(list(sheet ORDER BY sheet)[1:3], 'string_agg', ',') AS detected_in FROM m HAVING count(*) > 0
UNION ALL SELECT 'Ordered Sequence (ordinal)', 'customer,nation,orders' UNION ALL SELECT 'Occurrence Frequency', 'ALL' UNION ALL SELECT 'Row/Column Location', 'ALL'""", False)
def structural_features(spark, d):
    return engine(spark, d).features().select("feature", F.array_join("detected_in", ",").alias("detected_in"))


@query("SELECT 'resolved' AS outcome, count(*) AS n FROM customer", False)
def canonicalization_report(spark, d):
    e = engine(spark, d)
    return explore.canonicalization_report(e.wb, "customer", "c_nationkey", e.entities)


@query("SELECT 0 AS nth, 'n_name' AS stage, n_name AS value FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 1, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey = 7", False)
def render_timeline(spark, d):
    return derive.stages(engine(spark, d).wb, "nation", "7", 1)


PROFILE = " UNION ALL ".join(f"SELECT '{t}' AS sheet, '{c}' AS col, count(*) AS n, count(DISTINCT {c}) AS d FROM {t}" for t, cs in COLUMNS.items() for c in cs.split())


@query(PROFILE, False)
def column_profile(spark, d):
    return discovery.profile(engine(spark, d).wb).select("sheet", "col", "n", "d")


@query("SELECT col, CASE WHEN col IN ('o_orderstatus', 'o_orderpriority') THEN 'dimension' ELSE 'measure' END AS role FROM (VALUES ('o_orderkey'),('o_custkey'),('o_orderstatus'),('o_totalprice'),('o_orderdate'),('o_orderpriority')) AS t(col)", False)
def tabular_roles(spark, d):
    return discovery.column_roles(engine(spark, d).wb, "orders").select("col", "role")


@query("""
, s AS (SELECT CAST(o_orderkey AS BIGINT) AS o FROM orders)
SELECT (SELECT count(DISTINCT o_orderstatus) FROM orders) AS statuses, (SELECT count(*) FROM s) AS facts, 2 * (SELECT count(*) FROM s) AS links""")
def tabular_fact(spark, d):
    wb = engine(spark, d).wb
    star = discovery.star_schema(Workbook(spark, {"orders": wb.frames["orders"]}))
    fact = star.frame("orders Registry")
    linked = fact.agg(F.count("*").alias("facts"), (F.count("o_orderstatus (FK)") + F.count("o_orderpriority (FK)")).alias("links")).first()
    return spark.createDataFrame([(star.frame("o_orderstatus Registry").count(), linked["facts"], linked["links"])], "statuses long, facts long, links long")


@query("SELECT 'resolved' AS status, 2 AS distance, CAST(1.0 AS DOUBLE) AS confidence, 'L1' AS weakest_tier", False)
def discover_path(spark, d):
    region = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey = 10").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    x = engine(spark, d).discover(cid("region", region), CUSTOMER)
    return spark.createDataFrame([(x["status"], x["distance"], x["confidence"], x["weakest_tier"])], "status string, distance int, confidence double, weakest_tier string")


from . import registry_queries  # noqa: E402

QUERIES |= registry_queries.QUERIES
ORACLES |= registry_queries.ORACLES
