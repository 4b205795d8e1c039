"""Edges at both ends, searches from both ends, and what they read."""

import random

import pytest
from pyspark.sql import functions as F
from test_graph import made, queue_bfs

from loomgraph import storage
from loomgraph.operators import adjacency as adj
from loomgraph.operators import graph
from loomgraph.sources import workbook


def read_files(df):
    """Numbers of files that the scans of a table read, of all that it has, by running it."""
    df.write.format("noop").mode("overwrite").save()
    jvm, found = df.sparkSession._jvm, []
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            found.append(p.metrics().apply("numFiles").value())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert jvm is not None
    return sum(found)


@pytest.fixture(scope="module")
def hub(spark):
    """A graph of 4,000 leaves at a hub, and chains that touch it."""
    edges = [(f"leaf{i}", "at", "hub") for i in range(4000)] + [("a", "r", "hub"), ("hub", "r", "z"), ("z", "r", "y")] + [(f"c{i}", "n", f"c{i + 1}") for i in range(40)]
    nodes = {n for s, _, d in edges for n in (s, d)}
    e, _ = made(spark, edges, [(n, "L" if n.startswith("leaf") else "N") for n in nodes])
    return adj.adjacency(e, per_part=512, per_block=256)


def test_blocks(hub):
    rows = hub.frame.where("node = 'hub'").select("side", "block", F.size("edges").alias("n")).collect()
    assert sum(r["n"] for r in rows if r["side"] == 1) == 4001 and max(r["n"] for r in rows) < 400 and sum(r["side"] == 1 for r in rows) == 16
    assert hub.parts > 8


@pytest.mark.parametrize("direction", ["in", "out", "both"])
def test_hops_prune_in_both_directions(hub, direction):
    rows = adj.edges_at(hub, ["c7"], direction)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(node,c7)" in plan
    files = len(hub.frame.inputFiles())
    assert 1 <= read_files(rows) < files / 4
    got = {(r["other"], r["dir"]) for r in rows.collect()}
    assert got == {("c8", "out"), ("c6", "in")} - {("c8", "out") if direction == "in" else ("c6", "in") if direction == "out" else None}


def test_paths_meet_before_a_hub_is_flooded(hub):
    found = adj.two_ended(hub, "a", "y")
    assert [(h["from"], h["to"], h["relation"], h["direction"]) for h in found.path] == [("a", "hub", "r", "out"), ("hub", "z", "r", "out"), ("z", "y", "r", "out")]
    one_sided = adj.bfs(hub, graph.one_seed(hub, "a"), "both", 3).count()
    assert found.forward + found.backward < 12 < 4000 < one_sided


def test_deep_chain_keeps_few_tables(hub, monkeypatch):
    seen = []
    keep = adj.union
    monkeypatch.setattr(adj, "union", lambda tables: seen.append(len(tables)) or keep(tables))
    got = {r["node"]: r["hop"] for r in adj.bfs(hub, graph.one_seed(hub, "c0"), "out", 100).collect()}
    assert got == {f"c{i}": i for i in range(41)} and max(seen) <= adj.SEGMENTS + 1


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("direction", ["both", "out"])
def test_two_ended_paths_are_the_queues(spark, seed, direction):
    rng = random.Random(seed)
    nodes = [(f"n{i}", "C") for i in range(40)]
    edges = [(f"n{rng.randrange(40)}", f"r{rng.randrange(2)}", f"n{rng.randrange(40)}") for _ in range(55)]
    e, _ = made(spark, edges, nodes)
    a = adj.adjacency(e)
    want = queue_bfs(edges, "n0", both=direction == "both")
    for target in [n for n, (h, _) in want.items() if h >= 2][:2] + ["n39"]:
        path, at = [], target
        while at in want and want[at][1] is not None:
            path, at = [(want[at][1], at), *path], want[at][1]
        found = graph.path_between(a, "n0", target, 8, direction)
        if target not in want or want[target][0] > 8:
            assert found is None
        else:
            assert [(h["from"], h["to"]) for h in found] == path
            for h in found:
                s, d = (h["from"], h["to"]) if h["direction"] == "out" else (h["to"], h["from"])
                assert (s, h["relation"], d) in edges


def test_scope_discards_what_was_written(spark):
    with storage.scope("kept"):
        t, k = storage.written(spark.range(3).toDF("x"), "scoped"), storage.written(spark.range(3).toDF("x"), "kept")
        assert t.count() == 3 and t._stored_at in storage._held
    assert t._stored_at not in storage._held and k.count() == 3
    storage.discard(k)


def test_cells_by_value(spark):
    from test_graph import ROBOT

    wb = workbook.from_rows(spark, ROBOT)
    key = lambda df: sorted(tuple(r) for r in df.select("sheet", "row", "col_ix", "col", "value").collect())
    values = ["ACT-1", "shoulder", "nothing", "LNK-2", ""]
    want = {v: key(wb.scanned_hits(v)) for v in values}
    wb.index_cells()
    assert {v: key(wb.hits(v)) for v in values} == want and key(wb.hits("ACT-1", ["Joint Registry"])) == [r for r in want["ACT-1"] if r[0] == "Joint Registry"]
    rows = wb.hits("ACT-1")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "EqualTo(value,ACT-1)" in plan and read_files(rows) <= 2
    asked = workbook.from_rows(spark, ROBOT)
    for _ in range(workbook.INDEX_AFTER):
        asked.hits("x")
    assert asked.cell_index is None
    assert key(asked.hits("ACT-1")) == want["ACT-1"] and asked.cell_index is not None
