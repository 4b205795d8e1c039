"""Planning and running questions, extension points, the server and contracts of state."""

import io
import json
import threading
import urllib.request
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import adjacency, contracts, derive, discovery, graph
from loomgraph.plans import planner, server
from loomgraph.plans.session import Engine
from loomgraph.sources import sinks
from test_graph import CATALOG, ROBOT, owner


@pytest.fixture(scope="module")
def robot(spark):
    return Engine.from_rows(spark, ROBOT)


def word(kind, text="", canonical="", type_=""):
    return planner.Meaning(kind, text, canonical or text, type_, value=float(text) if kind == "number" else 0)


def test_qualifiers_head_scopes():
    said = [word("workbook", "Joint Registry"), word("concept", "top", "TOP", "QUALIFIER"), word("number", "3"), word("entity", "ACT-1"), word("concept", "which", "WHICH", "QUESTION")]
    root = planner.scopes(said)
    assert (root.target.text, root.concepts, root.values) == ("Joint Registry", [], [])
    (top,) = root.children
    assert (top.label, top.target.text, top.concepts, top.values) == ("top", "ACT-1", ["TOP"], [3.0])


def test_operations_map_to_known_opcodes():
    for op in planner.OPERATIONS:
        assert all(name in planner.OPCODES for name, _ in planner.realized(op, [5])), op
    assert planner.realized("LIMIT", [5, 7]) == [("limit", {"n": 5})] and planner.realized("LIMIT", []) == [("limit", {})]


def test_plans(robot):
    made = robot.plan("count joints ACT-1")
    assert made["operations"] == ["COUNT_RELATED"] and made["execution"].params["relation"] == "actuator"
    assert robot.ask("count joints ACT-1")["result"] == 2
    assert robot.ask("count joints actuators")["result"] == 3
    assert robot.plan("joints in ACT-1")["plan"] == [("seed", {"token": "ACT-1"}), ("reverse", {"source_class": "Joint Registry"})]
    got = robot.ask("joints top 2")
    assert [r["Joint ID"] for r in got["result"].collect()] == ["JNT-3", "JNT-1"] and got["trace"] == ["seed", "sort", "limit"]
    assert robot.ask("compare ACT-1 ACT-2")["trace"][-1] == "compare"
    assert robot.ask("nonsense words")["result"] is None


def test_opcode_semantics(robot):
    run = lambda *plan: planner.run(robot, list(plan), "Joint Registry")
    assert run(("seed", {}), ("filter", {})).result.count() == 0  # without a column no row fits
    assert run(("seed", {}), ("filter", {"column": "Name", "value": "wrist"})).result.count() == 1
    groups = run(("seed", {}), ("group", {"column": "Actuator (FK)"}), ("sort", {"descending": True}), ("limit", {"n": 1})).result.collect()
    assert [(r["key"], r["n"]) for r in groups] == [("ACT-1", 2)]
    tree = planner.run(robot, [("seed", {}), ("walk", {"direction": "both"}), ("attach_evidence", {}), ("render", {"form": "tree"})], "ACT-1")
    assert [r["line"] for r in tree.result.orderBy("nth").collect()] == ["ACT-1", "ACT-1 -controller-> CTRL-1", "JNT-1 -actuator-> ACT-1", "JNT-3 -actuator-> ACT-1"]
    far = planner.run(robot, [("seed", {}), ("walk", {"direction": "out", "relation": "controller"})], "JNT-2").result.collect()
    assert [(r["node"], r["path"], r["relations"]) for r in far] == [("CTRL-2", ["JNT-2", "ACT-2", "CTRL-2"], ["actuator", "controller"])]
    with pytest.raises(KeyError, match="no opcode"):
        run(("juggle", {}))


def test_added_opcodes(robot):
    @planner.opcode
    def shout(engine, s):
        from dataclasses import replace

        return replace(s, result=s.token.upper())

    assert planner.run(robot, [("shout", {})], "jnt-1").result == "JNT-1"
    del planner.OPCODES["shout"]


def test_registries_of_the_workbook(spark):
    own = {"Property Registry": [["PROP-ID", "Property", "Kind", "Field", "Operator", "Value"], ["PROP-01", "named_servo", "attribute", "Name", "matches", "^servo"]], "Query Family Registry": [["QF-ID", "Kind", "Query Name Template", "Opcode Pipeline"], ["QF-01", "attribute", "SHOW_{SCOPE}_{PROP}", "render_list"]]}
    e = Engine.from_rows(spark, ROBOT | own)
    got = e.derive_all()
    assert [(r["scope"], r["property"], r["support"]) for r in got["invariants"].collect()] == [("Actuator Registry", "named_servo", "2/2")]
    assert got["rules"].first()["purpose"] == "Every Actuator Registry MUST have named_servo."
    assert [r["name"] for r in got["queries"].collect()] == ["SHOW_ACTUATOR_REGISTRY_NAMED_SERVO"]
    bad = spark.createDataFrame([("x", "attribute", "pk", "guess", None)], "property string, kind string, field string, operator string, value string")
    with pytest.raises(ValueError, match="unknown operator"):
        derive.property_invariants(e.wb, e.entities, e.edges, 1.0, bad)


def test_features_by_value(spark):
    grid = [["No", "A", "B", "C"]] + [[str(i), "✅", "❌", "yes"] for i in range(4)]
    link = [["Edge ID", "Source (FK)", "Target (FK)", "Weight"], ["E-1", "JNT-1", "ACT-1", "heavy"], ["E-2", "JNT-2", "ACT-2", "light"]]
    e = Engine.from_rows(spark, ROBOT | {"Grid": grid, "Wiring": link})
    got = {r["feature"]: r["detected_in"] for r in e.features().collect()}
    assert set(got) == set(discovery.FEATURES) - {"Descriptive Metadata"} | ({"Descriptive Metadata"} & set(got))
    assert got["Cell-Grid Status Matrix"] == ["Grid"] and got["Ordered Sequence (ordinal)"] == ["Grid"] and "Wiring" in got["Directed Edge (relationship)"]
    assert all(r["covered"] for r in e.closure().collect())


def test_values_below_the_first_rows(spark):
    rows = [["K", "Late"]] + [[f"K-{i}", None if i < 300 else f"x.py:{i}"] for i in range(330)]
    e = Engine.from_rows(spark, {"Registry Catalog": CATALOG + [owner("Deep Registry", "K")], "Deep Registry": rows})
    assert discovery.first_values(e.wb, "Deep Registry")["Late"] == [f"x.py:{i}" for i in range(300, 320)]


def test_a_single_hit_makes_no_link(spark):
    sheets = {"A": [["ID", "Name", "Note"], *([f"AA-{i}", "n", "BB-1" if i == 1 else "free text"] for i in range(1, 12))], "B": [["ID", "Name"], ["BB-1", "b"], ["BB-2", "c"]]}
    wb = Engine.from_rows(spark, sheets).wb
    assert not wb.sheet("A").links


def test_one_hop_writes_no_edges(robot, monkeypatch):
    near = robot.adjacency  # built before
    names, keep = [], adjacency.written
    monkeypatch.setattr(adjacency, "written", lambda df, name, *by: names.append(name) or keep(df, name, *by))
    assert graph.perspective(near, "JNT-1", max_hops=1).count() == 2
    assert names == ["bfs-0", "bfs-1"]


def test_rules_of_sheets_are_one_plan_over_all_sheets(robot):
    plan = discovery.column_figures(robot.wb)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_pipelines_follow_traits(robot):
    assert [p["name"] for p in robot.pipelines("JNT-1")] == ["OWNER_via_actuator", "NEIGHBORS", "EVIDENCE", "LIFECYCLE_RECONSTRUCT"]
    assert [p["id"] for p in robot.pipelines("CTRL-1")] == ["AQ-01", "AQ-02", "AQ-03"]


def test_answers_run_their_plans(robot):
    far = robot.answer("GET_CONTROLLER", "JNT-1")
    assert far["mode"] == "discovered" and far["trace"] == ["seed", "walk_discovery", "attach_evidence", "render"] and [r["node"] for r in far["items"].collect()] == ["CTRL-1"]
    near = robot.answer("GET_ACTUATOR", "JNT-1")
    assert near["mode"] == "direct" and "walk" in near["trace"] and [r["other"] for r in near["items"].collect()] == ["ACT-1"]
    none = robot.answer("GET_ACTUATOR", "CTRL-1")
    assert none["mode"] == "empty" and none["reason"]
    assert {r["name"] for r in robot.applicable_queries("JNT-1").collect()} <= set(robot.queries)


def test_cell_lookups_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS k", "concat('n', id) AS name", "id / 4 AS x", "date_add(DATE'2020-01-01', cast(id AS int)) AS d", "cast(id AS decimal(6, 2)) AS c").write.parquet(str(tmp_path / "t.parquet"))
    from loomgraph.sources.workbook import Sheet, from_parquet

    wb = from_parquet(spark, str(tmp_path), [Sheet("t", pk="k")])
    everything = wb.cells().collect()
    for value in ("7", "n7", "1.75", "2020-01-08", "7.00", "7.0", "007", "true", "9" * 30):
        want = {(r["row"], r["col"]) for r in everything if r["value"] == value}
        assert {(r["row"], r["col"]) for r in wb.hits(value).collect()} == want, value
    plan = wb.hits("7")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or" in plan or "PushedFilters: [Or(" in plan or "EqualTo(k,7)" in plan


def test_typos_compare_only_what_lengths_allow(robot):
    plan = robot.entities
    from loomgraph.functions import scalars as S

    close = plan.where(F.coalesce(S.typo_possible(F.col("name"), "wirst"), F.lit(False))).withColumn("ratio", S.typo_ratio("wirst")(F.col("name"), F.col("pk"))).where("ratio >= 0.8")
    text = close._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    udf = next(i for i, x in enumerate(lines) if "ArrowEvalPython" in x)
    assert any("Filter" in x and "length" in x for x in lines[udf + 1 :]) and sum("ArrowEvalPython" in x for x in lines) == 1
    assert robot.resolve("wirst").found[0]["pk"] == "JNT-3"


def test_suggestions_and_promotion(robot, spark):
    assert robot.suggest("JNT-1")["status"] == "resolved" and robot.suggest("servo")["status"] == "ambiguous"
    assert robot.suggest("zzz")["status"] == "unknown" and robot.suggest("zzz")["items"].count() == 8
    rows = [["Task ID", "Name", "State"]] + [[f"T-{i}", f"t{i}", "open" if i % 2 else "done"] for i in range(8)]
    e = Engine.from_rows(spark, {"Registry Catalog": CATALOG + [owner("Task Registry", "T")], "Task Registry": rows})
    view = e.promoted_entity("VPROM:STATE:OPEN")
    assert (view["name"], view["count"], view["confidence"], view["members"].count()) == ("open", 4, 0.5, 4)
    assert [a["query"] for a in view["actions"]] == ["WHAT_IS", "GET_NAME", "REL", "GET_EVIDENCE", "GET_SOURCE_ROW"]
    assert e.promoted_entity("VPROM:STATE:LOST") is None and e.resolve("open").how == "promoted"


def test_overview_and_export(robot, tmp_path):
    text = robot.overview()
    assert "Joint Registry: 3 (shoulder, elbow, wrist)" in text and "Confidence            100 of 100" in text
    counts = robot.export(str(tmp_path / "a.zip"))
    robot.export(str(tmp_path / "b.zip"))
    assert counts["edges"] == 8 and counts["nodes"] == 9 and (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes()
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert len(json.loads(z.read("edges.json"))) == 8 and json.loads(z.read("summary.json"))["tables"] == counts


def test_workbooks_of_an_archive(tmp_path):
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        z.writestr("deep/er/a.csv", "x\n1\n")
        z.writestr("../../b.tsv", "y\n")
        z.writestr("readme.txt", "no")
    out = tmp_path / "out"
    out.mkdir()
    assert sorted(sinks.extracted(str(tmp_path / "in.zip"), str(out))) == [str(out / "a.csv"), str(out / "b.tsv")]


def test_server(spark, robot, tmp_path):
    now = [0.0]
    held = server.Sessions(spark, str(tmp_path), ttl=10, most=2, clock=lambda: now[0])
    first = held.add(robot)
    get = lambda path, **a: (lambda r: (r[0], json.loads(r[2])))(server.respond(held, "GET", path, {k: str(v) for k, v in a.items()}))
    assert get("/health") == (200, {"status": "ok", "sessions": 1})
    status, body = get(f"/query/{first.id}", token="shoulder")
    assert status == 200 and body["target"]["pk"] == "JNT-1" and body["actions"]["total"] >= 2
    assert get(f"/session/{first.id}")[1]["trail"] == ["shoulder"] and get(f"/back/{first.id}")[1]["status"] == "home"
    assert get(f"/ask/{first.id}", text="count joints")[1]["result"] == 3
    page = get(f"/perspective/{first.id}", token="JNT-1", limit=1, offset=1)[1]
    assert len(page["rows"]) == 1 and page["total"] == 3
    assert get(f"/diagnose/{first.id}", text="count joints")[1]["band"] == "green"
    assert get(f"/query/{first.id}")[0] == 400 and get(f"/dance/{first.id}")[0] == 404 and get("/ask/none", text="x")[0] == 404
    status, kind, out = server.respond(held, "GET", f"/export/{first.id}", {})
    assert (status, kind) == (200, "application/zip") and "edges.json" in zipfile.ZipFile(io.BytesIO(out)).namelist()
    status, _, out = server.respond(held, "POST", "/upload", {"name": "t.csv"}, b"id,name\n1,a\n2,b\n")
    assert status == 200 and len(held.held) == 2
    assert server.respond(held, "POST", "/upload", {"name": "t.pdf"}, b"x")[0] == 422
    now[0] = 5
    held.get(first.id)
    held.add(robot)
    assert first.id in held.held and len(held.held) == 2  # the longest unused one made room
    now[0] = 16
    assert held.get(first.id) is None


def test_server_over_a_socket(spark, tmp_path):
    s = server.serve(spark, str(tmp_path), port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}/health") as r:
        assert json.loads(r.read())["status"] == "ok"
    s.shutdown()


def test_contracts_of_state(spark, tmp_path):
    (tmp_path / "a.py").write_text("class A:\n    def __init__(self):\n        self.x = 1\n        self.y = 2\n    def step(self):\n        self.x += 1\n        return self.y\n")
    (tmp_path / "b.py").write_text("class B:\n    def hack(self):\n        self.y = self.x\n")
    (tmp_path / "broken.py").write_text("def (")
    states = [contracts.State("x", ("__init__", "step"), "a.py", read=True), contracts.State("y", ("__init__",)), contracts.State("z", ("f",), read=True)]
    got = {(r["name"], r["audit"]): (r["verdict"], r["n"]) for r in contracts.audits(contracts.sites(spark, str(tmp_path)), states).collect()}
    assert got["x", "writers"] == ("PASS", 0) and got["x", "readers"] == ("PASS", 1) and got["x", "one authority"] == ("PASS", 1)
    assert got["y", "writers"] == ("FAIL", 1) and got["y", "readers"][0] == "NOT_APPLICABLE" and got["y", "one authority"] == ("FAIL", 2)
    assert got["z", "writers"][0] == got["z", "readers"][0] == "FAIL"
    assert contracts.scan(spark, str(tmp_path), states)["verdict"] == "FAIL"
    box = {"m": 1, "c": 1}
    assert contracts.heals(lambda: box["m"], lambda: box["c"], lambda: box.update(m=9), lambda: box.update(m=box["c"])) == "PASS"
    assert contracts.heals(lambda: box["m"], lambda: box["c"], lambda: box.update(m=9), lambda: None) == "FAIL"
