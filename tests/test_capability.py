"""The menu of an entity and the observations on an identifier."""

import pytest
from pyspark.sql import functions as F
from test_graph import CATALOG, ROBOT, owner

from loomgraph.operators import capability, derive
from loomgraph.plans.session import Engine


@pytest.fixture(scope="module")
def shop(spark):
    sheets = {
        "Registry Catalog": CATALOG + [owner("Staff Registry", "STF", "Store → Store Registry"), owner("Product Registry", "PRD", "Store → Store Registry"), owner("Store Registry", "STO", "City → City Registry"), owner("City Registry", "CTY")],
        "Staff Registry": [["Staff ID", "Name", "Store (FK)", "Role", "Evidence"], ["STF-1", "Ann", "STO-1", "clerk", "s.py:1"], ["STF-2", "Bo", "STO-1", "", None]],
        "Product Registry": [["Product ID", "Name", "Store (FK)", "Evidence"], ["PRD-1", "pen", "STO-1", None]],
        "Store Registry": [["Store ID", "Name", "City (FK)", "Evidence"], ["STO-1", "", "CTY-1", "st.py:2"]],
        "City Registry": [["City ID", "Name", "Evidence"], ["CTY-1", "Rome", None]],
    }
    return Engine.from_rows(spark, sheets)


def rows(e, token):
    return {r["id"]: r for r in e.menu(token).collect()}


def test_incoming_relations_of_several_classes_are_apart(shop):
    got = rows(shop, "STO-1")
    assert got["relation_direct::store::Staff Registry::Staff Registry"]["count"] == 2 and got["relation_direct::store::Product Registry::Product Registry"]["count"] == 1
    assert got["relation_direct::store::Staff Registry::Staff Registry"]["label"] == "Store ← Staff Registry"
    name = got["attribute::name::"]
    assert not name["available"] and name["reason"] == "No name recorded." and name["confidence"] == 0.0
    assert sorted(r["key"] for r in got.values()) == list(range(1, len(got) + 1))


def test_discovered_and_fixed_actions(shop):
    got = rows(shop, "STF-1")
    far = got["relation_discovered::city::City Registry"]
    assert (far["count"], far["confidence"], far["evidence"], far["provenance"], far["discovery_stage"], far["mode"]) == (-1, 1.0, "store -> city (2/2)", "reachability", "ReachabilityDiscovery", "discovered")
    assert got["attribute::Role::"]["capability"] == "Attributes" and "attribute::Role::" not in rows(shop, "STF-2")
    assert got["analysis::COMPARE_SIBLINGS::"]["count"] == 2 and got["analysis::COMPARE_LAYER::"]["count"] == 1
    assert [r["label"] for r in sorted(got.values(), key=lambda r: r["key"])][:3] == ["What is", "Name", "Store"]


def test_equal_identities_are_merged(spark):
    one = spark.range(1)
    make = lambda stage, n, label, conf: capability.entry(one, stage, "meta", key=F.lit("k"), label=F.lit(label), query="Q", mode="fixed", count=F.lit(n), reason="none", confidence=F.lit(conf))
    for order in ((0, 1), (1, 0)):
        parts = [make(1, 0, "first", 0.2), make(2, 7, "second", 0.1)]
        r = capability.merged(parts[order[0]].unionByName(parts[order[1]])).collect()
        assert len(r) == 1 and (r[0]["label"], r[0]["available"], r[0]["count"], r[0]["confidence"], r[0]["key"]) == ("first", True, 7, 0.2, 1)


def test_ten_observations(spark):
    e = Engine.from_rows(spark, ROBOT)
    o = e.observe("ACT-1")
    assert o["keys"] == {"pk_in": "Actuator Registry", "fk_in": ["Joint Registry"]} and o["duplicates"] == {"sheets": ["Actuator Registry", "Joint Registry"], "count": 2}
    assert o["hierarchy"] == {"parents": [{"role": "Controller (FK)", "id": "CTRL-1"}], "children": ["Joint Registry"]} and o["metadata"]["Name"] == "servo_a"
    assert {(r["dir"], r["other"]) for r in o["neighbors"].collect()} == {("in", "JNT-1"), ("in", "JNT-3"), ("out", "CTRL-1")} and len(o) == 10
    assert set(e.observe("nobody").values()) == {"UNKNOWN"}


def test_groups_of_relations(spark):
    e = spark.createDataFrame([("up", "A", "B"), ("up", "B", "C"), ("own", "A", "A"), ("to", "A", "B"), ("any", "A", "B"), ("any", "A", "C")], "rel string, src_class string, dst_class string")
    named = spark.createDataFrame([("file_path",), ("color",), ("to",)], "rel string")
    got = {r["rel"]: r["kind"] for r in derive.relation_groups(e, named).collect()}
    assert got == {"up": "Structural", "own": "Structural", "to": "Classification", "any": "Association", "file_path": "Reference", "color": "Other"}
