"""Lookups of names against scans of all entities."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from test_adjacency import read_files
from test_graph import CATALOG, owner

from loomgraph.operators import identity, textindex
from loomgraph.plans.session import Engine

WORDS = ["Left", "Right", "Shoulder", "shoulder", "Elbow", "Arm", "of", "the", "Ärmel", "x1", "ab"]


@pytest.fixture(scope="module")
def parts(spark):
    rng = random.Random(4)
    rows = [(f"{rng.choice(['PRT', 'B'])}-{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))) + ("," if i % 7 == 0 else "")) for i in range(150)]
    rows += [("PRT-900", None), ("PRT-901", ""), ("PRT-902", "PRT-900"), ("X", "lonely"), ("PRT-903", "Left Shoulder")]
    first = [["ID", "Name", "Evidence"]] + [[k, n, "a.py:1"] for k, n in rows]
    other = [["Key", "Name", "Evidence"], ["PRT-1", "twin key", None], ["Q-1", "Left Shoulder", None], ["Q-2", "unique pair", None]]
    return Engine.from_rows(spark, {"Registry Catalog": CATALOG + [owner("Part Registry", "PRT"), owner("Other Registry", "Q")], "Part Registry": first, "Other Registry": other})


def scan(rows, token):
    """The stages by looking at all entities."""
    t, low = token.strip(), token.strip().lower()
    cls, colon, rest = t.partition(":")
    rest = rest.strip()
    name = lambda r: (r["name"] or "").lower() if r["name"] is not None else None
    stages = [
        lambda r: t in (r["pk"], r["node_key"], r["canonical"]),
        lambda r: bool(colon) and r["class"].lower().startswith(cls.strip().lower()) and (name(r) == rest.lower() or r["pk"] == rest),
        lambda r: name(r) == low,
        lambda r: bool(low) and name(r) is not None and low in name(r),
    ]
    for i, test in enumerate(stages):
        if hits := [r["node_key"] for r in rows if test(r)]:
            return i, hits[: 9 if i < 3 else 8]

    def ratio(r):
        texts = [x for x in (r["name"], r["pk"]) if x is not None]
        return max(SequenceMatcher(None, low, w.lower()).ratio() for x in texts for w in [x, *(w for w in x.split() if len(w) >= 3)])

    close = sorted((-ratio(r), i) for i, r in enumerate(rows) if ratio(r) >= 0.8) if len(low) >= 3 else []
    return 4, [rows[i]["node_key"] for _, i in close[:8]]


TOKENS = ["PRT-3", "PRT-1", "prt-3", "Left Shoulder", "left  shoulder", "Other:Left Shoulder", "Part:PRT-5", "Elbow,", "lbow", "shoulder of", "ould", "e", "ärm", "Elbwo", "Shuolder", "axb", "ab", "lonley", "PTR-77", "PRT-900", "zzzz", "unique pair", "uniqe", "x", "abc"]


@pytest.mark.parametrize("token", TOKENS)
def test_lookups_are_those_of_a_scan(parts, token):
    rows = parts.entities.orderBy("ord").collect()
    stage, want = scan(rows, token)
    got = identity.resolve(parts.entities, token, index=parts.names)
    how = {0: ("id", "ambiguous_id"), 1: ("class_name", "ambiguous_name"), 2: ("name", "ambiguous_name"), 3: ("fuzzy",), 4: ("typo", "unresolved")}
    assert got.how in how[stage], (got.how, stage, want)
    assert [x["node_key"] for x in got.found] == want[:8], (got.found, want)


def test_nothing_is_called_nothing(parts):
    assert all(identity.resolve(parts.entities, t, index=parts.names).how == "unresolved" for t in ("", "Part:", "?"))


def test_shared_pieces_hold():
    rng = random.Random(1)
    for _ in range(20000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 14)))
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(0, 2)] = rng.choice(["", "a", "b", "xy"])
        b = "".join(b)
        if len(b) > 1 and SequenceMatcher(None, a, b).ratio() >= 0.8:
            kept = sum(a[i : i + 2] in b for i in range(len(a) - 1))
            assert len(b) in textindex.lengths(len(a)) and (kept >= textindex.shared_pieces(len(a), len(b)) or len(b) == 2), (a, b)


def test_lookups_read_few_files(parts):
    ix = parts.names
    for rows, files in ((ix.named(["lonely"]), ix.names), (ix._at(ix.grams, "piece", ["lo"]), ix.grams)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and ("EqualTo(" in plan or "In(" in plan)
        assert 1 <= read_files(rows) <= len(files.inputFiles()) / 3


def test_names_of_several_words_in_questions(parts):
    made = parts.plan("evidence of unique pair?")
    assert [(m.kind, m.canonical) for m in made["meanings"] if m.text == "unique pair"] == [("entity", "Q-2")]
    assert made["words"] == [] and made["execution"].target == "Q-2"
    shared = parts.entities.where(F.lower("name") == "left shoulder").count()
    made = parts.plan("show Left Shoulder")
    assert shared > 1 and len(made["ambiguous"]["Left Shoulder"]) == min(8, shared)
    assert parts.ask("evidence unique pair")["result"].collect()[0]["pk"] == "Q-2"
    assert parts.classify_word("Name").kind == "attribute" and parts.classify_word("Name").canonical == "Part Registry.Name"


def test_all_entities_of_a_shared_name_are_counted(spark):
    rows = [["ID", "Name", "Evidence"]] + [[f"PRT-{i}", "Same" if i < 12 else f"n{i}", None] for i in range(15)]
    e = Engine.from_rows(spark, {"Registry Catalog": CATALOG + [owner("Part Registry", "PRT")], "Part Registry": rows})
    got = e.resolve("same")
    assert (got.how, len(got.found), got.total) == ("ambiguous_name", 8, 12)
    assert e.resolve("PRT-3").total == 1 and e.resolve("zzzz").total == 0


def test_first_lookups_write_no_index(spark):
    rows = [["ID", "Name", "Evidence"]] + [[f"PRT-{i}", f"Left Arm {i}", None] for i in range(5)]
    e = Engine.from_rows(spark, {"Registry Catalog": CATALOG + [owner("Part Registry", "PRT")], "Part Registry": rows})
    for token in ("PRT-3", "Part:Left Arm 3", "left arm 3"):
        assert e.resolve(token).one["pk"] == "PRT-3"
    assert e.plan("evidence of left arm 4")["execution"].target == "PRT-4"
    assert not {"names", "grams"} & set(vars(e.names)) and "promoted" not in vars(e)
    e.names.looked_up = textindex.INDEX_AFTER
    assert e.resolve("left arm 3").one["pk"] == "PRT-3" and "names" in vars(e.names)
