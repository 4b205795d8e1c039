"""Dense numbers, overlaps by samples, rewritten keys, staged links, and spreadsheets as streams."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from test_graph import CATALOG, owner

from loomgraph.operators import discovery, graph, numbering
from loomgraph.plans.session import Engine
from loomgraph.sources import workbook, xlsx
from loomgraph.sources.workbook import WorkbookError


def test_dense_numbers(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(10**6), i) for i in range(3000)] + [("a", None, -1), (None, 5, -2)]
    df = spark.createDataFrame(rows, "g string, x long, i int").repartition(7)
    key = lambda r: (r["x"] is not None, r["x"] or 0, r["i"])
    got = numbering.dense_numbers(df, ["x", "i"]).collect()
    assert [r["number"] for r in sorted(got, key=key)] == list(range(1, len(rows) + 1))
    got = numbering.dense_numbers(df, ["x", "i"], "n", within="g").collect()
    assert len(got) == len(rows)
    for g in ("a", "b", "c", None):
        mine = sorted((r for r in got if r["g"] == g), key=key)
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1))
    assert numbering.dense_numbers(df.where("false"), ["x"]).count() == 0


def overlaps(wb, pks, least=0.5, hinted=0.3):
    values = {}
    for r in wb.cells().where("value <> ''").collect():
        values.setdefault((r["sheet"], r["col"]), set()).add(r["value"])
    out = {}
    for (s, c), mine in values.items():
        for t, pk in pks.items():
            share = len(mine & values[t, pk]) / len(mine)
            if s != t and c != pks.get(s) and share >= (hinted if t[:8].lower() in c.lower() else least):
                out[s, c, t] = share
    return out


@pytest.mark.parametrize("seed", range(3))
def test_no_overlap_is_lost(spark, seed):
    """Columns of more values than the sample has, with shares on both sides of the bounds."""
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(700)]
    columns = {f"c{int(100 * p)}{'_target' if h else ''}": (p, h) for p in (0.05, 0.28, 0.31, 0.45, 0.49, 0.51, 0.8, 1.0) for h in (False, True)}
    rows = [["id", *columns, "few"]]
    for i in range(900):
        rows.append([f"r{i}", *(rng.choice(keys) if rng.random() < p else f"other{rng.randrange(600)}" for p, _ in columns.values()), rng.choice(["k1", "k2", "x"])])
    wb = workbook.from_rows(spark, {"target": [["id", "name"], *([k, "n"] for k in keys)], "rows": rows})
    pks = {"target": "id", "rows": "id"}
    got = {(r["sheet"], r["col"], r["target"]): r["overlap"] for r in discovery.fk_overlap(wb, pks, k=120).collect()}
    assert got == pytest.approx(overlaps(wb, pks), abs=1e-4) and len(got) > 5


def test_only_pairs_that_may_hold_are_joined(spark, monkeypatch):
    rows = [["id", "far", "near"]] + [[f"r{i}", f"z{i}", f"k{i}"] for i in range(3000)]
    wb = workbook.from_rows(spark, {"target": [["id"], *([f"k{i}"] for i in range(3000))], "rows": rows})
    asked, keep = [], discovery.column_cells
    monkeypatch.setattr(discovery, "column_cells", lambda wb, cs: asked.append(sorted(cs)) or keep(wb, asked[-1]))
    got = discovery.fk_overlap(wb, {"target": "id", "rows": "id"}, k=200).collect()
    assert [(r["col"], r["overlap"]) for r in got] == [("near", 1.0)]
    assert [("rows", "near")] in asked and [("rows", "far"), ("rows", "near")] not in asked[3:]


def test_keys_are_rewritten(spark):
    sheets = {"Authors": [["Author Key", "Name"], ["7", "Ann"], ["9", "Bo"], ["XX-1", "Cy"]], "Books": [["Book No", "Title", "Writer", "Sources"], ["b1", "One", "9", "s"], ["b2", "Two", "7", "t"], ["b3", "Three", "XX-1", "u"], ["b4", "Four", "55", "v"]]}
    wb = discovery.discovered(workbook.from_rows(spark, sheets))
    assert [tuple(r)[:2] for r in wb.frame("Authors").orderBy("_ord").collect()] == [("AUTH-001", "Ann"), ("AUTH-002", "Bo"), ("XX-1", "Cy")]
    books = wb.frame("Books").orderBy("_ord").collect()
    assert [r["Book No"] for r in books] == ["BOOK-001", "BOOK-002", "BOOK-003", "BOOK-004"] and [r["Writer (FK)"] for r in books] == ["AUTH-002", "AUTH-001", "XX-1", "55"]
    assert wb.sheet("Books").evidence == "Sources" and wb.sheet("Books").links[0].target == "Authors"
    e = Engine(wb)
    assert {(r["src"], r["dst"]) for r in e.edges.collect()} == {("BOOK-001", "AUTH-002"), ("BOOK-002", "AUTH-001"), ("BOOK-003", "XX-1")}


def test_links_by_stages(spark):
    place = [["Place ID", "Name", "Evidence"], ["PLC-1", "Old Town", None], ["PLC-2", "North End", None], ["PLC-3", "old town", None]]
    other = [["Other ID", "Name", "Evidence"], ["OTH-1", "North End", None], ["77", "seven", None]]
    cells = ["PLC-1", "see PLC-2 and PLC-3", "Old Town; OTH-1", "North End / nobody", "PLC-9 or PLC-1", "PLC-9", "77", "", None, "seventy", " old town "]
    want = {0: {("PLC-1", 0)}, 1: {("PLC-2", 1), ("PLC-3", 1)}, 2: {("PLC-1", 2), ("OTH-1", 0)}, 3: {("PLC-2", 2)}, 4: {("PLC-1", 1)}, 6: {("77", 0)}, 10: {("PLC-1", 2)}}
    item = [["Item ID", "Name", "Place (FK)", "Evidence"]] + [[f"ITM-{i}", "x", c, None] for i, c in enumerate(cells)]
    cat = CATALOG + [owner("Place Registry", "PLC"), owner("Other Registry", "OTH"), owner("Item Registry", "ITM", "Place → ")]
    e = Engine.from_rows(spark, {"Registry Catalog": cat, "Place Registry": place, "Other Registry": other, "Item Registry": item})
    got = {}
    for r in graph.linked(e.wb, e.entities).collect():
        got.setdefault(int(r["src_pk"].split("-")[1]), set()).add((r["dst"], r["stage"]))
    assert got == want
    assert e.edges.where(F.col("rel") == "place").count() == sum(map(len, want.values()))


def book(rows: int, strings: int = 3) -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Big" r:id="r1"/><sheet name="Gaps" r:id="r2"/><sheet name="None" r:id="r3"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/><Relationship Id="r3" Target="worksheets/c.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>s{i}</t></si>" for i in range(strings)) + "<si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        head = '<row r="1"><c r="A1" t="inlineStr"><is><t>ID</t></is></c><c r="B1" t="inlineStr"><is><t>Name</t></is></c><c r="C1" t="inlineStr"><is><t>Name</t></is></c></row>'
        with z.open("xl/worksheets/a.xml", "w") as f:
            f.write(f"<worksheet {ns}><sheetData>{head}".encode())
            for i in range(2, rows + 2):
                f.write(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}" t="s"><v>{i % (strings + 1)}</v></c><c r="C{i}"><v>0.5</v></c></row>'.encode())
            f.write(b"</sheetData></worksheet>")
        z.writestr("xl/worksheets/b.xml", f'<worksheet {ns}><sheetData>{head}<row r="3"><c r="C3" t="b"><v>1</v></c></row><row><c t="str"><v>next</v></c></row><row r="9"/></sheetData></worksheet>')
        z.writestr("xl/worksheets/c.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    return out.getvalue()


def test_spreadsheets_as_streams(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(book(5000))
    for path in (str(tmp_path / "b.xlsx"), f"file://{tmp_path}/b.xlsx"):
        wb = workbook.load(spark, path)
        assert list(wb.frames) == ["Big", "Gaps"] and wb.header("Big") == ["ID", "Name", "Name__2"]
        rows = wb.frame("Big").orderBy("_ord").collect()
        assert len(rows) == 5000 and tuple(rows[0]) == ("2", "s2", "0.5", 0) and tuple(rows[1]) == ("3", "rich", "0.5", 1)
        assert [tuple(r) for r in wb.frame("Gaps").orderBy("_ord").collect()] == [(None, None, "True", 1), ("next", None, None, 2), (None, None, None, 7)]
    assert [r.asDict() for r in xlsx.rows_through_spark(spark, str(tmp_path / "b.xlsx"), "xl/worksheets/b.xml").orderBy("row").collect()][1] == {"row": 2, "cells": [None, None, "True"]}
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    with pytest.raises(WorkbookError, match="not a valid"):
        workbook.load(spark, str(tmp_path / "bad.xlsx"))
    with pytest.raises(WorkbookError, match="not found"):
        workbook.load(spark, str(tmp_path / "none.xlsx"))


def test_rows_are_dropped_as_they_are_read():
    import tracemalloc

    z = xlsx.archive(io.BytesIO(book(60_000)))
    strings = xlsx.shared_strings(z)
    tracemalloc.start()
    n = sum(1 for _ in xlsx.sheet_rows(z, "xl/worksheets/a.xml", strings))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == 60_001 and peak < 4_000_000


def test_samples_of_groups_are_ranked_without_a_window(spark):
    from loomgraph.operators import explore

    rows = [(g, f"k{i:03d}") for g, n in (("a", 130), ("b", 40), (None, 41), ("c", 1)) for i in range(n)]
    got = explore.strided_sample(spark.createDataFrame(rows, "g string, k string"), ["g"], "k")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    want = []
    for g in ("a", "b", None, "c"):
        mine = sorted(k for h, k in rows if h == g)
        want += [(g, k) for k in (mine if len(mine) <= 40 else [mine[i] for i in sorted({j * len(mine) // 40 for j in range(40)})])]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
