import io
import json
import zipfile

import pytest

from loomgraph.operators import discovery
from loomgraph.sources import sinks, workbook, xlsx
from loomgraph.sources.workbook import WorkbookError


def book(sheets, shared=False):
    """The bytes of a small spreadsheet."""
    names = list(sheets)
    strings, out = [], io.BytesIO()

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if shared:
            strings.append(v)
            return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            rows = "".join(f'<row r="{r + 1}">' + "".join(cell(f"{chr(65 + c)}{r + 1}", v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(sheets[n]))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
    return out.getvalue()


SHEETS = {"Task Registry": [["Task ID", "Name", "Score", "Done"], ["TASK-1", "first", 1.5, True], ["TASK-2", None, 7, False]], "Other": [["A"], ["x"]]}


@pytest.mark.parametrize("shared", [False, True])
def test_xlsx(spark, tmp_path, shared):
    path = tmp_path / "b.xlsx"
    path.write_bytes(book(SHEETS, shared))
    wb = workbook.load(spark, str(path))
    assert list(wb.frames) == list(SHEETS)
    assert [tuple(r)[:4] for r in wb.frame("Task Registry").orderBy("_ord").collect()] == [("TASK-1", "first", "1.5", "True"), ("TASK-2", None, "7", "False")]
    spark.dataSource.register(xlsx.XlsxDataSource)
    assert spark.read.format("loom_xlsx").load(str(path)).where("sheet = 'Other'").count() == 2


def test_errors(spark, tmp_path):
    bad = tmp_path / "bad.xlsx"
    bad.write_bytes(b"not a real xlsx")
    with pytest.raises(WorkbookError, match="not a valid .xlsx"):
        workbook.load(spark, str(bad))
    with pytest.raises(WorkbookError, match="Workbook not found"):
        workbook.load(spark, str(tmp_path / "none.xlsx"))
    for name in ("a.zip", "a.pdf"):
        with pytest.raises(WorkbookError):
            workbook.load(spark, name)


def test_csv_and_tsv(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿id,name,name\n1,,x\n2,b,y\n".encode())
    (tmp_path / "t.tsv").write_text("id\tname\n1\ta\n")
    wb = workbook.load(spark, str(tmp_path / "t.csv"))
    assert wb.header("t")[0] == "id" and len(set(wb.header("t"))) == 3
    assert wb.frame("t").orderBy("_ord").first()[1] == ""
    assert workbook.load(spark, str(tmp_path / "t.tsv")).frame("t").count() == 1


def test_tabular(spark):
    rows = [["Region", "Category", "Product", "Amount"]] + [[f"r{i % 3}", f"c{i % 2}", f"p{i % 20}", 1.25 * i] for i in range(120)]
    wb = workbook.from_rows(spark, {"Sales": rows})
    assert discovery.strategy(wb) == "Tabular"
    from loomgraph.plans.session import Engine

    e = Engine(wb)
    assert e.entities.where("class = 'Sales Registry'").count() == 120
    assert e.edges.count() == 360 and len(e.contexts()) == 4


def test_zip_is_the_same_each_time(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "n int, s string")
    a, b = tmp_path / "a.zip", tmp_path / "b.zip"
    assert sinks.export_zip({"t": df}, str(a)) == {"t": 2}
    sinks.export_zip({"t": df.repartition(2)}, str(b))
    assert a.read_bytes() == b.read_bytes()
    assert json.loads(zipfile.ZipFile(a).read("t.json")) == [{"n": 1, "s": "a"}, {"n": 2, "s": "b"}]
