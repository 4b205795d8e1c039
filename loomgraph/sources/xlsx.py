"""Spreadsheets in Office Open XML, by the standard library: shared and inline strings, numbers, booleans, cached results.

A workbook's parts are members of a ZIP archive. The driver reads the list of sheets and each sheet's first row; the rows are
read by executors, a sheet a partition, as a stream of events: a row's elements are dropped once it is read, so that memory
holds one row and the shared strings, which a worker reads once a file. The file is opened by the file system that its path
names and read in pieces; a file of a store that Spark alone can open is handed to the executors by Spark, row by row of
bytes, and is then held whole by the task that reads it.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .workbook import ORD, Workbook, WorkbookError, unique_header

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
INVALID = "the file is not a valid .xlsx workbook; save it again as .xlsx or export it to CSV"
_strings: dict[tuple[str, int], list[str]] = {}  # of the file that a worker reads, by its path and size


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def cell_value(cell: ET.Element, strings: list[str]) -> object:
    kind, v = cell.get("t"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return strings[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e", "d"):
        return v.text
    number = float(v.text)
    return int(number) if number.is_integer() else number


def opened(path: str) -> IO[bytes]:
    """A file that can be read from any place, by the file system that the path names; a path without one is local to whoever reads it."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def elements(member: IO[bytes], tag: str) -> Iterator[ET.Element]:
    """Whole elements of a name, one after the other; each is dropped before the next is read."""
    events = ET.iterparse(member, events=("start", "end"))
    _, root = next(events)
    above = [root]
    for event, x in events:
        if event == "start":
            above.append(x)
            continue
        above.pop()
        if x.tag == tag:
            yield x
            if above:
                above[-1].remove(x)


def archive(data: IO[bytes]) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(data)
    except zipfile.BadZipFile as e:
        raise WorkbookError(INVALID) from e


def sheet_members(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(title, member) of every sheet, in workbook order."""
    try:
        book, rels = ET.fromstring(z.read("xl/workbook.xml")), ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    except (KeyError, zipfile.BadZipFile) as e:
        raise WorkbookError(INVALID) from e
    links = {r.get("Id"): r.get("Target").lstrip("/") for r in rels}
    found = [(s.get("name"), links[s.get(f"{REL}id")]) for s in book.iter(f"{MAIN}sheet")]
    return [(name, t if t.startswith("xl/") else f"xl/{t}") for name, t in found]


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    with z.open("xl/sharedStrings.xml") as member:
        return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in elements(member, f"{MAIN}si")]


def sheet_rows(z: zipfile.ZipFile, member: str, strings: list[str]) -> Iterator[tuple[int, list[object]]]:
    """(place from 0, values) of the rows that a sheet has; a value's place is its column's."""
    last = -1
    with z.open(member) as data:
        for row in elements(data, f"{MAIN}row"):
            last = int(row.get("r") or last + 2) - 1
            values: list[object] = []
            for cell in row.iter(f"{MAIN}c"):
                i = column_number(cell.get("r") or "") if cell.get("r") else len(values)
                values += [None] * (i + 1 - len(values))
                values[i] = cell_value(cell, strings)
            yield last, values


def read_sheets(data: bytes) -> Iterator[tuple[str, list[list[object]]]]:
    """(title, rows) of every sheet of a small workbook, in workbook order."""
    z = archive(io.BytesIO(data))
    strings = shared_strings(z)
    for name, member in sheet_members(z):
        rows: list[list[object]] = []
        for at, values in sheet_rows(z, member, strings):
            rows += [[] for _ in range(at - len(rows))] + [values]
        yield name, rows


def text(v: object) -> str | None:
    return None if v is None else str(v)


def first_rows(z: zipfile.ZipFile) -> list[tuple[str, str, list[object]]]:
    """(title, member, first row) of every sheet that has rows. The shared strings are read as far as the first rows need them."""
    out, strings = [], None
    for name, member in sheet_members(z):
        if strings is None:
            strings = shared_strings(z)
        row = next(sheet_rows(z, member, strings), None)
        if row is not None:
            out.append((name, member, row[1] if row[0] == 0 else []))
    return out


def from_xlsx(spark: SparkSession, path: str) -> Workbook:
    """A workbook's sheets, the first row of each being its header; cells are strings. Rows go from executors to Spark."""
    try:
        with opened(path) as f:
            found = first_rows(archive(f))
        through = False
    except (OSError, ValueError) as e:  # no such path for Python's file systems; Spark may have one
        if isinstance(e, WorkbookError):
            raise
        try:
            content = spark.read.format("binaryFile").load(path).select("content").first()
        except Exception as x:
            raise WorkbookError(f"Workbook not found: {path}") from x
        found, through = first_rows(archive(io.BytesIO(bytes(content[0])))), True
    spark.dataSource.register(XlsxDataSource)
    frames = {}
    for name, member, top in found:
        head = unique_header([text(x) for x in top])
        if through:
            rows = rows_through_spark(spark, path, member)
        else:
            rows = spark.read.format(XlsxDataSource.name()).option("path", path).option("member", member).load()
        cells = [F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(head)]
        frames[name] = rows.where("row > 0").select(*cells, (F.col("row") - 1).alias(ORD))
    return Workbook(spark, frames)


def rows_through_spark(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(row, cells) of a sheet of a file that Spark opens."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                z = archive(io.BytesIO(content))
                held: list[tuple[int, list[str | None]]] = []
                for at, values in sheet_rows(z, member, shared_strings(z)):
                    held.append((at, [text(v) for v in values]))
                    if len(held) == 5000:
                        yield pd.DataFrame(held, columns=["row", "cells"])
                        held = []
                yield pd.DataFrame(held, columns=["row", "cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, cells array<string>")


class XlsxDataSource(DataSource):
    """A spreadsheet (option path), a sheet a partition; executors have to reach the path.

    Cells of all sheets as (sheet, row, col_ix, value), or the rows of one sheet (option member) as (row, cells).
    """

    @classmethod
    def name(cls) -> str:
        return "loom_xlsx"

    def schema(self) -> str:
        return "row long, cells array<string>" if "member" in self.options else "sheet string, row long, col_ix int, value string"

    def reader(self, schema):
        return XlsxReader(self.options["path"], self.options.get("member"))


@dataclass
class SheetPart(InputPartition):
    title: str
    member: str


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, member: str | None):
        self.path, self.member = path, member

    def partitions(self):
        if self.member is not None:
            return [SheetPart("", self.member)]
        with opened(self.path) as f:
            return [SheetPart(*x) for x in sheet_members(archive(f))] or [SheetPart("", "")]

    def read(self, partition):
        if not partition.member:
            return
        with opened(self.path) as f:
            z = archive(f)
            size = f.seek(0, 2)
            if (self.path, size) not in _strings:
                _strings.clear()
                _strings[self.path, size] = shared_strings(z)
            for at, values in sheet_rows(z, partition.member, _strings[self.path, size]):
                if self.member is not None:
                    yield at, [text(v) for v in values]
                else:
                    yield from ((partition.title, at, i, str(v)) for i, v in enumerate(values) if v is not None)
