"""The workbook: named sheets as DataFrames, and a catalog that says which sheets own entities and how they link.

Every sheet has a long column ``_ord`` that holds its row order, as first matches and path ties depend on it. Sheets
from files keep the order of the file; tables with a numeric key are ordered by it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date
from decimal import Decimal
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.scalars import relation_slug
from loomgraph.storage import written

CATALOG = "Registry Catalog"
ORD = "_ord"
INDEX_AFTER = 20  # lookups of values that scan the sheets, before the cells are indexed


class WorkbookError(ValueError):
    """What is wrong with an input, and what to do about it."""


@dataclass(frozen=True)
class Link:
    """A foreign-key column; without a target its values are looked up in every owner sheet."""

    column: str
    target: str | None = None

    @property
    def relation(self) -> str:
        return relation_slug(self.column)


@dataclass(frozen=True)
class Sheet:
    """What the catalog knows of a sheet. Key and label are its first two columns unless named."""

    name: str
    pk: str | None = None
    label: str | None = None
    links: tuple[Link, ...] = ()
    prefix: str | None = None
    evidence: str | None = None
    owner: bool = True
    entity: str | None = None
    relations: bool = False
    execution: bool = False
    lifecycle: bool = False
    ix: int = 0


@dataclass
class Workbook:
    spark: SparkSession
    frames: dict[str, DataFrame]
    catalog: list[Sheet] = field(default_factory=list)
    declared: bool = True
    looked_up: int = 0
    cell_index: DataFrame | None = None
    index_parts: int = 0

    def frame(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise WorkbookError(f"there is no sheet {name!r}; sheets are: {', '.join(self.frames)}")
        return self.frames[name]

    def header(self, name: str) -> list[str]:
        return [c for c in self.frame(name).columns if c != ORD]

    def sheet(self, name: str) -> Sheet | None:
        return next((s for s in self.catalog if s.name == name), None)

    def owners(self) -> list[Sheet]:
        return [s for s in self.catalog if s.owner and s.name in self.frames]

    def owner_of_prefix(self, prefix: str) -> Sheet | None:
        return next((s for s in self.owners() if s.prefix == prefix), None)

    def rows(self, name: str) -> DataFrame:
        """A sheet's rows but those without a first cell."""
        df = self.frame(name)
        first = F.col(f"`{self.header(name)[0]}`").cast("string")
        return df.where(first.isNotNull() & (first != ""))

    def with_catalog(self, catalog: Iterable[Sheet], declared: bool = True) -> Workbook:
        filled = []
        for i, s in enumerate(catalog):
            head = self.header(s.name) if s.name in self.frames else []
            filled.append(replace(s, ix=i, pk=s.pk or (head[0] if head else None), label=s.label or (head[1] if len(head) > 1 else None)))
        return Workbook(self.spark, self.frames, filled, declared)

    def cells(self, sheets: Iterable[str] | None = None) -> DataFrame:
        """All non-null cells as (sheet, row, col_ix, col, value), a row per cell; without an exchange."""
        parts = []
        for name in sheets or self.frames:
            head = self.header(name)
            items = F.array(*(F.struct(F.lit(i).alias("col_ix"), F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(head)))
            df = self.frame(name).select(F.lit(name).alias("sheet"), F.col(ORD).alias("row"), F.explode(items).alias("c"))
            parts.append(df.select("sheet", "row", "c.col_ix", "c.col", "c.value").where(F.col("value").isNotNull()))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


    def index_cells(self, per_part: int = 1 << 20) -> None:
        """Writes all cells in folders by a hash of the value, sorted by it, with bloom filters: a lookup reads one folder of all."""
        cells = self.cells()
        self.index_parts = min(4096, max(8, cells.count() // per_part))
        part = F.pmod(F.xxhash64("value"), F.lit(self.index_parts)).cast("int")
        rows = cells.withColumn("part", part).repartition("part", F.pmod(F.xxhash64("sheet", "row"), F.lit(16))).sortWithinPartitions("part", "value")
        self.cell_index = written(rows, "cells", "part", **{"parquet.bloom.filter.enabled#value": "true"})

    def hits(self, value: str, sheets: Iterable[str] | None = None) -> DataFrame:
        """Cells that equal the value, as (sheet, row, col_ix, col, value), of all or some sheets.

        The first lookups filter the sheets by typed columns, which reaches the scans; a workbook that is asked more often gets an
        index of its cells.
        """
        self.looked_up += 1
        if self.cell_index is None and self.looked_up > INDEX_AFTER:
            self.index_cells()
        if self.cell_index is not None:
            part = F.pmod(F.xxhash64(F.lit(value)), F.lit(self.index_parts)).cast("int")
            found = self.cell_index.where((F.col("part") == part) & (F.col("value") == value)).drop("part")
            return found if sheets is None else found.where(F.col("sheet").isin(list(sheets)))
        return self.scanned_hits(value, sheets)

    def scanned_hits(self, value: str, sheets: Iterable[str] | None = None) -> DataFrame:
        """The same by a filter on typed columns of each sheet."""
        out = self.spark.createDataFrame([], "sheet string, row long, col_ix int, col string, value string")
        for name in self.frames if sheets is None else sheets:
            df = self.frame(name)
            head = self.header(name)
            tests = [(i, c, t) for i, c in enumerate(head) if (t := _equal(F.col(f"`{c}`"), df.schema[c].dataType, value)) is not None]
            if not tests:
                continue
            any_ = tests[0][2]
            for *_, t in tests[1:]:
                any_ = any_ | t
            items = F.array(*(F.struct(F.lit(i).alias("col_ix"), F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for i, c, _ in tests))
            part = df.where(any_).select(F.lit(name).alias("sheet"), F.col(ORD).alias("row"), F.explode(items).alias("c"))
            out = out.unionByName(part.select("sheet", "row", "c.col_ix", "c.col", "c.value").where(F.col("value") == value))
        return out


def _equal(column: Column, kind: T.DataType, value: str) -> Column | None:
    """A condition that a column has to meet for its cells to read like the value, without a cast of the column; None if none can."""
    try:
        if isinstance(kind, T.StringType):
            return column == value
        if isinstance(kind, T.BooleanType):
            return column == (value == "true") if value in ("true", "false") else None
        if isinstance(kind, T.IntegralType):
            bits = {"byte": 7, "short": 15, "integer": 31, "long": 63}[kind.typeName()]
            return column == int(value) if str(int(value)) == value and -(1 << bits) <= int(value) < 1 << bits else None
        if isinstance(kind, T.DecimalType):
            return column == Decimal(value)
        if isinstance(kind, T.FractionalType):
            return column == F.lit(float(value)).cast(kind)
        if isinstance(kind, T.DateType):
            return column == F.lit(date.fromisoformat(value))
    except (ValueError, ArithmeticError):
        return None
    return column.cast("string") == value


def unique_header(labels: Sequence[object]) -> list[str]:
    """Labels as column names; repeated ones get a number, blank ones a place."""
    out: list[str] = []
    for i, x in enumerate(labels):
        base = str(x).strip() if x is not None and str(x).strip() else f"column_{i + 1}"
        name, n = base, 2
        while name.lower() in {o.lower() for o in out}:
            name, n = f"{base}__{n}", n + 1
        out.append(name)
    return out


def from_rows(spark: SparkSession, sheets: Mapping[str, Sequence[Sequence[object]]]) -> Workbook:
    """Sheets given as lists of rows, the first the header; cells become strings."""
    frames = {}
    for name, rows in sheets.items():
        if not rows:
            continue
        head = unique_header(rows[0])
        text = lambda v: None if v is None else str(v)
        body = [[*(text(r[i]) if i < len(r) else None for i in range(len(head))), n] for n, r in enumerate(rows[1:])]
        schema = T.StructType([*(T.StructField(h, T.StringType()) for h in head), T.StructField(ORD, T.LongType())])
        frames[name] = spark.createDataFrame(body, schema)
    return Workbook(spark, frames)


def from_csv(spark: SparkSession, path: str) -> Workbook:
    """A .csv or .tsv file as a workbook of one sheet; all cells are strings, empty ones stay empty strings."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in (".csv", ".tsv"):
        raise WorkbookError(f"not a .csv or .tsv file: {path}")
    df = spark.read.csv(path, sep="\t" if suffix == ".tsv" else ",", header=True, inferSchema=False, multiLine=True, encoding="UTF-8").na.fill("")
    df = df.toDF(*unique_header([c.lstrip("﻿") for c in df.columns]))
    return Workbook(spark, {PurePosixPath(path).stem: df.withColumn(ORD, F.monotonically_increasing_id())})


def from_parquet(spark: SparkSession, folder: str, catalog: Sequence[Sheet], extra: Sequence[str] = ()) -> Workbook:
    """Parquet tables as sheets; a table is ordered by its numeric key, or else as its files are."""
    frames = {}
    for s in [*catalog, *(Sheet(x, owner=False) for x in extra)]:
        df = spark.read.parquet(f"{folder}/{s.name}.parquet")
        numeric = s.pk is not None and isinstance(df.schema[s.pk].dataType, T.IntegralType)
        frames[s.name] = df.withColumn(ORD, F.col(s.pk).cast("long") if numeric else F.monotonically_increasing_id())
    return Workbook(spark, frames).with_catalog(catalog)


def load(spark: SparkSession, path: str) -> Workbook:
    """A workbook by file type: .xlsx, .csv or .tsv."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".zip":
        raise WorkbookError(f"{path} is a ZIP archive, not a workbook; extract the workbook first")
    if suffix in (".csv", ".tsv"):
        return from_csv(spark, path)
    if suffix in (".xlsx", ".xlsm"):
        from .xlsx import from_xlsx

        return from_xlsx(spark, path)
    raise WorkbookError(f"unsupported file type {suffix!r}; use .xlsx, .csv or .tsv")
