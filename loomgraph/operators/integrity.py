"""Integrity checks of a workbook: broken keys, orphans, gaps of evidence, duplicates, and a score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import scalars as S
from loomgraph.sources.workbook import ORD, Workbook
from loomgraph.storage import written

from .identity import quoted


def check_fk(wb: Workbook, ents: DataFrame) -> DataFrame:
    """(registry, pk, column, token): values of foreign-key columns of all sheets that no owner row has."""
    out = wb.spark.createDataFrame([], "registry string, pk string, column string, token string")
    for s in wb.catalog:
        for link in s.links:
            if s.name not in wb.frames:
                continue
            rows = wb.rows(s.name).select(F.lit(s.name).alias("registry"), quoted(s.pk).cast("string").alias("pk"), F.lit(link.column).alias("column"), F.explode(F.split(quoted(link.column).cast("string"), r"\s*[;,/|]\s*")).alias("token"))
            known = ents if link.target is None else ents.where(F.col("class") == link.target)
            out = out.unionByName(rows.where("token <> ''").join(known.select(F.col("pk").alias("token")), "token", "left_anti"))
    return out


def find_orphan(e: DataFrame, ents: DataFrame, limit: int | None = 200) -> DataFrame:
    """Entities without outgoing edges, in entity order."""
    rows = ents.join(e.select(F.col("src").alias("node_key")).distinct(), "node_key", "left_anti").select("node_key", "class", "pk", "ord")
    return rows.orderBy("ord").limit(limit) if limit is not None else rows


def find_dead(wb: Workbook) -> DataFrame:
    """(registry, pk, column, value): owner rows whose status, classification or state says dead."""
    out = wb.spark.createDataFrame([], "registry string, pk string, column string, value string")
    for s in wb.owners():
        for c in wb.header(s.name):
            if any(x in c.lower() for x in ("status", "classif", "state")):
                rows = wb.rows(s.name).select(F.lit(s.name).alias("registry"), quoted(s.pk).cast("string").alias("pk"), F.lit(c).alias("column"), quoted(c).cast("string").alias("value"))
                out = out.unionByName(rows.where(F.lower("value").startswith("dead")))
    return out


def find_missing_evidence(wb: Workbook, limit: int | None = 50) -> DataFrame:
    """(registry, pk): rows of all catalogued sheets without a file and line in any cell."""
    out = wb.spark.createDataFrame([], "registry string, pk string")
    for s in wb.catalog:
        if s.name not in wb.frames:
            continue
        joined = F.concat_ws("\n", *(quoted(c).cast("string") for c in wb.header(s.name)))
        out = out.unionByName(wb.rows(s.name).where(~S.has_evidence(joined)).select(F.lit(s.name).alias("registry"), quoted(s.pk or wb.header(s.name)[0]).cast("string").alias("pk")))
    return out.orderBy("registry", "pk").limit(limit) if limit is not None else out


def duplicate_pks(wb: Workbook) -> DataFrame:
    """(registry, pk, n): keys that a sheet repeats."""
    out = wb.spark.createDataFrame([], "registry string, pk string, n long")
    for s in wb.owners():
        rows = wb.rows(s.name).groupBy(quoted(s.pk).cast("string").alias("pk")).agg(F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(rows.select(F.lit(s.name).alias("registry"), "pk", "n"))
    return out


def duplicate_names(ents: DataFrame) -> DataFrame:
    """(name, n_classes): names that entities of several classes have."""
    return ents.where("name <> ''").groupBy("name").agg(F.countDistinct("class").alias("n_classes")).where("n_classes > 1")


def shared_pks(wb: Workbook) -> DataFrame:
    """(pk, n): keys that owner rows have more than once, in one sheet or in several."""
    out = wb.spark.createDataFrame([], "pk string")
    for s in wb.owners():
        out = out.unionByName(wb.rows(s.name).select(quoted(s.pk).cast("string").alias("pk")))
    return out.where("pk <> ''").groupBy("pk").agg(F.count("*").alias("n")).where("n > 1")


def name_changes(ents: DataFrame) -> DataFrame:
    """(name, n): trimmed, lower-cased names with the times that the next entity of the name is of another class."""
    name = F.lower(F.trim("name"))
    before = F.lag("class").over(Window.partitionBy("clean").orderBy("ord"))
    rows = ents.select(name.alias("clean"), "class", "ord").where("clean <> ''").withColumn("before", before)
    return rows.where(F.col("before") != F.col("class")).groupBy(F.col("clean").alias("name")).agg(F.count("*").alias("n"))


def checks(wb: Workbook, ents: DataFrame, e: DataFrame) -> dict[str, int]:
    """The twelve integrity metrics, from one aggregate over the entities and one over each kind of finding."""
    owners = wb.owners()
    a = ents.agg(F.count("*").alias("n"), F.count_if(~F.col("has_evidence")).alias("missing"), F.collect_set("class").alias("classes")).first()  # a class a sheet
    edges = e.count()
    return {
        "objects": a["n"],
        "types": len(owners),
        "relationships": edges,
        "duplicate_pk": shared_pks(wb).count(),
        "broken_fk": check_fk(wb, ents).count(),
        "empty_registries": sum(s.name not in a["classes"] for s in owners),
        "missing_evidence": a["missing"],
        "missing_evidence_pct": round(100 * a["missing"] / a["n"]) if a["n"] else 0,
        "duplicate_names": name_changes(ents).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0],
        "schema_catalog": int(wb.declared),
        "schema_evidence": int(any(s.evidence for s in owners)),
        "schema_fk": int(edges > 0),
    }


def dashboard(c: dict[str, int]) -> str:
    """The metrics as text."""
    yes = lambda x: "yes" if x else "no"
    lines = [f"Confidence            {confidence(c)} of 100", f"Objects, types        {c['objects']}, {c['types']}", f"Relationships         {c['relationships']}"]
    lines += [f"{label:<21} {c[key]}" for label, key in (("Repeated keys", "duplicate_pk"), ("Broken links", "broken_fk"), ("Empty registries", "empty_registries"), ("Repeated names", "duplicate_names"))]
    lines.append(f"Without evidence      {c['missing_evidence']} ({c['missing_evidence_pct']} %)")
    lines.append(f"Catalog, evidence, links: {yes(c['schema_catalog'])}, {yes(c['schema_evidence'])}, {yes(c['schema_fk'])}")
    return "\n".join(lines)


def confidence(c: dict[str, int]) -> int:
    """100 less capped penalties."""
    # Penalty a finding and its cap.
    penalty = min(20, 2 * c["broken_fk"]) + min(20, 5 * c["duplicate_pk"]) + min(10, 3 * c["empty_registries"])
    if c["missing_evidence_pct"] > 20:
        penalty += min(15, (c["missing_evidence_pct"] - 20) // 5)
    penalty += 5 * (not c["schema_catalog"]) + 20 * (not c["relationships"])
    return max(0, 100 - penalty)


def find_sheets(wb: Workbook, value: str) -> DataFrame:
    """(sheet, n): sheets whose cells equal the value."""
    return wb.hits(value).groupBy("sheet").agg(F.count("*").alias("n"))


def source_files(wb: Workbook, hits: DataFrame) -> DataFrame:
    """(file): files and lines that the rows of the hits name, in any of their cells; other rows' cells aren't looked at."""
    out = wb.spark.createDataFrame([], "file string")
    for name in wb.frames:
        rows = wb.frame(name).join(hits.where(F.col("sheet") == name).select(F.col("row").alias(ORD)).distinct(), ORD, "left_semi")
        cells = rows.select(F.explode(F.array(*(quoted(c).cast("string") for c in wb.header(name)))).alias("value"))
        out = out.unionByName(cells.select(F.explode(F.regexp_extract_all("value", F.lit(r"[\w./]+\.py:\d+"), F.lit(0))).alias("file")))
    return out.distinct()


def observe(wb: Workbook, value: str, ents: DataFrame | None = None, near: DataFrame | None = None) -> dict[str, object]:
    """What a workbook says of an identifier, in ten observations; what is empty is UNKNOWN.

    Cells: occurrences, sheets, columns, rows, files and lines. With entities and the edges at the identifier: the sheet
    that owns it and those that refer to it, neighbours (a table), parents by its links and the sheets below it, in how many sheets it
    is, and its own row.
    """
    hits = written(wb.hits(value), "hits")
    r = hits.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("sheet")).alias("sheets"), F.array_sort(F.collect_set(F.concat_ws(".", "sheet", "col"))).alias("columns"), F.countDistinct("sheet", "row").alias("rows")).first()
    files = sorted(x["file"] for x in source_files(wb, hits).collect())
    found: dict[str, object] = {"occurrences": r["n"], "sheets": r["sheets"], "columns": r["columns"], "rows": r["rows"], "files": files}
    if ents is not None:
        own = ents.where((F.col("pk") == value) | (F.col("node_key") == value)).orderBy("ord").select("class", "metadata").first()
        others = [s for s in r["sheets"] if own is None or s != own["class"]]
        links = {x.column for x in wb.sheet(own["class"]).links} if own else set()
        parents = [{"role": c, "id": own["metadata"][c]} for c in wb.header(own["class"]) if (c in links or "(FK)" in c) and own["metadata"].get(c)] if own else []
        found["keys"] = {"pk_in": own and own["class"], "fk_in": others} if own or others else None
        found["hierarchy"] = {"parents": parents, "children": others} if parents or others else None
        found["duplicates"] = {"sheets": r["sheets"], "count": len(r["sheets"])} if r["sheets"] else None
        found["metadata"] = own and own["metadata"]
        found["neighbors"] = None if near is None or near.isEmpty() else near
    return {k: "UNKNOWN" if v is None or (not isinstance(v, DataFrame) and not v) else v for k, v in found.items()}
