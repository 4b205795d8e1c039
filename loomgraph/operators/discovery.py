"""Schema discovery: column profiles, keys, links between sheets, flat tables as star schemas, and kinds of workbooks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomgraph.functions import scalars as S
from loomgraph.sources.workbook import CATALOG, ORD, Link, Sheet, Workbook, WorkbookError
from loomgraph.storage import written

from . import numbering
from .identity import quoted

ID = re.compile(S.ID_REGISTRY)


def profile(wb: Workbook, sheets: Iterable[str] | None = None) -> DataFrame:
    """(sheet, col, col_ix, n, filled, d, numeric, ids, prefix_share, dates): one row a column, by one aggregate a sheet."""
    out = None
    for name in sheets or wb.frames:
        head = wb.header(name)
        items = F.array(*(F.struct(F.lit(i).alias("col_ix"), F.lit(c).alias("col"), quoted(c).cast("string").alias("value")) for i, c in enumerate(head)))
        rows = wb.frame(name).select(F.explode(items).alias("x")).select("x.*")
        v = F.col("value")
        part = rows.groupBy("col", "col_ix").agg(
            F.count("*").alias("n"),
            F.count("value").alias("filled"),
            F.countDistinct("value").alias("d"),
            F.count_if(S.is_number(v)).alias("numeric"),
            F.count_if(v.rlike(S.ID_REGISTRY)).alias("ids"),
            F.count_if(v.rlike(r"^\d{4}-\d{2}-\d{2}")).alias("dates"),
        )
        part = part.select(F.lit(name).alias("sheet"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def pk_scores(columns: DataFrame) -> DataFrame:
    """(sheet, col, score): candidates are unique and full; 10 for the first column, 8 for a name that says key, 5 for identifiers."""
    name = F.lower("col")
    score = F.when(F.col("col_ix") == 0, 10).otherwise(0) + F.when(name.rlike("id|key|code|pk"), 8).otherwise(0) + F.when(F.col("ids") >= 0.7 * F.col("n"), 5).otherwise(0)
    return columns.where((F.col("n") > 0) & (F.col("d") == F.col("n"))).select("sheet", "col", "col_ix", score.alias("score"))


def detect_pks(columns: DataFrame) -> DataFrame:
    """(sheet, col, score): the best candidate of each sheet, ties to the first column."""
    w = Window.partitionBy("sheet").orderBy(F.desc("score"), "col_ix")
    return pk_scores(columns).withColumn("r", F.row_number().over(w)).where("r = 1").select("sheet", "col", "score")


SAMPLED = 1024  # distinct values of a column that its overlaps are estimated by
MISSED = 1e-12  # probability that an overlap is estimated too low to be looked at


def column_cells(wb: Workbook, columns: Iterable[tuple[str, str]]) -> DataFrame:
    """(sheet, col, value) of some columns' cells that aren't empty; other columns aren't read."""
    by_sheet: dict[str, list[str]] = {}
    for s, c in columns:
        by_sheet.setdefault(s, []).append(c)
    out = wb.spark.createDataFrame([], "sheet string, col string, value string")
    for s, cs in by_sheet.items():
        items = F.array(*(F.struct(F.lit(c).alias("col"), quoted(c).cast("string").alias("value")) for c in cs))
        out = out.unionByName(wb.frame(s).select(F.lit(s).alias("sheet"), F.explode(items).alias("x")).select("sheet", "x.*"))
    return out.where("value <> ''")


def sampled_values(wb: Workbook, columns: list[tuple[str, str]], k: int) -> DataFrame:
    """(sheet, col, value, whole): the distinct values of each column whose hashes are below a bound, some k of them; all, if there are no more.

    Columns are counted roughly first. Both passes exchange a sketch or a sample of each column, not its cells.
    """
    counts = column_cells(wb, columns).groupBy("sheet", "col").agg(F.approx_count_distinct("value", 0.02).alias("d"))
    bounds = [(r["sheet"], r["col"], min(1.0, k / max(1, r["d"])), r["d"] < 0.8 * k) for r in counts.collect()]  # a row a column
    known = F.broadcast(wb.spark.createDataFrame([(s, c, 1.0 if whole else share, whole) for s, c, share, whole in bounds], "sheet string, col string, share double, whole boolean"))
    at = F.pmod(F.xxhash64("value"), F.lit(1 << 30)) / float(1 << 30)
    return column_cells(wb, columns).join(known, ["sheet", "col"]).where(at < F.col("share")).select("sheet", "col", "value", "whole").distinct()


def fk_overlap(wb: Workbook, pks: dict[str, str], least: float = 0.5, hinted: float = 0.3, k: int = SAMPLED) -> DataFrame:
    """(sheet, col, target, overlap): columns whose distinct values are keys of another sheet, by share.

    A share of ``hinted`` is enough where the column's name holds the target's (its first eight letters). The shares are estimated
    by a sample of each column first: for columns of few values they are exact, of the others only those pairs are joined
    whose share may be large enough, by Hoeffding's bound, so that a true pair is lost with a probability of MISSED at most.
    """
    spark, schema = wb.spark, "sheet string, col string, target string, overlap double"
    columns = [(s, c) for s in wb.frames for c in wb.header(s) if c != pks.get(s)]
    if not pks or not columns:
        return spark.createDataFrame([], schema)
    sample = written(sampled_values(wb, columns, k), "overlap-sample")
    keys = column_cells(wb, pks.items()).select(F.col("sheet").alias("target"), "value")
    sizes = sample.groupBy("sheet", "col", "whole").agg(F.count("*").alias("n"))
    met = F.broadcast(sample) if sample.count() <= 200_000 else sample
    hits = keys.join(met, "value").where(F.col("sheet") != F.col("target")).groupBy("sheet", "col", "target").agg(F.countDistinct("value").alias("hits"))
    need = F.when(F.lower("col").contains(F.lower(F.substring("target", 1, 8))), F.lit(hinted)).otherwise(F.lit(least))
    rows = hits.join(sizes, ["sheet", "col"]).withColumn("share", F.col("hits") / F.col("n")).withColumn("need", need)
    rows = written(rows, "overlap-estimates")  # a row a pair of columns that meet
    exact = rows.where("whole").select("sheet", "col", "target", F.bround("share", 4).alias("overlap"), "need")
    slack = F.sqrt(F.lit(math.log(1 / MISSED)) / (2 * F.col("n")))
    left = [(r["sheet"], r["col"], r["target"], r["need"]) for r in rows.where(~F.col("whole") & (F.col("share") + slack >= F.col("need"))).collect()]  # a row a pair that is left
    if left:
        values = column_cells(wb, dict.fromkeys((s, c) for s, c, *_ in left)).distinct()
        total = values.groupBy("sheet", "col").agg(F.count("*").alias("total"))
        asked = F.broadcast(spark.createDataFrame(left, "sheet string, col string, target string, need double"))
        targets = column_cells(wb, {t: pks[t] for *_, t, _ in left}.items()).select(F.col("sheet").alias("target"), "value")
        found = values.join(targets, "value").join(asked, ["sheet", "col", "target"]).groupBy("sheet", "col", "target", "need").agg(F.countDistinct("value").alias("hits"))
        found = found.join(total, ["sheet", "col"]).select("sheet", "col", "target", F.bround(F.col("hits") / F.col("total"), 4).alias("overlap"), "need")
        exact = exact.unionByName(found)
    return exact.where(F.col("overlap") >= F.col("need")).select("sheet", "col", "target", "overlap")


def slug_prefix(name: str, used: set[str]) -> str:
    """Up to four capital letters of a name, with a number where they are taken."""
    base = (re.sub(r"[^A-Za-z]", "", name).upper() or "X")[:4]
    out, n = base, 2
    while out in used:
        out, n = f"{base[:3]}{n}", n + 1
    used.add(out)
    return out


def key_map(wb: Workbook, sheet: str, pk: str, prefix: str) -> DataFrame:
    """(old, new): PREFIX-nnn by the row's number for each key that doesn't look like one already."""
    rows = numbering.dense_numbers(wb.frame(sheet).select(ORD, quoted(pk).cast("string").alias("old")), [ORD]).where("old IS NOT NULL")
    new = F.when(F.col("old").rlike(r"^[A-Z]{2,6}-\w"), F.col("old")).otherwise(F.format_string(f"{prefix}-%03d", "number"))
    return rows.groupBy("old").agg(F.max_by(new, "number").alias("new"))


def discovered(wb: Workbook) -> Workbook:
    """A catalog from the data: keys, and links to the first sheet, in workbook order, that holds a column's values.

    Keys become PREFIX-nnn, by a prefix of the sheet's name and the row's number, unless they have that form, and links are
    rewritten alike, by joins with the keys' map; their columns are marked (FK). Values that are no keys stay.
    """
    pks = {r["sheet"]: r["col"] for r in detect_pks(profile(wb)).collect()}  # a row a sheet
    order = list(wb.frames)
    target: dict[tuple[str, str], str] = {}
    for r in sorted(fk_overlap(wb, pks).collect(), key=lambda r: (order.index(r["sheet"]), wb.header(r["sheet"]).index(r["col"]), order.index(r["target"]))):
        target.setdefault((r["sheet"], r["col"]), r["target"])
    used: set[str] = set()
    prefix = {s: slug_prefix(s, used) for s in order}
    maps = {s: written(key_map(wb, s, c, prefix[s]), "keys") for s, c in pks.items()}

    def rewritten(df: DataFrame, column: str, of: str) -> DataFrame:
        keys = maps[of].select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        kept = [quoted(c) if c != column else F.coalesce("_new", quoted(c).cast("string")).alias(c) for c in df.columns]
        return df.join(keys, quoted(column).cast("string") == F.col("_old"), "left").select(*kept)

    frames, sheets = {}, []
    for s in order:
        df, pk = wb.frame(s), pks.get(s)
        marked = {c: c if "(FK)" in c else f"{c} (FK)" for c in wb.header(s) if (s, c) in target}
        for c in [pk] if pk else []:
            df = rewritten(df, c, s)
        for c in marked:
            df = rewritten(df, c, target[s, c])
        frames[s] = df.withColumnsRenamed(marked)
        head = [c for c in frames[s].columns if c != ORD]
        label = next((c for c in head if "name" in c.lower() and c != pk), next((c for c in head if c != pk), pk))
        links = tuple(Link(marked[c], target[s, c]) for c in marked)
        sheets.append(Sheet(s, pk=pk, label=label, links=links, prefix=prefix[s], owner=pk is not None, evidence=next((c for c in head if any(x in c.lower() for x in ("evidence", "source", "reference", "citation"))), None)))
    return Workbook(wb.spark, frames).with_catalog(sheets, declared=False)


def catalog_from_sheet(wb: Workbook) -> Workbook | None:
    """The catalog that a workbook declares in its own sheet, or None where it has none with the required columns."""
    if CATALOG not in wb.frames:
        return None
    head = wb.header(CATALOG)
    need = ("Registry (self)", "Role in Model", "PK Prefix")
    if any(x not in head for x in need):
        return None
    rows = [r.asDict() for r in wb.frame(CATALOG).orderBy(ORD).collect()]  # a row a sheet
    if not rows:
        return None
    sheets = []
    for r in rows:
        name = r["Registry (self)"]
        cells = wb.header(name) if name in wb.frames else []
        given = {}
        for part in re.split(r"\s*;\s*", r.get(next((h for h in head if h.startswith("FK Edges")), ""), None) or ""):
            col, _, target = part.partition("→")
            if col.strip():
                given[col.strip()] = target.strip() or None
        links = tuple(Link(c, next((t for g, t in given.items() if g.split("(")[0].strip() == c.split("(")[0].strip() and t in wb.frames), None)) for c in cells if "(FK)" in c)
        yes = lambda k: str(r.get(k) or "").strip().lower() in ("yes", "y", "✅", "✓", "true", "1")
        role = r["Role in Model"] or ""
        noun = re.search(r"entity:\s*([^)]+)", role)
        evidence = r.get("Evidence Col") if r.get("Evidence Col") in cells else next((c for c in cells if "evidence" in c.lower()), None)
        is_rel = yes("Rel-Provider")
        sheets.append(Sheet(name, prefix=r["PK Prefix"], owner=role.startswith("Owner"), entity=noun and noun[1], links=() if is_rel else links, evidence=evidence, relations=is_rel, execution=yes("Exec-Provider")))
    return wb.with_catalog(sheets)


def strategy(wb: Workbook) -> str:
    """Registry if a catalog or a sheet of identifiers is there; Tabular for a flat sheet; else Unknown."""
    if CATALOG in wb.frames and not wb.frame(CATALOG).isEmpty():
        return "Registry"
    stats = {}
    for s in wb.frames:
        first = quoted(wb.header(s)[0])
        stats[s] = wb.frame(s).agg(F.count("*").alias("n"), F.count_if(first.cast("string").rlike(S.ID_REGISTRY)).alias("ids")).first()
    if any(r["n"] and r["ids"] >= 0.7 * r["n"] for r in stats.values()):
        return "Registry"
    return "Tabular" if any(r["n"] >= 20 and len(wb.header(s)) >= 3 for s, r in stats.items()) else "Unknown"


def infer_catalog(wb: Workbook) -> Workbook:
    """Owner sheets are those whose first column holds unique identifiers; columns marked (FK), or half of whose first values have a known prefix, link."""
    columns = {(r["sheet"], r["col"]): r for r in profile(wb).collect()}  # a row a column
    owners = {s for s in wb.frames if (p := columns.get((s, wb.header(s)[0]))) and p["n"] and p["ids"] == p["n"] == p["d"]}
    prefixes = {}
    for s in owners:
        v = wb.frame(s).orderBy(ORD).select(quoted(wb.header(s)[0])).first()[0]
        prefixes[s] = v.split("-")[0]
    sheets = []
    for s in wb.frames:
        if s == CATALOG:
            continue
        head = wb.header(s)
        links = []
        first = first_values(wb, s)
        for c in head[1:]:
            values = [str(v) for v in first[c]]
            hits = [v.split("-")[0] for v in values if v.split("-")[0] in prefixes.values()]
            if "(FK)" in c or (hits and len(hits) >= max(1, len(values) // 2)):
                target = next((o for o, p in prefixes.items() if hits and p == hits[0]), None)
                links.append(Link(c, target))
        sheets.append(Sheet(s, links=tuple(links), prefix=prefixes.get(s), owner=s in owners, evidence=next((c for c in head if "evidence" in c.lower()), None)))
    return wb.with_catalog(sheets, declared=False)


def column_roles(wb: Workbook, sheet: str) -> DataFrame:
    """(col, col_ix, role): measure if mostly numeric or dates or constant; dimension if it repeats; else measure."""
    p = profile(wb, [sheet])
    number = (F.col("filled") > 0) & (F.col("numeric") >= 0.7 * F.col("filled"))
    role = F.when(number | (F.col("dates") > 0.5 * F.col("filled")) | (F.col("d") <= 1), "measure").when(F.col("d") < 0.98 * F.col("filled"), "dimension").otherwise("measure")
    return p.select("col", "col_ix", role.alias("role"))


def dimension_values(wb: Workbook, sheet: str, columns: Iterable[str]) -> DataFrame:
    """(col, value, number): distinct values of dimension columns, numbered by first appearance."""
    items = F.array(*(F.struct(F.lit(c).alias("col"), quoted(c).cast("string").alias("value")) for c in columns))
    rows = wb.frame(sheet).select(F.col(ORD), F.explode(items).alias("x")).select(ORD, "x.*").where("value <> ''")
    first = rows.groupBy("col", "value").agg(F.min(ORD).alias("at"))
    return numbering.dense_numbers(first, ["at", "value"], within="col").select("col", "value", F.col("number").cast("int").alias("number"))


def star_schema(wb: Workbook, sheet: str | None = None) -> Workbook:
    """A flat sheet as a fact registry (REC-n) that links to a registry for each dimension column."""
    counts = {s: wb.frame(s).count() for s in wb.frames}
    sheet = sheet or max(counts, key=counts.get, default=None)
    if sheet is None:
        raise WorkbookError("the workbook has no sheets")
    roles = {r["col"]: r["role"] for r in column_roles(wb, sheet).orderBy("col_ix").collect()}  # a row a column
    dims = [c for c in wb.header(sheet) if roles[c] == "dimension"]
    values = dimension_values(wb, sheet, dims) if dims else None
    used: set[str] = {"REC"}
    frames, sheets = {}, []
    fact = wb.frame(sheet)
    for c in dims:
        prefix = slug_prefix(c, used)
        d = values.where(F.col("col") == c).select(F.format_string(f"{prefix}-%d", "number").alias(f"{c} ID"), F.col("value").alias("Name"), F.col("number").cast("long").alias(ORD))
        frames[f"{c} Registry"] = d
        sheets.append(Sheet(f"{c} Registry", pk=f"{c} ID", label="Name", prefix=prefix))
        ids = d.select(F.col("Name").alias("_v"), F.col(f"{c} ID").alias(f"{c} (FK)"))
        fact = fact.join(ids, quoted(c).cast("string") == F.col("_v"), "left").drop("_v", c)
    rest = [c for c in fact.columns if c != ORD]
    fact = fact.select(F.concat(F.lit("REC-"), (F.col(ORD) + 1).cast("string")).alias("Record ID"), *(quoted(c) for c in rest), ORD)
    frames[f"{sheet} Registry"] = fact
    sheets.append(Sheet(f"{sheet} Registry", pk="Record ID", label=rest[0] if rest else None, prefix="REC", links=tuple(Link(f"{c} (FK)", f"{c} Registry") for c in dims)))
    return Workbook(wb.spark, frames).with_catalog(sheets, declared=False)


def prepared(wb: Workbook) -> Workbook:
    """A workbook with a catalog: declared, inferred, from a flat table, or discovered, whichever fits first."""
    how = strategy(wb)
    if how == "Registry":
        return catalog_from_sheet(wb) or infer_catalog(wb)
    return star_schema(wb) if how == "Tabular" else discovered(wb)


def classify(wb: Workbook) -> dict[str, object]:
    """The kind of a workbook with the figures that decide it."""
    columns = profile(wb).where("col_ix = 0").collect()  # a row a sheet
    sheets = len(columns)
    ids = sum(r["n"] > 0 and r["ids"] >= 0.7 * r["n"] for r in columns)
    rows = sum(r["n"] for r in columns)
    ratio = ids / sheets if sheets else 0.0
    kind = "Architecture Registry" if CATALOG in wb.frames or ratio >= 0.5 else "Business Dataset" if rows >= 50 else "Generic Relational" if ids else "Unknown"
    return {"kind": kind, "sheets": sheets, "rows": rows, "id_ratio": ratio, "status": "Verified" if CATALOG in wb.frames else "Candidate" if kind != "Unknown" else "Rejected"}


def is_architecture(wb: Workbook) -> bool:
    return classify(wb)["kind"] == "Architecture Registry"


def summary(wb: Workbook) -> str:
    """The kind of a workbook and its size as text."""
    c = classify(wb)
    columns = sum(len(wb.header(s)) for s in wb.frames)
    lines = [f"Workbook type  {c['kind']} ({c['status']})", f"Sheets         {c['sheets']}", f"Rows           {c['rows']}", f"Columns        {columns}"]
    why = "a catalog sheet" if CATALOG in wb.frames else f"identifiers lead {c['id_ratio']:.0%} of the sheets"
    return "\n".join([*lines, f"Because of     {why}"])


NO_PROSE = ("not found", "none", "n/a", "-")
PROSE_EDGE = "src string, rel string, dst string, src_class string, dst_class string, evidence string, flow string, source string, ord struct<sheet:int,row:bigint,nth:int>, how int"


def plain_text(value: Column) -> Column:
    """Without what is in brackets, trimmed, in small letters."""
    return F.lower(F.regexp_replace(F.regexp_replace(value, r"\(.*?\)", ""), r"^\s+|\s+$", ""))


def prose_parts(wb: Workbook, s: Sheet, column: str) -> DataFrame:
    """(pk, evidence, row, nth, core): the parts of a column's cells, at ; , or /."""
    evidence = quoted(s.evidence).cast("string") if s.evidence else F.lit(None).cast("string")
    rows = wb.rows(s.name).select(quoted(s.pk).cast("string").alias("pk"), evidence.alias("evidence"), F.col(ORD).alias("row"), F.posexplode(F.split(quoted(column).cast("string"), "[;,/]")).alias("nth", "part"))
    return rows.select("pk", "evidence", "row", "nth", plain_text(F.col("part")).alias("core")).where("core <> ''")


def prose_target(wb: Workbook, header: str) -> Sheet | None:
    """The first owner whose title holds a word of the header, of four letters or more, with or without an s at its end."""
    words = [w for w in re.split(r"[^a-z]+", header.lower()) if len(w) > 3]
    return next((o for o in wb.owners() if any(w in o.name.lower() or w.rstrip("s") in o.name.lower() for w in words)), None)


def is_prose(wb: Workbook, s: Sheet, column: str) -> bool:
    """Whether fewer than half of a column's first 20 values look like identifiers."""
    values = [r[0] for r in wb.rows(s.name).where(quoted(column).isNotNull()).orderBy(ORD).select(quoted(column).cast("string")).limit(20).collect()]
    return bool(values) and sum(bool(re.match(S.ID_START, v)) for v in values) < max(1, len(values) // 2)


def grams(text: Column, n: int) -> Column:
    """Distinct pieces of n characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def first_match(rows: DataFrame, how: int) -> DataFrame:
    """(core, dst, how): the first name of each text in entity order."""
    return rows.groupBy("core").agg(F.min_by("dst", "ord").alias("dst")).select("core", "dst", F.lit(how).alias("how"))


def contained(cores: DataFrame, names: DataFrame) -> DataFrame:
    """(core, dst, ord): names of at least five characters that are within a text or hold it.

    The shorter of the two has all its pieces of five characters in the longer one, so they meet at its rarest piece
    alone. Texts of up to four characters meet the first name that holds them.
    """
    names = names.where(F.length("name") >= 5)
    pieces = names.select("name", "dst", "ord", F.explode(grams(F.col("name"), 5)).alias("g"))
    often = pieces.groupBy("g").agg(F.count("*").alias("n"))
    rarest = F.min_by("g", F.struct("n", "g")).alias("g")
    own = pieces.join(often, "g").groupBy("name", "dst", "ord").agg(rarest)
    core_pieces = cores.select("core", F.explode(grams(F.col("core"), 5)).alias("g"))
    inside = core_pieces.join(own, "g").where(F.col("core").contains(F.col("name")))
    known = core_pieces.join(often, "g", "left").groupBy("core").agg(rarest, F.count_if(F.col("n").isNull()).alias("missing")).where("missing = 0")
    around = known.join(pieces, "g").where(F.col("name").contains(F.col("core")))
    short = names.select("dst", "ord", F.explode(F.flatten(F.array(*(grams(F.col("name"), n) for n in range(1, 5))))).alias("core"))
    short = short.groupBy("core").agg(F.min_by("dst", "ord").alias("dst"), F.min("ord").alias("ord")).join(cores, "core")
    return inside.select("core", "dst", "ord").unionByName(around.select("core", "dst", "ord")).unionByName(short.select("core", "dst", "ord"))


def words_of(text: Column, split: str) -> Column:
    return F.array_distinct(F.filter(F.split(text, split), lambda w: F.length(w) > 3))


def shared_words(cores: DataFrame, names: DataFrame) -> DataFrame:
    """(core, dst, ord): names that share two words of four or more letters with a text.

    Two sets that share two words also share one without each set's most frequent word, and meet at it.
    """
    names = names.select("name", "dst", "ord", words_of(F.col("name"), "[^a-z0-9]+").alias("name_words"))
    cores = cores.select("core", words_of(F.col("core"), "[^a-z0-9_.]+").alias("core_words"))
    often = names.select(F.explode("name_words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def rare(df: DataFrame, key: str, words: str) -> DataFrame:
        ordered = df.select(key, F.explode(words).alias("w")).join(often, "w").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("ws"))
        return ordered.select(key, F.explode(F.slice("ws", F.lit(1), F.size("ws") - 1)).alias("x")).select(key, F.col("x.w").alias("w"))

    met = rare(cores, "core", "core_words").join(rare(names, "name", "name_words"), "w").select("core", "name").distinct()
    return met.join(cores, "core").join(names, "name").where(F.size(F.array_intersect("core_words", "name_words")) >= 2).select("core", "dst", "ord")


def match_prose(cores: DataFrame, names: DataFrame) -> DataFrame:
    """(core, dst, how) of distinct texts and names (name, dst, ord): equal (0), one within the other (1), two shared words (2).

    An equal word of five or more letters, a stage of its own in the specification, is a name within the text already.
    """
    equal = first_match(cores.join(names, F.col("core") == F.col("name")), 0)
    rest = cores.join(equal, "core", "left_anti")
    inside = first_match(contained(rest, names), 1)
    words = first_match(shared_words(rest.join(inside, "core", "left_anti"), names), 2)
    return equal.unionByName(inside).unionByName(words)


def secondary_targets(wb: Workbook, header: str, primary: Sheet, names: DataFrame) -> list[str]:
    """Other registries whose names a column's texts equal, of those that the primary target doesn't have: at least three, and half of the most."""
    first = names.groupBy("name").agg(F.min_by("class", "ord").alias("class"))
    have = names.where(F.col("class") == primary.name).select(F.col("name").alias("core"))
    landed = None
    for s in wb.owners():
        if header in wb.header(s.name):
            part = prose_parts(wb, s, header).select("core", F.struct(F.lit(s.ix).alias("sheet"), "row", "nth").alias("at"))
            landed = part if landed is None else landed.unionByName(part)
    landed = landed.join(have, "core", "left_anti").join(first, F.col("core") == F.col("name")).where(F.col("class") != primary.name)
    rows = landed.groupBy("class").agg(F.count("*").alias("n"), F.min("at").alias("at")).orderBy(F.desc("n"), "at").collect()  # a row a sheet
    return [r["class"] for r in rows if r["n"] >= max(3, rows[0]["n"] * 0.5)]


def match_secondary(cores: DataFrame, names: DataFrame, targets: list[str]) -> DataFrame:
    """(core, dst, how = 3): the first target that has a text as a name, or else one of its words of five or more letters."""
    words = F.filter(F.split("core", "[^a-z0-9_.]+"), lambda w: F.length(w) >= 5)
    keys = cores.select("core", F.posexplode(F.concat(F.array("core"), words)).alias("pos", "name"))
    rank = F.create_map(*(x for i, t in enumerate(targets) for x in (F.lit(t), F.lit(i))))
    found = keys.join(names.where(F.col("class").isin(targets)), "name").select("core", "dst", F.struct(rank[F.col("class")].alias("k"), "pos").alias("ord"))
    return first_match(found, 3)


def prose_edges(wb: Workbook, ents: DataFrame) -> DataFrame:
    """Edges with ``how`` from columns that are no links and whose header shares a word with another registry's title.

    Each part of a cell is matched against that registry's names by match_prose, and where nothing matches, against the
    column's secondary targets. Equal texts are matched once. No cell is compared with every name, and what was found is looked
    up among the entities of these registries only.
    """
    out = wb.spark.createDataFrame([], PROSE_EDGE)
    name = F.regexp_replace(F.lower("name"), r"^\s+|\s+$", "")
    names = ents.select("class", name.alias("name"), F.col("node_key").alias("dst"), "ord").where("name <> ''")
    names = names.groupBy("class", "name").agg(F.min_by("dst", "ord").alias("dst"), F.min("ord").alias("ord"))
    ends = ents.select(F.col("node_key").alias("dst"), F.col("class").alias("dst_class"))
    secondary: dict[tuple[str, str], list[str]] = {}
    for s in wb.owners():
        skip = {s.pk, s.evidence, wb.header(s.name)[0], *(x.column for x in s.links)}
        for i, c in enumerate(wb.header(s.name)):
            target = prose_target(wb, c)
            if c in skip or "evidence" in c.lower() or target is None or target.name == s.name or not is_prose(wb, s, c):
                continue
            parts = prose_parts(wb, s, c)
            cores = parts.where(~F.col("core").isin(*NO_PROSE)).select("core").distinct()
            best = match_prose(cores, names.where(F.col("class") == target.name).drop("class"))
            if (c, target.name) not in secondary:
                secondary[c, target.name] = secondary_targets(wb, c, target, names)
            more = secondary[c, target.name]
            if more:
                best = best.unionByName(match_secondary(cores.join(best, "core", "left_anti"), names, more))
            mine = ents.where(F.col("class") == s.name).select("pk", F.col("node_key").alias("src"))
            found = parts.join(best, "core").join(mine.hint("merge"), "pk").where("src <> dst").join(ends.where(F.col("dst_class").isin(target.name, *more)), "dst")
            at = F.struct(F.lit(len(wb.catalog) + s.ix).alias("sheet"), F.col("row").alias("row"), (F.lit(i * 1000) + F.col("nth")).alias("nth"))
            out = out.unionByName(found.select("src", F.lit(S.relation_slug(c)).alias("rel"), "dst", F.lit(s.name).alias("src_class"), "dst_class", "evidence", F.lit(None).cast("string").alias("flow"), F.lit("inferred").alias("source"), at.alias("ord"), "how"))
    return out


FIRST = 20  # values of a column that features look at
# A cell that names a file and line, and the words of a status.
FILE_LINE = r"[\w./]+\.py:\d+|:\d+$"
STATUS = {"✅", "❌", "◐", "✓", "✗", "yes", "no", "Y", "N"}
# Features of sheets, and what reads them.
FEATURES = {
    "Entity-Identity (PK)": ("RESOLVE_KEYS", "primitive"),
    "Cross-Sheet Reference (FK)": ("RESOLVE_KEYS + FIND_SHEETS", "primitive"),
    "Provenance (file:line)": ("FIND_FILES", "primitive"),
    "Descriptive Metadata": ("READ_METADATA", "primitive"),
    "Directed Edge (relationship)": ("GRAPH_NEIGHBORS", "primitive"),
    "Edge Attribute": ("READ_METADATA(edge row)", "primitive (D-010)"),
    "Ordered Sequence (ordinal)": ("READ_METADATA + SORT", "composition"),
    "Cell-Grid Status Matrix": ("READ_METADATA(full row)", "primitive (D-009)"),
    "Hierarchy (parent/child)": ("FIND_HIERARCHY", "primitive"),
    "Occurrence Frequency": ("COUNT_OCCURRENCES", "primitive"),
    "Row/Column Location": ("FIND_ROWS + FIND_COLUMNS", "primitive"),
}


def first_values(wb: Workbook, sheet: str, n: int = FIRST, rows: int = 200) -> dict[str, list]:
    """The first n values of each column that aren't null, in row order.

    They come from the sheet's first rows, in one job; columns that have fewer there are looked up one by one.
    """
    df, head = wb.frame(sheet), wb.header(sheet)
    top = df.orderBy(ORD).select(*(quoted(c) for c in head)).limit(rows).collect()
    out = {c: [r[i] for r in top if r[i] is not None][:n] for i, c in enumerate(head)}
    if len(top) == rows:
        for c in head:
            if len(out[c]) < n:
                out[c] = [r[0] for r in df.where(quoted(c).isNotNull()).orderBy(ORD).select(quoted(c)).limit(n).collect()]
    return out


def leading_cells(wb: Workbook, n: int = FIRST) -> DataFrame:
    """(sheet, col_ix, col, value, nth): the first n cells of each column that aren't null; tasks pass on n a column."""
    nth = F.row_number().over(Window.partitionBy("sheet", "col_ix").orderBy("row"))
    return wb.cells().withColumn("nth", nth).where(F.col("nth") <= n).select("sheet", "col_ix", "col", "value", "nth")


def column_figures(wb: Workbook) -> DataFrame:
    """A row a column: its place, how many of its leading cells look like what, the first of them, identifiers among them, and, of first columns, whether they are unique."""
    spark = wb.spark
    kinds = [(i, s, c, k, isinstance(wb.frame(s).schema[c].dataType, T.StringType), len(wb.header(s))) for i, s in enumerate(wb.frames) for k, c in enumerate(wb.header(s))]
    known = F.broadcast(spark.createDataFrame(kinds, "sheet_ix int, sheet string, col string, col_ix int, is_text boolean, width int"))  # a row a column
    v = F.col("value")
    listed = F.array_sort(F.collect_list(F.struct("nth", "value")))
    figures = leading_cells(wb).groupBy("sheet", "col_ix").agg(
        F.count("*").alias("n"),
        F.count_if(v.rlike(f"^(?:{S.ID_START})")).alias("ids"),
        F.bool_or(v.rlike(FILE_LINE)).alias("places"),
        F.count_if(v.isin(*STATUS)).alias("marks"),
        F.bool_and(F.trim(v).rlike(r"^\d+$")).alias("numbers"),
        F.transform(listed, lambda x: x["value"]).alias("values"),
    )
    firsts = None
    for s in wb.frames:
        part = wb.frame(s).agg(F.lit(s).alias("sheet"), F.lit(0).alias("col_ix"), (F.count(quoted(wb.header(s)[0])) == F.countDistinct(quoted(wb.header(s)[0]))).alias("unique"))
        firsts = part if firsts is None else firsts.unionByName(part)
    return figures.join(known, ["sheet", "col_ix"]).join(firsts, ["sheet", "col_ix"], "left")


def _column_rules() -> list[tuple[str, Column]]:
    """Features of a column, by its figures."""
    half = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    whole = F.transform("values", lambda x: F.trim(x).try_cast("decimal(38,0)"))
    rising = F.forall(F.sequence(F.lit(1), F.size("values")), lambda i: (i == 1) | (F.element_at(whole, i) > F.element_at(whole, F.greatest(i - 1, F.lit(1)))))
    head = F.element_at("values", 1)
    return [
        ("Entity-Identity (PK)", (F.col("col_ix") == 0) & (F.col("ids") == F.col("n")) & F.col("unique")),
        ("Provenance (file:line)", F.col("places") & F.col("is_text")),
        ("Cross-Sheet Reference (FK)", (F.col("col_ix") > 0) & (F.col("col").contains("(FK)") | (F.col("is_text") & (F.col("ids") >= half)))),
        ("Ordered Sequence (ordinal)", F.when((F.col("col_ix") == 0) & F.col("numbers"), rising).otherwise(False)),
        ("Descriptive Metadata", F.col("is_text") & (F.length(head) > 12) & ~head.rlike(f"^(?:{S.ID_START})") & ~head.rlike(FILE_LINE)),
        ("status", F.col("marks") >= half),
    ]


def _sheet_rules() -> list[tuple[str, Column]]:
    """Features of a sheet, by the number of its columns that have features."""
    return [
        ("Directed Edge (relationship)", F.col("links") >= 2),
        ("Edge Attribute", (F.col("links") >= 2) & (F.col("width") > F.col("links") + 1)),
        ("Cell-Grid Status Matrix", F.col("statuses") >= 3),
    ]


def _holding(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, as rows."""
    return F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules))))


def features(wb: Workbook, ents: DataFrame | None = None) -> DataFrame:
    """(feature, detected_in, example): structural features of sheets by the leading cells of their columns.

    A column's figures come from one aggregate, its features from a table of rules over these, a sheet's from rules over its
    columns' features. detected_in are the first three sheets by name, the example is the first in workbook order.
    Entities, if given, tell whose key a link holds, by the first identifiers of the column that another sheet owns.
    """
    figures = written(column_figures(wb), "figures")
    of_columns = figures.select("sheet", "sheet_ix", "col_ix", "width", F.concat_ws(".", "sheet", "col").alias("example"), _holding(_column_rules()).alias("feature"))
    sheets = of_columns.groupBy("sheet", "sheet_ix", "width").agg(F.count_if(F.col("feature") == "Cross-Sheet Reference (FK)").alias("links"), F.count_if(F.col("feature") == "status").alias("statuses"))
    of_sheets = sheets.select("sheet", "sheet_ix", F.lit(0).alias("col_ix"), F.col("sheet").alias("example"), _holding(_sheet_rules()).alias("feature"))
    found = of_columns.drop("width").where("feature <> 'status'").unionByName(of_sheets)
    if ents is not None:
        link = dict(_column_rules())["Cross-Sheet Reference (FK)"]
        named = figures.where(link).select("sheet", "sheet_ix", "col", "col_ix", F.posexplode(F.filter(F.slice("values", 1, 5), lambda x: x.rlike(f"^(?:{S.ID_START})"))).alias("nth", "pk"))
        owned = named.join(ents.select("pk", "class"), "pk").where(F.col("class") != F.col("sheet"))
        owned = owned.groupBy("sheet", "sheet_ix", "col", "col_ix").agg(F.min_by("class", F.struct("nth", "class")).alias("class"))
        found = found.unionByName(owned.select("sheet", "sheet_ix", "col_ix", F.concat("sheet", F.lit("."), "col", F.lit("→"), "class").alias("example"), F.lit("Hierarchy (parent/child)").alias("feature")))
    rows = found.groupBy("feature").agg(F.slice(F.array_sort(F.collect_set("sheet")), 1, 3).alias("detected_in"), F.min_by("example", F.struct("sheet_ix", "col_ix")).alias("example"))
    always = wb.spark.createDataFrame([(f, ["ALL"], "cells") for f in ("Occurrence Frequency", "Row/Column Location")], rows.schema)
    return rows.unionByName(always)


def closure(found: DataFrame) -> DataFrame:
    """(feature, reads, kind, covered): what reads each feature; the set is closed if all are covered."""
    known = found.sparkSession.createDataFrame([(f, *x) for f, x in FEATURES.items()], "feature string, reads string, kind string")
    return found.select("feature").join(F.broadcast(known), "feature", "left").withColumn("covered", F.col("reads").isNotNull())
