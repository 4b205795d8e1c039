"""Contracts of state in Python sources: who may write an attribute, whether anyone reads it, and whether a mirror heals.

Sources are parsed where they are read, a file a row; what is collected are verdicts, one a state.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PASS, FAIL, NOT_APPLICABLE = "PASS", "FAIL", "NOT_APPLICABLE"
SITE = "file string, function string, name string, kind string, line long"


@dataclass(frozen=True)
class State:
    """An attribute of self, the functions that may write it (in the file, if one is given), and whether it is to be read."""

    name: str
    owners: tuple[str, ...]
    file: str | None = None
    read: bool = False


def accesses(source: bytes) -> Iterator[tuple[str, str, str, int]]:
    """(function, name, kind, line) of each self.name that is assigned (write) or loaded (read); nothing of what doesn't parse."""
    try:
        todo = [(ast.parse(source), "<module>")]
    except (SyntaxError, ValueError):
        return
    while todo:
        node, function = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function = node.name
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self":
            yield function, node.attr, "read" if isinstance(node.ctx, ast.Load) else "write", node.lineno
        todo += [(child, function) for child in ast.iter_child_nodes(node)]


def sites(spark: SparkSession, root: str) -> DataFrame:
    """(file, function, name, kind, line) of all Python files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *x) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in accesses(c)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "function", "name", "kind", "line"])

    return files.select("path", "content").mapInArrow(run, SITE)


def audits(found: DataFrame, states: Sequence[State]) -> DataFrame:
    """(name, audit, verdict, n): writers and readers of each state; n is the number of sites, or of those not allowed."""
    spark = found.sparkSession
    rules = spark.createDataFrame([(s.name, list(s.owners), s.file, s.read) for s in states], "name string, owners array<string>, owner_file string, to_read boolean")
    allowed = F.array_contains("owners", F.col("function")) & (F.col("owner_file").isNull() | F.col("file").endswith(F.col("owner_file")))
    is_ = lambda k: F.coalesce(F.col("kind") == k, F.lit(False))
    rows = F.broadcast(rules).join(found, "name", "right").where(F.col("owners").isNotNull())  # a row a state
    counts = rows.groupBy("name").agg(F.count_if(is_("write")).alias("writes"), F.count_if(is_("write") & ~allowed).alias("bad"), F.count_if(is_("read")).alias("reads"), F.countDistinct(F.when(is_("write"), F.col("file"))).alias("files"))
    each = rules.join(counts, "name", "left").na.fill(0)
    write = F.when((F.col("writes") == 0) | (F.col("bad") > 0), FAIL).otherwise(PASS)
    read = F.when(~F.col("to_read"), NOT_APPLICABLE).when(F.col("reads") == 0, FAIL).otherwise(PASS)
    one = F.when(F.col("files") > 1, FAIL).otherwise(PASS)
    items = F.array(*(F.struct(F.lit(a).alias("audit"), v.alias("verdict"), F.col(n).alias("n")) for a, v, n in (("writers", write, "bad"), ("readers", read, "reads"), ("one authority", one, "files"))))
    return each.select("name", F.explode(items).alias("x")).select("name", "x.audit", "x.verdict", "x.n")


def heals(value: Callable[[], object], canonical: Callable[[], object], spoil: Callable[[], None], step: Callable[[], None]) -> str:
    """Whether a mirror that equals its original is equal again, one step after it was spoilt."""
    step()
    if value() != canonical():
        return FAIL
    spoil()
    if value() == canonical():
        return NOT_APPLICABLE  # nothing was spoilt
    step()
    return PASS if value() == canonical() else FAIL


def scan(spark: SparkSession, root: str, states: Sequence[State]) -> dict[str, object]:
    """All static audits with a verdict over all, as a report."""
    rows = [r.asDict() for r in audits(sites(spark, root), states).orderBy("name", "audit").collect()]  # three rows a state
    return {"verdict": FAIL if any(r["verdict"] == FAIL for r in rows) else PASS, "audits": rows, "text": "\n".join(f"{r['verdict']:<15}{r['name']}: {r['audit']} ({r['n']})" for r in rows)}
