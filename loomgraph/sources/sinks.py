"""Artifacts: each table as JSON lines in a fixed order, a summary, and a ZIP whose bytes are the same for the same input."""

from __future__ import annotations

import json
import shutil
import zipfile
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, order: list[str]) -> None:
    """A table as JSON files, sorted by the given columns; written by the executors."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def export_zip(tables: Mapping[str, DataFrame], path: str, extra: Mapping[str, object] | None = None) -> dict[str, int]:
    """Tables as JSON files in a ZIP on the driver; returns rows by table.

    Rows are made JSON and sorted by Spark and stream through the driver into the archive, so that it holds one partition at a time.
    """
    counts = {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(tables):
            df = tables[name]
            line = F.to_json(F.struct(*(f"`{c}`" for c in sorted(df.columns))), {"ignoreNullFields": "false"}).alias("line")
            counts[name] = 0
            with z.open(zipfile.ZipInfo(f"{name}.json", (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as out:
                for r in df.select(line).orderBy("line").toLocalIterator():
                    out.write((b",\n" if counts[name] else b"[") + r["line"].encode())
                    counts[name] += 1
                out.write(b"]\n" if counts[name] else b"[]\n")
        summary = {"tables": counts} | dict(extra or {})
        z.writestr(zipfile.ZipInfo("summary.json", (1980, 1, 1, 0, 0, 0)), json.dumps(summary, sort_keys=True, default=str) + "\n")
    return counts


def extracted(path: str, folder: str, suffixes: tuple[str, ...] = (".xlsx", ".xlsm", ".csv", ".tsv")) -> list[str]:
    """The workbooks of a ZIP archive, written to a folder under their base names; others, and names that repeat, are left."""
    out: list[str] = []
    with zipfile.ZipFile(path) as z:
        for info in z.infolist():
            at = Path(folder) / Path(info.filename).name
            if info.is_dir() or at.suffix.lower() not in suffixes or str(at) in out:
                continue
            with z.open(info) as source, at.open("wb") as target:
                shutil.copyfileobj(source, target)
            out.append(str(at))
    return out


def locate(name: str, folders: list[str]) -> Path | None:
    """The first of the folders that holds the file."""
    return next((p for f in folders if (p := Path(f) / name).is_file()), None)
