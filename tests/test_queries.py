"""Every registered query of the engine against its SQL twin on the small tables."""

import duckdb
import pytest

from loomgraph.plans import queries

SMALL = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


# The driver's tables have no such flaws; the registry workbook has: reg_check_fk and others.
EMPTY = {"resolve_pk", "reverse_lookup", "explain_relation", "intersect_two", "check_fk", "find_dead", "duplicate_pk", "duplicate_names"}


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{float(v):.6f}" if isinstance(v, float) else str(v)


def rows(values):
    return sorted(tuple(plain(v) for v in r) for r in values)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = rows(df.select(*(f"`{c}`" for c in columns)).collect())
    if name not in queries.ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert got or name in EMPTY
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(con.sql(queries.ORACLES[name]).columns) == columns
    assert got == rows(con.sql(f"SELECT {quoted} FROM ({queries.ORACLES[name]})").fetchall())


def test_fk_overlap_of_all_sheets(spark):
    values = {}
    for r in queries.engine(spark, SMALL).wb.cells().collect():
        values.setdefault((r["sheet"], r["col"]), set()).add(r["value"])
    want = {}
    for (s, c), mine in values.items():
        for sheet in queries.CATALOG:
            share = len(mine & values[sheet.name, sheet.pk]) / len(mine)
            own = next(x for x in queries.CATALOG if x.name == s).pk
            if s != sheet.name and c != own and (share >= 0.5 or (sheet.name[:8] in c and share >= 0.3)):
                want[s, c, sheet.name] = share
    got = {(r["sheet"], r["col"], r["target"]): r["overlap"] for r in queries.QUERIES["fk_overlap"](spark, SMALL).collect()}
    assert got == pytest.approx(want, abs=1e-4) and ("orders", "o_custkey", "customer") in got


def test_profile_and_promotion_of_all_sheets(spark):
    wb, values = queries.engine(spark, SMALL).wb, {}
    for r in wb.cells().collect():
        values.setdefault((r["sheet"], r["col"]), []).append(r["value"])
    rows = {s.name: wb.frame(s.name).count() for s in queries.CATALOG}
    want = {k: (rows[k[0]], len(set(v))) for k, v in values.items()}
    assert {(r["sheet"], r["col"]): (r["n"], r["d"]) for r in queries.QUERIES["column_profile"](spark, SMALL).collect()} == want
    promoted = queries.QUERIES["promotion_candidates"](spark, SMALL).collect()
    assert {"customer", "orders"} <= {r["registry"] for r in promoted}
    assert all(r["members"] == values[r["registry"], r["col"]].count(r["value"]) for r in promoted)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 1
