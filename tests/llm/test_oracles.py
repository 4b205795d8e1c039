"""The queries that SQL can express, against their SQL on the small tables; all queries run under the driver's entry."""

import duckdb
import pytest

import __spark_entry__ as entry
from loomgraph.llm import queries

SMALL = "/root/testdata/sf0.001"


def rows(values):
    return sorted(tuple(str(v) for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows(df.select(*columns).collect()) == rows(con.sql(f"SELECT {quoted} FROM ({queries.ORACLES[name]})").fetchall())


def test_registered():
    names = entry.queries()
    assert {*queries.QUERIES, "pipeline"} <= set(names)
    assert [n for n in names if n.startswith("op") and n[2].isdigit()] == list(queries.QUERIES)
