"""Every core query with SQL gives the same rows in DuckDB."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from casdelta.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def spark_rows(spark, request):
    """The rows of the chosen queries; small as they are, most of their time is planning, so some are under way at once."""

    def rows(name):
        df = QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        return columns, sorted(repr(tuple(r)) for r in df.select(*columns).collect())

    chosen = [i.callspec.params["name"] for i in request.session.items if i.name.startswith("test_same_rows[")]
    with ThreadPoolExecutor(4) as pool:
        yield {name: pool.submit(rows, name) for name in chosen}
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark_rows, duck, name):
    columns, got = spark_rows[name].result()
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(repr(tuple(r)) for r in duck.sql(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall())
    assert got == want


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
