"""The driver contract: every record query gives the rows of its SQL."""

import os

import duckdb
import pytest

from marlstone.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def shown(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted(str([float(f"{v:.9g}") if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in (r[k] for k in at)]) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    names = sorted(df.columns)
    assert names == sorted(columns)
    assert shown([tuple(r) for r in df.collect()], df.columns, names) == shown(found.fetchall(), columns, names)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
