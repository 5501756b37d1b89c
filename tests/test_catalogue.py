"""Every query of the catalogue against its SQL oracle in DuckDB."""

import math

import duckdb
import pytest

from cairnflow.plans import catalogue, oracles

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_oracle(spark, duck, name):
    got = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = plain(got.select(*columns).collect())
    if name not in oracles.oracle_sql():
        assert rows
        return
    want = duck.sql(oracles.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert rows == plain(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(oracles.oracle_sql()) <= set(__spark_entry__.queries())
