"""Every registered query of the engine against the SQL that states it, on the smallest tables."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from tessera.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    def cell(v):
        return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 8) if isinstance(v, float) else str(v)

    return sorted((tuple(map(cell, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(map(tuple, df.select(*[f"`{c}`" for c in columns]).collect()))
    oracle = duck.sql(ORACLES[name])
    assert sorted(oracle.columns) == columns
    assert got == plain(oracle.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
