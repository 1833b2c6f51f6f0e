"""Every registered query of the engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

from gridloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return ",".join(map(plain, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, SF)
    cols = sorted(out.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in out.collect())
    assert rows
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        assert rows == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
