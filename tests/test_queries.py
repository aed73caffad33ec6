"""Every registered query against the same in DuckDB's SQL, on the smallest tables."""

import math
import os

import pytest

from panelframe.plans import load, registry

load()
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name not in registry.ORACLE:
        assert got
        return
    found = duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in found.description]
    kinds = {c[0]: str(c[1]) for c in found.description}
    assert sorted(columns) == names
    assert {c: TYPES.get(k, k) for c, k in df.dtypes} == kinds
    assert got == sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall())
