"""Every core query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lectern.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sql, name):
    df = registry.queries()[name](spark, FOLDER)
    rows = df.collect()
    if name not in registry.oracle_sql():
        return
    got = sql.execute(registry.oracle_sql()[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    want = got.fetchall()
    a = sorted([norm(r[c]) for c in sorted(names)] for r in rows)
    b = sorted([norm(r[names.index(c)]) for c in sorted(names)] for r in want)
    assert a == b
