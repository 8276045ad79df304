"""The queries against their SQL on the smallest tables, wherever those are."""

import glob
import os
from pathlib import Path

import pytest

from tessera.plans import core, incremental, records, reference, rules, texts  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).exists():
        pytest.skip("no tables here")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {Path(f).stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_matches_sql(spark, sql, name):
    df = core.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    other = sql.sql(core.SQL[name])
    theirs = sorted((tuple(plain(dict(zip(other.columns, r))[c]) for c in cols) for r in other.fetchall()), key=repr)
    assert cols == sorted(other.columns)
    assert mine == theirs
