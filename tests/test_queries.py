"""Every registered measure against its SQL on the smallest tables, if they are there."""

import glob
import math
import os

import pytest

from plumbline.plans.catalog import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    """Rows with numbers to nine digits, so that the order of additions doesn't count."""
    kept = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted((tuple(map(kept, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = sql.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain([[r[k] for k in order] for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() >= 0
