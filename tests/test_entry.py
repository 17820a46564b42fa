import os

import duckdb
import pytest

import __spark_entry__ as entry
from veritext.jobs import queries as jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(jobs.oracle_sql()))
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(jobs.oracle_sql()[name]).fetchall()
    names = [d[0] for d in c.description]
    got = jobs.queries()[name](spark, SF)
    order = sorted(names)
    assert sorted(got.columns) == order

    def cell(v):
        return "null" if v is None else repr(float(v)) if isinstance(v, float) else str(v)

    left = sorted(tuple(cell(r[n]) for n in order) for r in got.collect())
    at = [names.index(n) for n in order]
    right = sorted(tuple(cell(r[k]) for k in at) for r in want)
    assert left == right
