import os

import duckdb
import pytest

import __spark_entry__ as entry
from careflow.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(df.where(df.notna(), None).astype(str).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalog.ORACLE:
        assert rows(got) == rows(duck.execute(catalog.ORACLE[name]).fetchdf())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_entry_has_both_decisions(spark):
    assert {r["decision"] for r in entry.entry(spark).collect()} == {"allow", "human_review"}
