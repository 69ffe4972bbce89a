import os

import duckdb
import pytest

from careflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    want = c.execute(queries.ORACLE[name])
    names = sorted(d[0] for d in want.description)
    order = [names.index(d[0]) for d in want.description]
    want = sorted(tuple(x for _, x in sorted(zip(order, r))) for r in want.fetchall())
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names and sorted(tuple(r[n] for n in names) for r in got.collect()) == want
