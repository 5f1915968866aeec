"""Every query with SQL gives the rows that DuckDB gives, and some."""

import duckdb
import pytest

from inkwell.plans import review_queries  # noqa: F401
from inkwell.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"passage_containment"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents pages conversations labels benchmark".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert got or name in MAY_BE_EMPTY
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    if name in ORACLES:
        rel = duck.execute(ORACLES[name])
        names = [d[0] for d in rel.description]
        cols = sorted(df.columns)
        assert sorted(names) == cols
        want = sorted(tuple(repr(dict(zip(names, r, strict=True))[c]) for c in cols) for r in rel.fetchall())
        assert sorted(tuple(repr(r[c]) for c in cols) for r in got) == want
