import duckdb
import pytest

from inkwell.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_signature_trees", "op6_suffix_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    df = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in rel.fetchall())
    assert sorted(tuple(r[c] for c in sorted(names)) for r in df.collect()) == want
