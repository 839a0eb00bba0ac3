import duckdb
import pytest

import __spark_entry__
from cellweave.plans.catalog import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem embeddings".split():
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def values(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple("~" if r[k] is None else repr(r[k]) for k in order) for r in rows])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, D)
    rows = df.collect()
    if name in ORACLES:
        found = sql.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        assert values(df.columns, rows) == values(names, found.fetchall())
    else:
        assert rows


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
