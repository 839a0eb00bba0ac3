"""The registered queries over whole small tables, against SQL where there is some and brute force elsewhere."""

import duckdb
import pytest

import __spark_entry__
from cellweave.llm.queries import ORACLES, QUERIES

from .helpers import brute_near, brute_repeats

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    got = QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(map(str, found.fetchall()))


def test_names():
    assert [n.split("_")[0] for n in QUERIES][:10] == [f"op{k}" for k in range(1, 11)] and not any(n.startswith("op") for n in list(QUERIES)[10:])
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_near_and_repeats(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_links, r.class_id) for r in QUERIES["op2_ngram_jaccard_join"](spark, D).collect()}
    assert got == brute_near(rows)
    cut = brute_repeats(rows)
    assert {r.doc_id: (r.n_words, r.n_removed) for r in QUERIES["op4_substring_dedup"](spark, D).collect()} == {i: v[:2] for i, v in cut.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_clashing_columns_and_whole_tables(spark, name, tmp_path):
    """Extra columns, among them names that results use, change nothing."""
    from pyspark.sql import functions as F

    for t in ("documents", "pages", "labels", "benchmark"):
        df = spark.read.parquet(f"{D}/{t}.parquet").limit(60)
        key = df.columns[0]
        more = ["score", "sha", "bands", "n", "k1", "row", "rule", "page", "class_id", "removed", "__key", "anchors", "length"]
        df.select(*[F.lit(1).alias(c) for c in more], *df.columns).write.parquet(f"{tmp_path}/wide/{t}.parquet")
        df.select(*df.columns).write.parquet(f"{tmp_path}/plain/{t}.parquet")
        assert key
    a, b = (QUERIES[name](spark, f"{tmp_path}/{k}") for k in ("wide", "plain"))
    assert a.columns == b.columns
    drop = [c for c in a.columns if c in ("sequence_id", "offset", "score")]
    assert sorted(map(str, a.drop(*drop).collect())) == sorted(map(str, b.drop(*drop).collect()))
