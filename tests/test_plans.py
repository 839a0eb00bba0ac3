"""Properties of physical plans that matter at scale."""

import re

import pytest

from cellweave.operators import stack, stats
from cellweave.plans.catalog import QUERIES, YEARS, holes, product, product_b

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_scans_read_only_what_is_used(spark):
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(product(spark, D))))
    assert {c.split(":")[0] for x in read for c in x.split(",")} == {"l_suppkey", "l_shipdate", "l_quantity"}


def test_year_filters_reach_the_scan(spark, tmp_path):
    product(spark, D).write.partitionBy("year").parquet(str(tmp_path / "s"))
    s = stack.select_years(spark.read.parquet(str(tmp_path / "s")), 1996, 1997)
    assert re.search(r"PartitionFilters: \[.*year.*1996.*1997", plan(s))


def exchanges(df):
    return len(re.findall(r"^\(\d+\) Exchange", plan(df), re.M))


def test_shuffles(spark):
    """One shuffle makes the stack, one more brings cells together; two products are joined as they lie."""
    assert exchanges(stack.matrix(holes(spark, D), YEARS)) == 2
    pairs = stack.pair(product(spark, D), product_b(spark, D))
    assert exchanges(pairs) <= 4 and exchanges(stats.correlation(pairs)) <= 5
    assert exchanges(stats.cell_summary(spark.read.parquet(f"{D}/lineitem.parquet").selectExpr("l_suppkey as cell", "l_quantity as value"))) == 1


@pytest.mark.parametrize("name", ["feature_matrix", "wide_matrix", "mask_values", "mask_nonzero", "pair_products", "day_correlation", "paint_correlation", "cell_summary", "matrix_product", "first_image", "reindex_dense", "normalised_years", "mask_polygon"])
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, D))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|ArrowEval|MapInArrow|BatchEvalPython", text)


@pytest.mark.parametrize("name", ["canonical_correlation", "generalised_correlation", "product_svd_by_svd", "centred_product_modes", "maximum_covariance", "product_svd_modes"])
def test_entries_of_a_product_are_made_in_place(spark, name):
    """The product of n cells by n cells has n * n rows, so nothing may be shuffled, grouped or sorted after the vectors have met."""
    text = plan(QUERIES[name](spark, D))
    assert re.search("NestedLoopJoin", text) and not re.search("Aggregate|SortMergeJoin|ShuffledHashJoin|CartesianProduct", text)
    assert not re.search("hashpartitioning", text) and len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1
