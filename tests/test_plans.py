"""What the plans must look like at any size."""

import pytest

import __spark_entry__
from lipika.plans import queries

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_product_joins(spark, name):
    """No query pairs everything with everything."""
    text = plan(queries.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_pruning_and_pushdown(spark):
    queries = __spark_entry__.queries()  # the driver's view of them
    text = plan(queries["agg_facets"](spark, DATA))
    assert "ReadSchema: struct<tradition:string,language:string>" in text
    text = plan(queries["top_lookup"](spark, DATA))
    assert "PushedFilters: [IsNotNull(id), EqualTo(id," in text and "TakeOrderedAndProject" in text
    text = plan(queries["top_vectors"](spark, DATA))
    assert "EqualTo(model_name,mini-multi-64)" in text and "TakeOrderedAndProject" in text
    text = plan(queries["win_diversified"](spark, DATA))
    assert "WindowGroupLimit" in text
