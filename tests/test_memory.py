"""What the plans of queries keep in a task."""

import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import dimension as D

registry.load()


def plan(spark, name):
    frame = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    return frame._jdf.queryExecution().executedPlan().toString()


def test_options_in_use_are_made_distinct_before_the_join(spark):
    text = plan(spark, "u_silent_options")
    assert "keys=[o_orderstatus" in text  # aggregated on the side of the orders, not only after the join


@pytest.mark.parametrize("name", ["f_waypoint_share", "a_label_distribution"])
def test_no_set_of_labels_is_kept(spark, name):
    text = plan(spark, name)
    assert "distinct" not in text and "Expand" not in text
    rows = spark.createDataFrame([(1, None), (2, "a"), (2, "a"), (2, None), (3, "a"), (3, "b")], "k int, v string")
    got = rows.groupBy("k").agg(D.choices(F.min("v"), F.max("v")).alias("n"), F.countDistinct("v").alias("all")).collect()
    assert {r.k: (r.n, r["all"]) for r in got} == {1: (0, 0), 2: (1, 1), 3: (2, 2)}


def test_orders_are_counted_without_repeating_rows(spark):
    text = plan(spark, "a_adjudication")
    assert "Expand" not in text and "distinct" not in text


def test_tasks_grow_in_number_with_the_input(spark):
    from tidemark.functions.shared import parted

    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_tax")
    few, many = (parted(rows, "l_orderkey", size=size) for size in (1 << 30, 1000))
    assert few.rdd.getNumPartitions() == 4 < many.rdd.getNumPartitions() and many.exceptAll(rows).count() == 0
