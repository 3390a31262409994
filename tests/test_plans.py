"""Scale guards read from the physical plans."""

import re

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from babelgrid.plans import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def assert_spreads(df, name):
    """No product of two tables by shuffle, no window over one partition."""
    lines = [re.sub(r"^[^A-Za-z]*(\(\d+\) )?", "", x) for x in plan_of(df).splitlines()]
    assert not any(x.startswith("CartesianProduct") for x in lines), name
    for i, x in enumerate(lines):
        if x.startswith("Window ["):
            below = next((y for y in lines[i + 1:] if not y.startswith(("Sort", "WindowGroupLimit", "Project"))), "")
            assert not below.startswith("Exchange SinglePartition"), name


def test_no_cartesian_products(spark, small_dir):
    for name in ("transfer_grid_nb", "qa_squad_grid", "ner_macro_grid", "best_span", "sample_exact_n"):
        assert "CartesianProduct" not in plan_of(QUERIES[name](spark, small_dir)), name


def test_top_n_per_group_is_limited_before_the_shuffle(spark, small_dir):
    p = plan_of(QUERIES["first_n_cap"](spark, small_dir))
    assert "WindowGroupLimit" in p


def test_scan_prunes_columns(spark, small_dir):
    df = QUERIES["drop_columns"](spark, small_dir)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p


def test_guard_sees_a_window_over_one_partition(spark):
    df = spark.range(10).withColumn("r", F.row_number().over(Window.orderBy("id")))
    with pytest.raises(AssertionError):
        assert_spreads(df, "unpartitioned")


def test_offsets_need_no_shuffle(spark, small_dir):
    p = plan_of(QUERIES["qa_offset_mask"](spark, small_dir))
    assert "Exchange hashpartitioning" not in p and "Window" not in p
