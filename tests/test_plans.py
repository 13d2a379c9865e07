"""Physical plans: no cross join, no global window, Python only where needed."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sheetspark.operators import joins, profile, tables
from sheetspark.plans import QUERIES

# Queries whose operator runs Python by nature.
PYTHON = {
    "step_pandas",
    "step_pandas_groups",
    "step_pandas_aggregate",
    "workbook_sheets",
    "workbook_rows",
    "workbook_one_sheet",
    "mask_payloads",
    "build_log",
    "match_templates",
    "fitting_templates",
    "apply_template",
    "correlation",
    "correlation_wide",
    "eda_report",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(name, spark, data_dir):
    plan = plan_of(contract.queries()[name](spark, data_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for window in re.finditer(r"Window \[(.*)\n", plan):
        below = plan[window.end() :].split("\n")[:3]
        assert not any("SinglePartition" in line for line in below), below
    if name not in PYTHON:
        assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroupsInPandas", plan)


def test_top_values_prune_before_the_shuffle(spark, data_dir):
    orders = spark.read.parquet(f"{data_dir}/orders.parquet")
    plan = plan_of(profile.top_values(orders, ["o_custkey"], "o_orderkey"))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_many_top_values_agree(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 1201).cast("string").alias("v"), (F.col("id") % 3).alias("w"))
    few = {tuple(r) for r in profile.top_values(df, ["v", "w"], "id", 900).collect()}
    monkeypatch.setattr(profile, "PRUNED_RANK", 10)
    assert {tuple(r) for r in profile.top_values(df, ["v", "w"], "id", 900).collect()} == few


def test_filters_and_columns_reach_the_scan(spark, data_dir):
    query = contract.queries()["time_range"](spark, data_dir)
    plan = plan_of(query)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_large_sides_are_not_broadcast(spark, data_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "1")
    try:
        orders = spark.read.parquet(f"{data_dir}/orders.parquet")
        customers = spark.read.parquet(f"{data_dir}/customer.parquet")
        mapped = joins.map_columns(orders, customers, {"o_custkey": "c_custkey"})
        merged = joins.merge_sheets(orders, customers.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])
        upserted = tables.upsert(customers, customers, ["c_custkey"])
        for df in (mapped, merged, upserted):
            assert "Broadcast" not in plan_of(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("kind", ["merge", "map"])
def test_joins_split_hot_keys(spark, kind):
    """A key with half of the rows is split by the adaptive plan."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        key = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id"))
        left = spark.range(0, 60_000, numPartitions=8).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
        right = spark.range(0, 60_000, 3).select(F.col("id").alias("k"), F.col("id").alias("y"))
        joined = joins.merge_sheets(left, right, ["k"]) if kind == "merge" else joins.map_columns(left, right, {"k": "k"}, fill=None)
        found = joined.collect()
        plan = plan_of(joined).split("== Initial Plan ==")[0]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    matched = [r for r in found if r["x"] is not None and r["y"] is not None]
    assert len(matched) == 30_000 + 10_000
    assert len(found) == 60_000 + (9_999 if kind == "merge" else 0)
    assert "skew=true" in plan
