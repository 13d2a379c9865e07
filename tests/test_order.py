"""Row order across task borders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetspark.operators import order, quantiles, tables

PARTITIONS = [1, 3, 7]


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_row_index_is_dense(spark, partitions):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"))
    rows = order.row_index(df, ["k"], partitions=partitions).collect()
    assert sorted((r["k"], r["row_index"]) for r in rows) == [(i, i) for i in range(1000)]
    wide = df.withColumn("payload", F.repeat(F.lit("x"), 50))
    numbered = order.row_index(wide, ["k"], partitions=partitions, unique=True)
    assert numbered.columns == ["k", "payload", "row_index"]
    assert numbered.where("k <> row_index").count() == 0 and numbered.count() == 1000


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_running_values_with_a_hot_key(spark, partitions):
    rng = np.random.default_rng(5)
    # One key holds most rows, so it spans several partitions.
    keys = [None if i % 50 == 0 else "hot" if i % 10 else f"k{i % 7}" for i in range(600)]
    cells = [None if x < 0 else int(x) for x in rng.integers(-3, 9, 600)]
    df = spark.createDataFrame(list(zip(keys, range(600), cells)), "k string, i int, v int")
    ordered = order.range_ordered(df, ["k", "i"], partitions)
    specs = {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "n": ("count", "v"), "l": ("last", "v")}
    for before in (False, True):
        found = {r["i"]: (r["s"], r["lo"], r["hi"], r["n"], r["l"]) for r in order.running(ordered, ["k"], specs, before).collect()}
        history = {}
        for key, i, cell in zip(keys, range(600), cells):
            seen = history.setdefault(key, [])
            if not before:
                seen.append(cell)
            known = [v for v in seen if v is not None]
            expected = (
                sum(known) if known else None,
                min(known) if known else None,
                max(known) if known else None,
                len(known),
                known[-1] if known else None,
            )
            assert found[i] == expected, (before, i)
            if before:
                seen.append(cell)


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_consecutive_diff(spark, partitions):
    cells = [5, None, 7, 10, 10, None, 3]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, v int")
    rows = order.consecutive_diff(df, "v", ["i"], partitions=partitions).orderBy("i").collect()
    assert [r["diff"] for r in rows] == [None, None, None, 3, 0, None, None]


@pytest.mark.parametrize("partitions", PARTITIONS)
@pytest.mark.parametrize("kind", ["normal", "ties", "constant", "nulls"])
def test_quantiles_of_large_columns(spark, partitions, kind):
    rng = np.random.default_rng(11)
    cells = {
        "normal": rng.normal(size=997).tolist(),
        "ties": rng.integers(0, 5, 997).astype(float).tolist(),
        "constant": [4.0] * 997,
        "nulls": [None if i % 3 else float(i) for i in range(997)],
    }[kind]
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate(cells)], "v double, w double").repartition(5)
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = quantiles.exact_quantiles(df, ["v", "w"], probabilities, buffered_values=10, partitions=partitions)
    known = [v for v in cells if v is not None]
    assert found["v"] == pytest.approx(np.quantile(known, probabilities).tolist())
    assert found["w"] == pytest.approx(np.quantile(range(997), probabilities).tolist())
    small = quantiles.exact_quantiles(df, ["v", "w"], probabilities)
    assert small["v"] == pytest.approx(found["v"])


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert quantiles.exact_quantiles(df, ["v"], [0.5], buffered_values=0) == {"v": [None]}
    assert quantiles.exact_quantiles(df, ["v"], [0.5]) == {"v": [None]}


def test_source_order_follows_the_file(spark, tmp_path):
    lines = ["k,v"] + [f"{i},{'x' * 40}" for i in range(20_000)]
    (tmp_path / "sheet.csv").write_text("\n".join(lines) + "\n")
    from sheetspark.sources.sheets import read_sheet

    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = read_sheet(spark, str(tmp_path / "sheet.csv"), ordered=True)
        assert df.rdd.getNumPartitions() > 5
        rows = order.row_index(df, ["__source_order"], partitions=4).select("k", "row_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(int(r["k"]) == r["row_index"] for r in rows)
    assert len(rows) == 20_000


def test_deep_and_past_end_pages(spark):
    df = spark.range(25_000)
    deep = tables.page(df, [F.col("id").desc()], 480, 50)
    assert sorted(r["id"] for r in deep.collect()) == list(range(25_000 - 480 * 50, 25_000 - 479 * 50))
    assert tables.page(df, ["id"], 501, 50).count() == 0
    last = tables.page(df, ["id"], 900, 50, past_end="last").collect()
    assert len(last) == 50 and last[0]["page"] == 500 and not last[0]["has_next"]
