"""Joins, unions, reshaping, keyed tables, filters, steps on small frames."""

from datetime import datetime

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetspark.operators import chart, clean, filters, joins, reshape, steps, tables, types, unions

RELAXED = dict(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_pivot_of_null_and_the_text_null(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "null", 2), ("a", "x", 4), ("b", None, 8)], "r string, c string, v int")
    table = reshape.pivot(df, ["r"], "c", {"v": "sum"})
    assert sorted(table.columns) == ["null", "r", "x"] and rows(table, "r", "`null`", "x") == [("a", 2, 4)]


def test_whole_numbers_beyond_a_long_stay_exact(spark):
    df = spark.createDataFrame([("9007199254740993", "1.5", "1"), ("123456789012345678901234567890", "9", None), (" -7 ", None, "2")], "a string, b string, c string")
    typed = types.infer_types(df)
    assert [f.dataType.simpleString() for f in typed.schema.fields] == ["decimal(38,0)", "double", "bigint"]
    assert [int(r.a) for r in typed.collect()] == [9007199254740993, 123456789012345678901234567890, -7]


@pytest.mark.parametrize("kind", ["unique", "ties", "nulls"])
def test_deep_pages_are_bracketed(spark, monkeypatch, kind):
    monkeypatch.setattr(tables, "SHALLOW_ROWS", 400)
    monkeypatch.setattr(tables, "SAMPLE_ROWS", 500)
    first = {"unique": "cast(id * 7919 % 20011 as double) / 8", "ties": "'t' || string(id % 30)", "nulls": "if(id % 9 > 0, timestamp_ntz '2024-01-01' + make_dt_interval(id % 40), null)"}[kind]
    df = spark.range(0, 12_000, 1, 5).selectExpr(f"{first} AS a", "id * 7 % 101 AS b", "id")
    for number, size in ((100, 50), (239, 50), (240, 50), (30, 400), (13, 399)):
        keys = ["a", "b", "id"]
        held = tables._bracket(df, keys, (number - 1) * size, size, 12_000)
        # Pages near the size of a top-n leave no room for a bracket.
        assert (held is None) == (size > 300) and (held is None or held[0].count() <= 400)
        got = tables.page(df, keys, number, size)
        expected = df.orderBy(*keys).offset((number - 1) * size).limit(size)
        assert [tuple(r) for r in got.select(*keys).orderBy(*keys).collect()] == [tuple(r) for r in expected.orderBy(*keys).collect()]
    # More equal keys than a top-n holds: the index decides.
    assert tables._bracket(df.withColumn("same", F.lit(1)), ["same"], 6_000, 50, 12_000) is None
    assert tables.page(df.withColumn("same", F.lit(1)), ["same"], 120, 50).count() == 50


KEY = st.one_of(st.none(), st.sampled_from(["a", "b", ""]))


@settings(**RELAXED)
@given(
    st.lists(st.tuples(KEY, st.integers(0, 2)), max_size=7),
    st.lists(st.tuples(KEY, st.integers(0, 2)), max_size=7),
)
def test_merge_matches_pandas(spark, left, right):
    l = spark.createDataFrame(left, "` k` string, x int")
    r = spark.createDataFrame(right, "k string, y int")
    pl = pd.DataFrame(left, columns=["k", "x"]).astype({"x": "Int64"})
    pr = pd.DataFrame(right, columns=["k", "y"]).astype({"y": "Int64"})
    for frame in (pl, pr):
        frame["k"] = frame["k"].fillna("").astype(str)
    expected = pl.merge(pr, how="outer", on=["k"]).drop_duplicates()
    wanted = sorted(
        ((k, None if pd.isna(x) else int(x), None if pd.isna(y) else int(y)) for k, x, y in expected.itertuples(index=False)), key=repr
    )
    assert rows(joins.merge_sheets(l, r, ["k "])) == wanted


def test_merge_drops_right_columns_the_left_has(spark):
    left = spark.createDataFrame([(1, "l")], "k int, v string")
    right = spark.createDataFrame([(1, "r", 5), (2, "r", 6)], "k int, v string, w int")
    assert rows(joins.merge_sheets(left, right, ["k"])) == [("1", "l", 5), ("2", None, 6)]
    with pytest.raises(ValueError):
        joins.merge_sheets(left, right, ["nope"])


def test_map_columns_rules(spark):
    df = spark.createDataFrame([(1, "p"), (None, "q"), (9, "r")], "k int, name string")
    mapping = spark.createDataFrame(
        [(1, "one", 1.5), (1, "uno", None), (None, "nil", 2.0)], "key int, name string, w double"
    )
    mapped = joins.map_columns(df, mapping, {"k": "key", "absent": "key"})
    assert mapped.columns == ["k", "name", "name_map", "w"]
    assert rows(mapped) == [(1, "p", "one", "1.5"), (1, "p", "uno", "NA"), (9, "r", "NA", "NA"), (None, "q", "nil", "2.0")]
    with pytest.raises(ValueError):
        joins.map_columns(df, mapping, {"k": "key"}, require_unique=True)
    assert joins.mapped_columns(mapping.toDF("key", "name", "Unnamed: 2"), "key") == ["name"]
    # A lookup by the looked-up column, and keys of different types.
    texts = spark.createDataFrame([("1", "eins")], "key string, german string")
    assert rows(joins.map_columns(df, texts, {"k": "key"}, fill=None), "german") == [("eins",), (None,), (None,)]


CELLS = st.one_of(st.none(), st.integers(-5, 5))


@settings(**RELAXED)
@given(st.lists(st.tuples(st.integers(0, 3), CELLS, CELLS), min_size=1, max_size=6))
def test_melt_matches_pandas(spark, data):
    df = spark.createDataFrame(data, "i int, a int, b int")
    frame = pd.DataFrame(data, columns=["i", "a", "b"]).astype("Int64")
    expected = frame.melt(id_vars=["i"], var_name="Variable", value_name="Value")
    wanted = sorted(((int(i), v, None if pd.isna(x) else int(x)) for i, v, x in expected.itertuples(index=False)), key=repr)
    assert rows(reshape.melt(df, ["i"])) == wanted


def test_melt_types(spark):
    df = spark.createDataFrame([(1, 2, 2.5, "x", None)], "i int, a int, d double, s string, n string")
    assert rows(reshape.melt(df, ["i"], ["a", "d"])) == [(1, "a", 2.0), (1, "d", 2.5)]
    assert rows(reshape.melt(df, ["i"], ["a", "s"], "k", "v")) == [(1, "a", "2"), (1, "s", "x")]
    assert rows(reshape.melt(df, ["i"], ["s", "n"], fill="NA")) == [("1", "n", "NA"), ("1", "s", "x")]
    odd = df.toDF("id col", "a.b", "c-d", "e`f", "g/h")
    assert reshape.melt(odd, ["id col"]).count() == 4
    with pytest.raises(ValueError):
        reshape.melt(df, ["i"], ["zz"])


def test_chart_groups_do_not_collide(spark):
    df = spark.createDataFrame([("a | b", "c", "1"), ("a", "b | c", "2"), (None, "c", "x"), (None, "c", None)], "p string, q string, v string")
    assert rows(chart.chart_aggregate(df, ["p", "q"], ["v"])) == [("", "c", 0.0), ("a | b", "c", 1.0), ("a", "b | c", 2.0)]
    assert rows(chart.chart_aggregate(df.where("q = 'c'"), ["q"], ["v"], "avg")) == [("c", pytest.approx(1 / 3))]
    assert chart.chart_aggregate(df.limit(0), ["p"], ["v"]).count() == 0
    with pytest.raises(ValueError):
        chart.chart_aggregate(df, [], ["v"])


def test_stacked100_edge_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("b", 0.0, 0.0), ("c", -2.0, 1.0), (None, None, 4.0)], "x string, u double, v double")
    found = rows(reshape.stacked100(df, ["x", "gone"], ["u", "v"]))
    assert found == [("", "", 0.0, 100.0), ("a", "", 25.0, 75.0), ("b", "", 0.0, 0.0), ("c", "", 0.0, 0.0)]


def test_concat_keeps_first_appearance_order_and_types(spark):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([("z", 2.5)], "id string, extra double")
    plain = unions.concat_sheets({"a.csv": a, "b.csv": b}, fill=None)
    assert plain.columns == ["id", "s", "source_sheet", "extra"]
    assert rows(plain) == [("1", "x", "a.csv", None), ("z", None, "b.csv", 2.5)]
    assert unions.concat_name(["a.csv", "b.c.csv", "d"]) == "a+b.c+d.csv"
    with pytest.raises(ValueError):
        unions.concat_project({("f", "s"): None})


def test_export_and_fill(spark):
    df = spark.createDataFrame(
        [(None, float("inf"), True, datetime(2024, 1, 2, 3, 4, 5, 678000), ["a"], "Period_2024"), (1, 2.0, None, None, None, "x")],
        "i int, d double, b boolean, t timestamp_ntz, l array<string>, s string",
    )
    assert rows(clean.export_text(df)) == [
        ("", "Infinity", "True", "2024-01-02T03:04:05.678000", '["a"]', "2024"),
        ("1", "2.0", "", "", "", "x"),
    ]
    assert rows(clean.fill_missing(df), "i", "d", "b", "t") == [
        ("1", "2.0", "NA", "NA"),
        ("NA", "NA", "True", "2024-01-02 03:04:05.678000"),
    ]


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a/b` int, `a\\b` int")
    with pytest.raises(ValueError):
        clean.sanitize_names(df)
    assert clean.trim_names(spark.createDataFrame([(1,)], "` x ` int")).columns == ["x"]


def test_coerce_numeric_only_whole_columns(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "x", None, "1d", "007"), ("-2", "3", "4", None, "2", "12345678901234567890")],
        "a string, b string, c string, d string, e string, f string",
    )
    found = {f.name: f.dataType.simpleString() for f in types.coerce_numeric(df).schema.fields}
    assert found == {"a": "bigint", "b": "double", "c": "string", "d": "string", "e": "string", "f": "double"}


def test_sniff_types(spark):
    df = spark.createDataFrame(
        [(0, "", "#N/A", "12", "1.2.3", "-5", None), (1, "7.5", "#REF!", "x", "1", "6", None)],
        "o int, a string, b string, c string, d string, e string, f string",
    )
    found = {r["column"]: r["column_type"] for r in types.sniff_types(df.repartition(2), "o").collect()}
    assert found == {"a": "float", "b": "Unknown", "c": "int", "d": "str", "e": "str", "f": "Unknown"}


def test_filters(spark):
    df = spark.createDataFrame(
        [(1, "Alpha", ["x", "y"], datetime(2024, 1, 5, 23, 59)), (2, None, ["x"], datetime(2024, 1, 6))],
        "id int, n string, tags array<string>, t timestamp_ntz",
    )
    assert rows(filters.exclude_any(df, "n", ["ALP"]), "id") == [(2,)]
    assert rows(filters.exclude_any(df, "n", []), "id") == [(1,), (2,)]
    assert rows(filters.filter_time(df, "t", "2024-01-05", "2024-01-05"), "id") == [(1,)]
    assert rows(filters.filter_time(df, "t", "bad", None), "id") == [(1,), (2,)]
    assert rows(filters.has_all_tags(df, "tags", ["x", "y"]), "id") == [(1,)]
    assert rows(filters.in_list(df, "id", list(range(2, 3000))), "id") == [(2,)]
    assert rows(filters.active_only(df.withColumn("is_active", F.col("id") == 1)), "id") == [(1,)]
    with pytest.raises(ValueError):
        filters.scope_filter(df, "sheet", {"project_id": 1})


def test_upsert_flags(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "B", 1), (3, "C", 1), (3, "old", 0)], "k int, v string, at int")
    found = rows(tables.upsert(table, batch, ["k"], order_by=["at"]))
    assert found == [(1, "a", None), (2, "B", False), (3, "C", True)]


def test_steps(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    with pytest.raises(TypeError):
        steps.run_step(df, lambda d: 5)
    with pytest.raises(ValueError):
        steps.check_result_size(df, 2)
    assert steps.check_result_size(df, 3).count() == 3
    totals = steps.run_pandas_step(
        df, lambda g: pd.DataFrame({"g": [g["g"].iloc[0]], "v": [g["v"].sum()]}), "g string, v double", by=["g"]
    )
    assert rows(totals) == [("a", 4.0), ("b", 5.0)]
    replayed = steps.recipe(df, [("sql", {"sql": "SELECT * FROM {df} WHERE v > 1"}), ("group_mean", {"by": "g", "value": "v"})])
    assert rows(replayed) == [("a", 3.0), ("b", 5.0)]
    with pytest.raises(ValueError):
        steps.recipe(df, [("nope", {})])


def test_a_hot_group_passes_in_batches(spark):
    """One group with a third of all rows never is one frame."""
    df = spark.range(0, 60_000, 1, 4).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("g"), F.col("id").alias("v"))

    def longest(key, batches):
        sizes, total = [], 0
        for batch in batches:
            sizes.append(len(batch))
            total += int(batch["v"].sum())
        yield pd.DataFrame({"g": [key[0]], "rows": [sum(sizes)], "most": [max(sizes)], "total": [total]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        found = {r.g: r for r in steps.run_pandas_step(df, longest, "g long, rows long, most long, total long", by=["g"]).collect()}
        expected = {r.g: (r.n, r.s) for r in df.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
        whole = steps.run_pandas_step(
            df, lambda g: pd.DataFrame({"g": [g["g"].iloc[0]], "most": [len(g)]}), "g long, most long", by=["g"]
        )
        assert {r.g: r.most for r in whole.collect()}[0] == 20_000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {g: (r.rows, r.total) for g, r in found.items()} == expected
    assert expected[0][0] == 20_000 and max(r.most for r in found.values()) <= 1000


def test_partial_results_are_merged_before_the_shuffle(spark, monkeypatch):
    df = spark.range(0, 30_000, 1, 3).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 700).alias("g"), F.col("id").alias("v"))

    def partial(rows):
        return rows.groupby("g", dropna=False).agg(n=("v", "count"), s=("v", "sum")).reset_index()

    def merge(states):
        return states.groupby("g", dropna=False).agg(n=("n", "sum"), s=("s", "sum")).reset_index()

    expected = {tuple(r) for r in df.groupBy("g").agg(F.count("*"), F.sum("v")).collect()}
    for most in (50, 100_000):
        monkeypatch.setattr(steps, "MERGED_ROWS", most)
        got = steps.run_pandas_aggregate(df, partial, merge, "g double, n long, s long", ["g"])
        assert {tuple(r) for r in got.collect()} == expected
    assert steps.run_pandas_aggregate(df.limit(0), partial, merge, "g double, n long, s long", ["g"]).count() == 0
