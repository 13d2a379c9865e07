"""Profiles against array and frame libraries and hand-made cases."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetspark.operators import correlation, dates, profile

RNG = np.random.default_rng(3)
HISTOGRAM_CASES = {
    "constant": [3.0] * 20,
    "one": [7.0],
    "outlier": [*RNG.normal(size=200), 1e6],
    "normal": RNG.normal(size=500).tolist(),
    "uniform": RNG.uniform(-5, 5, 333).tolist(),
    "whole": RNG.integers(0, 40, 300).tolist(),
    "few whole": [1, 2, 2, 3],
}


@pytest.mark.parametrize("case", HISTOGRAM_CASES)
def test_histogram_matches_numpy(spark, case):
    cells = HISTOGRAM_CASES[case]
    kind = "long" if isinstance(cells[0], (int, np.integer)) else "double"
    python = [int(v) if kind == "long" else float(v) for v in cells]
    df = spark.createDataFrame([(v,) for v in python], f"v {kind}")
    counts, edges = np.histogram(np.array(python), bins="auto")
    rows = profile.histogram(df, "v").orderBy("bin").collect()
    assert [r["occurrences"] for r in rows] == counts.tolist()
    assert [r["lower"] for r in rows] == pytest.approx(edges[:-1].tolist())
    assert rows[-1]["upper"] == pytest.approx(edges[-1])


def test_histogram_of_nothing(spark):
    assert profile.histogram(spark.createDataFrame([(None,)], "v double"), "v").count() == 0


CORR_FRAME = pd.DataFrame(
    {
        "a": [1.0, 2.0, 3.0, np.nan, 5.0, 6.5],
        "b": [2.0, 1.0, np.inf, 4.0, 5.0, 0.5],
        "flat": [3.0] * 6,
        "big": [1e9 + x for x in (1, 2, 3, 4, 5, 7)],
    }
)


def test_correlation(spark):
    df = spark.createDataFrame(CORR_FRAME).repartition(3)
    # Shifting a column keeps its correlation; the far shift only tests rounding.
    near = CORR_FRAME.assign(big=CORR_FRAME["big"] - 1e9)
    expected = near.replace([np.inf, -np.inf], np.nan).corr().fillna(0)
    rows = profile.correlation_matrix(df).collect()
    assert len(rows) == 12
    for r in rows:
        assert r["correlation"] == pytest.approx(expected.loc[r["column_a"], r["column_b"]], abs=1e-9), r


def test_correlation_of_levels_and_far_values(spark):
    x = [float(i % 7) for i in range(700)]
    y = [1e9 + (i % 7) * 1e-4 for i in range(700)]
    near = [v - 1e9 for v in y]
    frame = pd.DataFrame({"x": [*x, np.inf, np.inf], "y": [*y, 1e15, -1e15], "z": [*x, 1.0, 2.0], "flat": [0.1] * 702})
    found = {(r[0], r[1]): r[2] for r in profile.correlation_matrix(spark.createDataFrame(frame).repartition(3)).collect()}
    assert found["x", "y"] == pytest.approx(np.corrcoef(x, near)[0, 1], abs=1e-9)
    assert found["x", "z"] == pytest.approx(1.0, abs=1e-12) and all(-1 <= r <= 1 for r in found.values())
    assert found["x", "flat"] == found["flat", "z"] == 0.0


def test_correlation_of_many_columns(spark):
    frame = pd.DataFrame(RNG.normal(size=(300, 60)) + RNG.normal(size=(300, 1)), columns=[f"c{i}" for i in range(60)])
    expected = frame.corr()
    rows = profile.correlation_matrix(spark.createDataFrame(frame)).collect()
    assert len(rows) == 60 * 59 and all(abs(r[2] - expected.loc[r[0], r[1]]) < 1e-9 for r in rows)


def test_correlation_of_two_thousand_columns(spark):
    """More tiles than one pass holds; gaps, and tasks that see none of a column."""
    rng = np.random.default_rng(9)
    wide = rng.normal(size=(48, 2000)) + rng.normal(size=(48, 1)) + np.arange(2000) * 1e3
    wide[rng.random(wide.shape) < 0.1] = np.nan
    wide[:24, 700] = np.nan
    wide[:, 1500] = 0.1
    frame = pd.DataFrame(wide, columns=[f"c {i}" for i in range(2000)])
    values = spark.createDataFrame([(row,) for row in wide.tolist()], "v array<double>").repartition(3)
    df = values.select(*[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(frame.columns)])
    found = profile.correlation_matrix(df)
    some = ["c 0", "c 127", "c 128", "c 700", "c 1500", "c 1999"]
    rows = found.where(F.col("column_a").isin(some)).collect()
    expected = {c: frame.corrwith(frame[c]).fillna(0) for c in some}
    expected["c 1500"][:] = 0.0
    assert len(rows) == len({(r[0], r[1]) for r in rows}) == len(some) * 1999
    assert all(abs(r[2] - (0.0 if r[1] == "c 1500" else expected[r[0]][r[1]])) < 1e-8 for r in rows)


def test_moments_merge_in_any_order():
    """Rows cut anywhere, far values and constant columns included, give the whole's result."""
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.normal(size=90), rng.normal(size=90) + 1e9, np.full(90, 0.3), rng.normal(size=90)])
    x[:30, 3] = np.nan
    x[5, 0] = 1e6

    def of(rows):
        seen = np.isfinite(rows)
        shift = np.nan_to_num(np.array([np.median(c[np.isfinite(c)]) if np.isfinite(c).any() else 0.0 for c in rows.T]))
        filled, seen = np.where(seen, rows - shift, 0.0), seen.astype(float)
        return correlation._moments(filled, seen, shift, filled, seen, shift)

    whole = correlation._coefficients(of(x))
    for cuts in ([30], [1, 2, 60], [89], [10, 20, 30, 40]):
        parts = [of(p) for p in np.split(x, cuts)]
        for order in (parts, parts[::-1]):
            total = None
            for part in order:
                total = correlation._merged(total, part)
            assert np.allclose(correlation._coefficients(total), whole, atol=1e-7)
    expected = pd.DataFrame(x).corr().fillna(0).to_numpy()
    off = ~np.eye(4, dtype=bool)
    assert np.allclose(whole[off], np.where(np.isin(np.indices((4, 4)), 2).any(axis=0), 0.0, expected)[off], atol=1e-7)


def test_special_characters_with_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a!"), (1, "b"), (2, "!?"), (3, "c"), (3, "?")], "k int, c string")
    rows = {r["character"]: (r["rows_containing"], r["min_row_index"], r["max_row_index"]) for r in profile.special_characters(df, ["c"], "k").collect()}
    base = rows["!"][1]
    assert rows == {"!": (2, base, base + 2), "?": (2, base + 2, base + 4)}


def test_texts_that_are_numbers_show_two_decimals(spark):
    df = spark.createDataFrame([(1, "1.239", "x"), (2, "2.5", "1"), (3, "7", "y")], "k int, t string, u string")
    shown = [tuple(r) for r in profile.distinct_head(df, ["t", "u"], "k").orderBy("column", "position").collect()]
    assert [r[2] for r in shown] == ["1.24", "2.5", "7.0", "x", "1.0", "y"]


def test_describe_matches_pandas(spark):
    frame = pd.DataFrame({"x": RNG.normal(size=101), "n": RNG.integers(0, 9, 101)})
    rows = {r["column"]: r for r in profile.describe_numeric(spark.createDataFrame(frame)).collect()}
    for c in frame:
        for stat in ("mean", "median", "std", "min", "max"):
            assert rows[c][stat] == pytest.approx(float(getattr(frame[c], stat)()))


def test_missing_and_duplicates(spark):
    df = spark.createDataFrame(
        [(1, "a", float("nan")), (1, "a", float("nan")), (None, "", 2.0), (None, "", 2.0), (None, None, 3.0)], "i int, s string, d double"
    )
    stats = {r["column"]: (r["missing_count"], r["missing_percentage"]) for r in profile.missing_stats(df).collect()}
    assert stats == {"i": (3, 60.0), "s": (1, 20.0), "d": (2, 40.0)}
    empty = {r["column"]: r["empty_count"] for r in profile.null_profile(df).collect()}
    assert empty == {"i": 3, "s": 3, "d": 2}
    assert profile.duplicate_rows(df).first()[0] == 2
    longer = df.select(*[F.concat(F.coalesce(c, F.lit("-")), F.repeat(F.lit("z"), 80)).alias(c) for c in ("s",)], "i")
    assert profile.duplicate_rows(longer.unionAll(longer)).first()[0] == 7
    assert profile.distinct_count(longer, ["s"]).first()["unique_values"] == 3
    assert profile.missing_stats(df.limit(0)).count() == 0
    assert profile.duplicate_rows(df.limit(0)).first()[0] == 0


def brute_special(cells):
    found = {}
    for row, cell in enumerate(cells):
        for ch in set(cell or ""):
            if not (ch.isascii() and ch.isalnum()) and ch != " ":
                found.setdefault(ch, []).append((row, cell.count(ch)))
    return {
        ch: (sum(n for _, n in hits), len(hits), hits[0][0], hits[-1][0], round(sum(n for _, n in hits) / len(hits), 2))
        for ch, hits in found.items()
    }


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab 1é.$^\\\n😀-", max_size=12)), min_size=1, max_size=12))
def test_special_characters(spark, cells):
    # Order keys with gaps, so that row numbers differ from keys.
    df = spark.createDataFrame([(i * 3 + 5, c) for i, c in enumerate(cells)], "k int, c string").repartition(3)
    rows = profile.special_characters(df, ["c"], "k").collect()
    found = {r["character"]: tuple(r)[2:] for r in rows}
    assert found == brute_special(cells)
    totals = profile.special_character_totals(df, ["c"]).first()
    assert totals["blank_cells_count"] == sum(c is None for c in cells)
    assert totals["total_special_char_occurrences"] == sum(v[0] for v in found.values())


def test_special_characters_of_long_texts(spark):
    cells = ["".join(chr(0x4E00 + (i * j) % 90) for i in range(400)) for j in range(1, 6)] + ["", "a b", "é" * 50]
    df = spark.createDataFrame(list(enumerate(cells)), "k int, c string")
    found = {r["character"]: tuple(r)[2:] for r in profile.special_characters(df, ["c"], "k").collect()}
    assert found == brute_special(cells)


def test_first_appearance_order(spark):
    cells = ["b", "a", None, "b", "c", "a", "a"]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, v string").repartition(4)
    head = profile.distinct_head(df, ["v"], "i", 2).orderBy("position").collect()
    assert [r["value"] for r in head] == ["b", "a"]
    top = profile.top_values(df, ["v"], "i").orderBy("position").collect()
    assert [(r["value"], r["occurrences"]) for r in top] == [("a", 3), ("b", 2), ("c", 1)]


def test_granularity_uses_sorted_distinct_days(spark):
    def kind(days):
        df = spark.createDataFrame([(d,) for d in days], "d string")
        row = dates.date_profile(df, ["d"]).first()
        return row["granularity"], row["missing_dates"]

    assert kind(["2024-01-05", "2024-01-02", "2024-01-02", "2024-01-03"]) == ("daily", ["2024-01-04"])
    assert kind(["2024-03-01", "2024-01-01", "2024-06-30"]) == ("monthly", ["2024-02", "2024-04", "2024-05"])
    assert kind(["2020-05-01", "2022-05-01", "2023-05-01"]) == ("yearly", ["2021"])
    assert kind(["2024-01-05"]) == ("daily", [])
    assert kind(["2024-01-05 10:00:00", "2024-01-06 23:00:00"]) == ("daily", [])


def test_column_profile_of_mixed_sheet(spark):
    df = spark.createDataFrame(
        [(1, "x", "3", "13/02/2024", 1.005), (2, "", "n/a", "14/02/2024", float("inf")), (3, None, None, None, 2.0)],
        "k int, s string, n string, d string, f double",
    )
    rows = {r["column"]: r for r in profile.column_profile(df, "k", ["s", "n", "d", "f"]).collect()}
    assert (rows["s"]["type"], rows["s"]["empty_count"], rows["s"]["unique_values"]) == ("string", 2, 2)
    assert (rows["n"]["type"], rows["n"]["min"], rows["n"]["parse_ratio"]) == ("numeric", 3.0, 0.5)
    assert (rows["d"]["type"], rows["d"]["date_format"]) == ("datetime", "DD/MM/YYYY")
    assert rows["d"]["unique_elements"] == ["13/02/2024", "14/02/2024"]
    assert rows["f"]["empty_count"] == 1 and rows["f"]["max"] == 2.0 and rows["f"]["data_type"] == "float"


def test_wide_frames_stay_one_pass(spark):
    wide = spark.range(50).select(*[(F.col("id") * (i + 1) % 17).alias(f"c{i}") for i in range(60)])
    assert profile.null_profile(wide).count() == 60
    assert profile.correlation_matrix(wide).count() == 60 * 59


def test_histogram_of_a_span_beyond_doubles(spark):
    df = spark.createDataFrame([(1e308,), (-1e308,), (0.0,), (None,), (1.5e308,)], "v double")
    bins = profile.histogram(df, "v").orderBy("bin").collect()
    assert sum(b.occurrences for b in bins) == 4 and bins[0].lower == -1e308 and bins[-1].upper == 1.5e308
    assert all(a.upper == b.lower for a, b in zip(bins, bins[1:]))


def test_top_values_of_skewed_and_flat_columns(spark, monkeypatch):
    monkeypatch.setattr(profile, "TRACKED", 300)
    monkeypatch.setattr(profile, "LISTED", 60)
    df = spark.range(0, 9_000, 1, 4).selectExpr(
        "id", "IF(id % 3 = 0, 'hot', IF(id % 5 < 2, 'g' || string(id % 8), 'tail' || string(id))) AS skewed", "id % 4000 AS flat", "string(id % 3) AS few", "CAST(NULL AS string) AS none"
    )
    columns = ["skewed", "flat", "few", "none"]
    exact, left = profile._frequent_values(df, columns, "id", 5)
    assert left == ["flat", "none"] and {r[0] for r in exact.select("column").distinct().collect()} == {"skewed", "few"}
    got = sorted(tuple(r) for r in profile.top_values(df, columns, "id", 5).collect())
    expected = sorted(tuple(r) for r in profile._first_values(df, columns, "id", 5, F.col("occurrences").desc(), F.col("first_seen")).collect())
    assert got == expected and len(got) == 13
