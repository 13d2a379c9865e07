"""Column expressions on small hand-made frames."""

import pytest
from pyspark.sql import functions as F

from sheetspark.functions import dates, numbers, text


def values(spark, column, items, ddl):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {ddl}")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_round_half_even_scaled(spark):
    cells = [0.575, 2.675, 0.285, 1.005, None]
    assert values(spark, numbers.round_half_even_scaled(F.col("v")), cells, "double") == [0.57, 2.68, 0.28, 1.0, None]


def test_to_number_takes_only_number_texts(spark):
    cells = ["1", " 2.5 ", "1e3", "-.5", "5.", "1d", "2f", "0x1p3", "abc", "", "nan", "1,000", None]
    expected = [1.0, 2.5, 1000.0, -0.5, 5.0] + [None] * 8
    assert values(spark, numbers.to_number(F.col("v")), cells, "string") == expected


def test_infinite_texts_are_numbers_but_not_finite(spark):
    cells = ["inf", "-Infinity", "7"]
    assert values(spark, numbers.to_number(F.col("v")), cells, "string") == [float("inf"), float("-inf"), 7.0]
    assert values(spark, numbers.finite(numbers.to_number(F.col("v"))), cells, "string") == [None, None, 7.0]


def test_number_text_is_plain_up_to_sixteen_digits(spark):
    cells = [1e7, 0.5, 1.5e-3, -2.5e8, 12345678901.25, 1e16, 3.0]
    expected = ["10000000.0", "0.5", "0.0015", "-250000000.0", "12345678901.25", "1.0E16", "3.0"]
    assert values(spark, text.number_text(F.col("v")), cells, "double") == expected


@pytest.mark.parametrize(
    ("cell", "name"),
    [
        ("13/02/2024", "DD/MM/YYYY"),
        ("02/13/2024", "MM/DD/YYYY"),
        ("1/2/2024", "MM/DD/YYYY"),
        ("1/2/2024/9", None),
        ("2024-1-5", "YYYY-MM-DD"),
        ("2024-01-05 10:30:00", "YYYY-MM-DD"),
        ("2024/13/02", "YYYY/DD/MM"),
        ("2024/02/13", "YYYY/MM/DD"),
        ("13-02-2024", "DD-MM-YYYY"),
        ("02-13-2024", "MM-DD-YYYY"),
        ("13.02.2024", "DD.MM.YYYY"),
        ("02.13.2024", "MM.DD.YYYY"),
        ("2024.01.02", "YYYY.MM.DD"),
        ("plain", None),
        ("", None),
    ],
)
def test_format_of(spark, cell, name):
    assert values(spark, dates.format_of(F.col("v")), [cell], "string") == [name]


def test_parse_date_by_voted_format(spark):
    cells = ["01/02/2024", "13/02/2024", "2/3/2024 04:05:06", "2024-01-01", None]
    parsed = values(spark, dates.parse_date(F.col("v"), "DD/MM/YYYY").cast("string"), cells, "string")
    assert parsed == ["2024-02-01 00:00:00", "2024-02-13 00:00:00", "2024-03-02 04:05:06", None, None]


def test_zoneless_times_ignore_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    # In this zone the clock skipped the first hour of that day.
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        stamp = F.col("v").cast("timestamp_ntz")
        assert values(spark, text.timestamp_text(stamp), ["1998-10-11 00:00:00", "1998-10-11 00:00:00.5"], "string") == [
            "1998-10-11 00:00:00",
            "1998-10-11 00:00:00.500000",
        ]
        parsed = dates.parse_date(F.col("v"), "DD/MM/YYYY")
        assert values(spark, text.second_text(parsed), ["11/10/1998"], "string") == ["1998-10-11 00:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_path_parts(spark):
    cells = ["a/b\\c.d.csv", ".bashrc", "x", "a.b/c", "dir/", "..conf.txt"]
    assert values(spark, text.file_basename(F.col("v")), cells, "string") == ["c.d.csv", ".bashrc", "x", "c", "", "..conf.txt"]
    assert values(spark, text.file_stem(F.col("v")), cells, "string") == ["c.d", ".bashrc", "x", "c", "", "..conf"]
    assert values(spark, text.file_extension(F.col("v")), cells, "string") == [".csv", "", "", "", "", ".txt"]


def test_sheet_title(spark):
    cells = ["Sales / Month: total & more", "a" * 40, "x?"]
    titles = values(spark, text.sheet_title(F.col("i") + 1, F.col("v")), cells, "string")
    assert titles == ["Plot_1_Sales  Month total", "Plot_2_" + "a" * 20, "Plot_3_x"]


def test_error_tokens_and_blanks(spark):
    cells = ["#N/A", "#DIV/0!", "", None, "x"]
    assert values(spark, text.is_error_token(F.col("v")), cells, "string") == [True, True, False, False, False]
    assert values(spark, text.is_empty(F.col("v")), cells, "string") == [False, False, True, True, False]


def test_whitespace_is_unicode(spark):
    cells = ["  a\t\n b 　c\x1cd ", None]
    assert values(spark, text.collapse_whitespace(F.col("v")), cells, "string") == ["a b c d", None]


def test_clean_header():
    assert text.clean_header(" Period_a/b\n\r") == "a_b"
    assert text.clean_header("period_x\\y\nz") == "x_y z"
