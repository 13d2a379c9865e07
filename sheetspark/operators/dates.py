"""Date columns: format vote, derived parts, granularity, gaps.

Days are handled as a sorted array of day numbers. A calendar of the years 1
to 9999 has under 3.7 million days, so that array is bounded whatever the
number of rows, and one partial aggregate yields it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..functions.text import as_text, collapse_whitespace, ident, is_temporal, second_text

YEARLY_DAYS, MONTHLY_DAYS = 365, 28


def format_votes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, date_format, votes) over the distinct texts of each column.

    Of equal votes the earlier format in the fixed list wins; a column in which
    nothing looks like a date is Unknown with 0 votes.
    """
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.trim(as_text(ident(c), df.schema[c].dataType)).alias("v"))
            for c in columns
        ]
    )
    distinct = df.select(F.inline(cells)).distinct().withColumn("f", D.format_of(F.col("v")))
    tallies = distinct.groupBy("column").agg(
        *[F.count_if(F.col("f") == name).alias(f"n{i}") for i, name in enumerate(D.FORMAT_NAMES)]
    )
    counts = F.array(*[F.col(f"n{i}") for i in range(len(D.FORMAT_NAMES))])
    best = F.array_max(counts)
    names = F.array(*[F.lit(n) for n in D.FORMAT_NAMES])
    winner = F.element_at(names, F.array_position(counts, best).cast("int"))
    return tallies.select(
        "column", F.when(best > 0, winner).otherwise(D.UNKNOWN).alias("date_format"), best.alias("votes")
    )


def detect_date_formats(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Format of each column; typed date columns need no vote."""
    typed = {c: "YYYY-MM-DD" for c in columns if is_temporal(df.schema[c].dataType)}
    texts = [c for c in columns if c not in typed]
    voted = {r["column"]: r["date_format"] for r in format_votes(df, texts).collect()} if texts else {}
    return {c: typed.get(c) or voted.get(c, D.UNKNOWN) for c in columns}


def as_timestamp(df: DataFrame, column: str, format_name: str | None) -> Column:
    dtype = df.schema[column].dataType
    if is_temporal(dtype):
        return ident(column).cast("timestamp_ntz")
    return D.parse_date(as_text(ident(column), dtype), format_name)


def date_column_names(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Names :func:`add_date_columns` would add."""
    return [f"{c}_{part}" for c in columns for part in ("year", "month", "month_year") if f"{c}_{part}" not in df.columns]


def add_date_columns(df: DataFrame, columns: Sequence[str], formats: dict[str, str] | None = None) -> DataFrame:
    """Add year, month and month-year text of each date column, where absent.

    One job votes for the formats of all text columns unless they are given.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    formats = {**(formats or {})}
    formats.update(detect_date_formats(df, [c for c in columns if c not in formats]))
    wanted = set(date_column_names(df, columns))
    added = []
    for column in columns:
        stamp = as_timestamp(df, column, formats[column])
        parts = {
            f"{column}_year": F.year(stamp),
            f"{column}_month": F.month(stamp),
            f"{column}_month_year": D.month_year(stamp, formats[column]),
        }
        added += [value.alias(name) for name, value in parts.items() if name in wanted]
    texts = {
        c: collapse_whitespace(ident(c)) for c in columns if isinstance(df.schema[c].dataType, T.StringType)
    }
    kept = [texts[c].alias(c) if c in texts else ident(c) for c in df.columns]
    return df.select(*kept, *added)


def group_dates(value: Column, grouping: str) -> Column:
    """``raw`` leaves the value; day, month, quarter and year truncate it."""
    return value if grouping == "raw" else F.date_trunc(grouping, value)


def date_spans(df: DataFrame, columns: Sequence[str], formats: dict[str, str] | None = None) -> DataFrame:
    """Per column: sorted distinct day numbers, first and last timestamp, format.

    One pass serves all columns.
    """
    formats = formats or detect_date_formats(df, columns)
    stamps = F.array(
        *[F.struct(F.lit(i).alias("i"), as_timestamp(df, c, formats[c]).alias("t")) for i, c in enumerate(columns)]
    )
    # Days are made distinct over all tasks before one list per column is built.
    days = (
        df.select(F.inline(stamps))
        .where("t is not null")
        .groupBy("i", F.unix_date(F.col("t").cast("date")).alias("day"))
        .agg(F.min("t").alias("first"), F.max("t").alias("last"))
    )
    spans = days.groupBy("i").agg(
        F.sort_array(F.collect_list("day")).alias("days"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    names = df.sparkSession.createDataFrame(
        [(i, c, formats[c]) for i, c in enumerate(columns)], "i int, column string, date_format string"
    )
    none = F.array().cast("array<int>")
    return names.join(spans, "i", "left").select(
        "column", "date_format", F.coalesce("days", none).alias("days"), "first", "last"
    )


def granularity_of(days: Column) -> Column:
    """yearly, monthly or daily by the median gap between neighbouring days."""
    n = F.size(days)
    gaps = F.sort_array(
        F.zip_with(F.slice(days, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(days, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    )
    m = F.size(gaps)
    low = F.get(gaps, F.floor((m - 1) / 2).cast("int"))
    high = F.get(gaps, F.floor(m / 2).cast("int"))
    median = (low + high) / 2
    return (
        F.when(n < 2, "daily")
        .when(median >= YEARLY_DAYS, "yearly")
        .when(median >= MONTHLY_DAYS, "monthly")
        .otherwise("daily")
    )


def _day(number: Column) -> Column:
    return F.date_from_unix_date(number)


def _gaps(present: Column, label) -> Column:
    """Labels of the whole numbers between the least and greatest that are absent."""
    expected = F.sequence(F.array_min(present), F.array_max(present))
    return F.transform(F.array_except(expected, present), label)


def missing_of(days: Column, granularity: Column) -> Column:
    """Labels of the periods without a day, between the first and last day."""
    years = F.array_distinct(F.transform(days, lambda d: F.year(_day(d))))
    months = F.array_distinct(F.transform(days, lambda d: F.year(_day(d)) * 12 + F.month(_day(d)) - 1))
    month_label = lambda m: F.concat(
        F.lpad(F.floor(m / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((m % 12 + 1).cast("string"), 2, "0")
    )
    return (
        F.when(F.size(days) == 0, F.array().cast("array<string>"))
        .when(granularity == "yearly", _gaps(years, lambda y: F.lpad(y.cast("string"), 4, "0")))
        .when(granularity == "monthly", _gaps(months, month_label))
        .otherwise(_gaps(days, lambda d: _day(d).cast("string")))
    )


def granularity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, granularity)."""
    return date_spans(df, columns).select("column", granularity_of(F.col("days")).alias("granularity"))


def missing_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, granularity, missing_date), one row per gap."""
    spans = date_spans(df, columns).withColumn("granularity", granularity_of(F.col("days")))
    return spans.select("column", "granularity", F.explode(missing_of(F.col("days"), F.col("granularity"))).alias("missing_date"))


def date_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min_date, max_date) as text; needs no day set."""
    formats = detect_date_formats(df, columns)
    row = df.agg(
        *[F.min(as_timestamp(df, c, formats[c])).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(as_timestamp(df, c, formats[c])).alias(f"hi{i}") for i, c in enumerate(columns)],
    )
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            second_text(F.col(f"lo{i}")).alias("min_date"),
            second_text(F.col(f"hi{i}")).alias("max_date"),
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*structs)))


def date_profile(df: DataFrame, columns: Sequence[str], formats: dict[str, str] | None = None) -> DataFrame:
    """Granularity, format, range, gaps and distinct days of each date column."""
    spans = date_spans(df, columns, formats).withColumn("granularity", granularity_of(F.col("days")))

    def printed_as(pattern: str) -> Column:
        return F.transform("days", lambda d: F.date_format(_day(d), pattern))

    printed = F
    for name, pattern in D.PRINT_PATTERN.items():
        printed = printed.when(F.col("date_format") == name, printed_as(pattern))
    printed = printed.otherwise(printed_as("yyyy-MM-dd"))
    return spans.select(
        "column",
        "granularity",
        "date_format",
        second_text(F.col("first")).alias("min_date"),
        second_text(F.col("last")).alias("max_date"),
        missing_of(F.col("days"), F.col("granularity")).alias("missing_dates"),
        printed.alias("unique_elements"),
        F.size("days").cast("long").alias("unique_values"),
    )
