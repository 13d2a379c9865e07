"""Profiles of whole tables.

Fixed-size statistics of all columns come from one aggregate; statistics per
value come from one long (column, value) form, so one shuffle serves every
column and repeated values collapse before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers
from ..functions.numbers import finite, to_number
from ..session import saved
from ..functions.text import as_text, ident, is_empty, is_fractional, is_numeric, is_temporal, special_only
from . import dates
from .correlation import correlation_matrix
from .order import PART, POS, range_ordered, row_index, running
from .quantiles import exact_quantiles
from .types import dtype_label, eda_label, long_rows


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _known(value: Column, dtype: T.DataType) -> Column:
    """Cell with NaN as null."""
    return F.when(~F.isnan(value), value) if is_fractional(dtype) else value


def _dtype(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, empty_count): null, NaN, infinite or blank cells of each column."""
    columns = list(columns or df.columns)
    counts = []
    for i, c in enumerate(columns):
        value = finite(ident(c)) if is_fractional(_dtype(df, c)) else ident(c)
        counts.append(F.count_if(is_empty(value, _dtype(df, c))).alias(f"n{i}"))
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("empty_count")) for i, c in enumerate(columns)]
    return long_rows(df.agg(*counts), structs)


def missing_stats(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_percentage) of columns with any null."""
    counts = [
        F.count_if(_known(ident(c), _dtype(df, c)).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)
    ]
    row = df.agg(F.count("*").alias("rows"), *counts)
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("missing_count"),
            numbers.percent_of(F.col(f"n{i}"), F.col("rows")).alias("missing_percentage"),
        )
        for i, c in enumerate(df.columns)
    ]
    return long_rows(row, structs).where("missing_count > 0")


def _compact(value: Column) -> Column:
    """Short text as it is, long text as its 256-bit digest.

    Equal where the texts are, so a column of documents can be compared without
    sending the documents through the shuffle.
    """
    return F.when(F.octet_length(value) > 64, F.sha2(value, 256)).otherwise(value)


def _families(df: DataFrame, columns: Sequence[str], coerce: Sequence[str] = ()) -> dict[str, dict[str, Column]]:
    """Columns by the type their values are compared in: long, double or string.

    Numbers stay eight bytes wide in the shuffle instead of becoming text.
    """
    families: dict[str, dict[str, Column]] = {"long": {}, "double": {}, "string": {}}
    for c in columns:
        dtype = _dtype(df, c)
        if c in coerce or is_fractional(dtype):
            families["double"][c] = to_number(ident(c), dtype) + F.lit(0.0)
        elif isinstance(dtype, T.IntegralType):
            families["long"][c] = ident(c).cast("long")
        else:
            families["string"][c] = as_text(ident(c), dtype)
    return {kind: cells for kind, cells in families.items() if cells}


def _long_cells(cells: dict[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("column"), value.alias("value")) for c, value in cells.items()])


def distinct_count(
    df: DataFrame, columns: Sequence[str] | None = None, coerce: Sequence[str] = (), approximate: bool = False
) -> DataFrame:
    """(column, unique_values) without nulls; ``coerce`` columns count as numbers."""
    columns = list(columns or df.columns)
    families = _families(df, columns, coerce)
    if approximate:
        cells = {c: value for family in families.values() for c, value in family.items()}
        row = df.agg(*[F.approx_count_distinct(cells[c]).alias(f"n{i}") for i, c in enumerate(columns)])
        return long_rows(row, [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("unique_values")) for i, c in enumerate(columns)])
    # A column without values has no row below, and counts 0 by this one.
    counts = df.sparkSession.createDataFrame([(c, 0) for c in columns], "column string, unique_values long")
    for kind, family in families.items():
        cells = {c: _compact(value) for c, value in family.items()} if kind == "string" else family
        # Distinct (column, value) first, so no task holds the values of a column.
        distinct = df.select(F.inline(_long_cells(cells))).where("value is not null").distinct()
        counts = counts.unionByName(distinct.groupBy("column").agg(F.count("*").alias("unique_values")))
    return counts.groupBy("column").agg(F.sum("unique_values").alias("unique_values"))


# Up to this rank Spark cuts every task to the first rows before the shuffle.
PRUNED_RANK = 1000


def _first_of_each(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """First n rows of each column (all without n), with their ``position`` from 1.

    Small n: a row number that Spark prunes inside each task. Large n: rows are
    range-sorted and counted over the task borders, so that no task holds all
    values of a column either way.
    """
    if n is not None and n <= PRUNED_RANK:
        window = Window.partitionBy("column").orderBy(*order)
        ranked = df.withColumn("position", F.row_number().over(window))
    else:
        ordered = range_ordered(df, ["column", *order])
        ranked = running(ordered, ["column"], {"position": ("count", F.lit(1))}).drop(PART, POS)
    first = ranked if n is None else ranked.where(F.col("position") <= n)
    return first.withColumn("position", F.col("position").cast("int"))


def _first_values(df: DataFrame, columns: Sequence[str], order_by: str, n: int | None, *order: Column) -> DataFrame:
    """(column, position, value, occurrences) of the first n values of each column.

    ``order`` may use ``occurrences`` and ``first_seen``. Values become text
    only once they are among the first n.
    """
    parts = []
    for kind, cells in _families(df, columns).items():
        long = df.select(ident(order_by).alias("ord"), F.inline(_long_cells(cells))).where("value is not null")
        stats = long.groupBy("column", "value").agg(F.count("*").alias("occurrences"), F.min("ord").alias("first_seen"))
        shown = as_text(F.col("value"), stats.schema["value"].dataType)
        parts.append(_first_of_each(stats, n, *order).select("column", "position", shown.alias("value"), "occurrences"))
    return reduce(DataFrame.unionByName, parts)


def distinct_head(df: DataFrame, columns: Sequence[str], order_by: str, n: int | None = None) -> DataFrame:
    """(column, position, value): distinct values by first appearance, all of them or
    the first n where the caller names it.

    Values of number columns, and numbers in columns of text, are rounded to two
    decimals.
    """
    firsts = _first_values(df, columns, order_by, n, F.col("first_seen"))
    shown = [c for c in columns if is_numeric(_dtype(df, c)) or isinstance(_dtype(df, c), T.StringType)]
    number = to_number(F.col("value"))
    rounded = as_text(numbers.two_decimals(number), T.DoubleType())
    value = F.when(F.col("column").isin(shown) & number.isNotNull(), rounded).otherwise(F.col("value"))
    return firsts.select("column", "position", value.alias("value"))


def top_values(df: DataFrame, columns: Sequence[str], order_by: str, n: int = 10) -> DataFrame:
    """(column, position, value, occurrences): most frequent values of each column.

    Equal counts are ordered by first appearance. One pass keeps a summary of frequent
    items for each column, whose error has a bound; the values it lists are counted
    exactly by a second pass, which sends a row of each from each task. Only columns
    where the bound does not part the first ``n`` from values not listed, those of
    many values and no frequent ones, have all their values counted.
    """
    order = (F.col("occurrences").desc(), F.col("first_seen"))
    exact, left = _frequent_values(df, columns, order_by, n)
    if not left:
        return _first_of_each(exact, n, *order).select("column", "position", "value", "occurrences")
    rest = _first_values(df, left, order_by, n, *order)
    if len(left) == len(columns):
        return rest
    return _first_of_each(exact, n, *order).select("column", "position", "value", "occurrences").unionByName(rest)


# Values that a summary tracks, and lists at most.
TRACKED, LISTED = 10_000, 1_000


def _frequent_values(df: DataFrame, columns: Sequence[str], order_by: str, n: int) -> tuple[DataFrame | None, list[str]]:
    """(column, value, occurrences, first_seen) of the listed values of the columns for
    which they decide the first n, and the other columns."""
    cells = {c: value for kind, family in _families(df, columns).items() if kind in ("string", "long") for c, value in family.items()}
    if not cells or n > LISTED:
        return None, list(columns)
    named = df.select(ident(order_by).alias("ord"), *[value.alias(f"v{i}") for i, value in enumerate(cells.values())])
    summary = named.agg(
        *[F.expr(f"approx_top_k(v{i}, {LISTED}, {TRACKED})").alias(f"s{i}") for i in range(len(cells))],
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(cells))],
    ).first()
    listed = {i: [x["item"] for x in summary[f"s{i}"] if x["item"] is not None] for i in range(len(cells))}
    known = [
        F.struct(F.lit(c).alias("column"), F.when(F.col(f"v{i}").isin(listed[i]), as_text(F.col(f"v{i}"), named.schema[f"v{i}"].dataType)).alias("value"))
        for i, c in enumerate(cells)
        if listed[i]
    ]
    if not known:
        return None, list(columns)
    long = named.select("ord", F.inline(F.array(*known))).where("value is not null")
    counted = saved(long.groupBy("column", "value").agg(F.count("*").alias("occurrences"), F.min("ord").alias("first_seen")))
    ranked = counted.groupBy("column").agg(F.sum("occurrences").alias("all"), F.sort_array(F.collect_list("occurrences"), asc=False).alias("counts"))
    found = {r["column"]: r for r in ranked.collect()}
    decided = []
    for i, c in enumerate(cells):
        total, items, row = summary[f"n{i}"], summary[f"s{i}"], found.get(c)
        if row is None:
            continue
        # An item not listed has 5.25 / TRACKED of all values at most, or, where the
        # list is full, what its last item may have.
        bound = max(5.25 * total / TRACKED, items[-1]["count"] if len(items) == LISTED else 0)
        if row["all"] == total or (len(row["counts"]) >= n and row["counts"][n - 1] > bound):
            decided.append(c)
    if not decided:
        return None, list(columns)
    return counted.where(F.col("column").isin(decided)), [c for c in columns if c not in decided]


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min, max, average, parse_ratio) of the cells that are numbers."""
    aggregates = []
    for i, c in enumerate(columns):
        value = finite(to_number(ident(c), _dtype(df, c)))
        aggregates += [
            F.min(value).alias(f"lo{i}"),
            F.max(value).alias(f"hi{i}"),
            F.avg(value).alias(f"avg{i}"),
            F.count(to_number(ident(c), _dtype(df, c))).alias(f"ok{i}"),
            F.count(_known(ident(c), _dtype(df, c))).alias(f"n{i}"),
        ]
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            numbers.two_decimals(F.col(f"lo{i}")).alias("min"),
            numbers.two_decimals(F.col(f"hi{i}")).alias("max"),
            numbers.two_decimals(F.col(f"avg{i}")).alias("average"),
            F.try_divide(F.col(f"ok{i}").cast("double"), F.col(f"n{i}")).alias("parse_ratio"),
        )
        for i, c in enumerate(columns)
    ]
    return long_rows(df.agg(*aggregates), structs)


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, mean, median, std, min, max); the median is exact."""
    columns = list(columns or numeric_columns(df))
    aggregates = []
    for i, c in enumerate(columns):
        value = _known(ident(c).cast("double"), T.DoubleType())
        aggregates += [
            F.avg(value).alias(f"mean{i}"),
            F.stddev_samp(value).alias(f"std{i}"),
            F.min(value).alias(f"min{i}"),
            F.max(value).alias(f"max{i}"),
        ]
    medians = exact_quantiles(df, columns, [0.5])
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            finite(F.col(f"mean{i}")).alias("mean"),
            finite(F.lit(medians[c][0]).cast("double")).alias("median"),
            finite(F.col(f"std{i}")).alias("std"),
            finite(F.col(f"min{i}")).alias("min"),
            finite(F.col(f"max{i}")).alias("max"),
        )
        for i, c in enumerate(columns)
    ]
    return long_rows(df.agg(*aggregates), structs)


def auto_bins(count: int, low: float, high: float, iqr: float, whole_numbers: bool) -> tuple[float, float, int]:
    """(first edge, last edge, number of bins) of the automatic rule.

    The narrower of the quartile width (but at least half the square-root
    width) and the logarithmic width; whole numbers have width one at least.
    """
    if low == high:
        return low - 0.5, high + 0.5, 1
    span = high - low
    quartile_width = 2.0 * iqr / count ** (1.0 / 3.0)
    width = min(max(quartile_width, span / count**0.5 / 2.0), span / (log2(count) + 1.0))
    if whole_numbers:
        width = max(width, 1.0)
    return low, high, max(1, ceil(span / width))


def histograms(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, bin, lower, upper, occurrences) with automatically chosen equal bins.

    Shared passes for all columns: statistics and quartiles fix the edges, then
    one count per bin. A value belongs to the bin whose edges enclose it; only
    the last bin is closed. Columns without finite range have no bins.
    """
    columns = list(columns)
    spark, schema = df.sparkSession, "column string, bin long, lower double, upper double, occurrences long"
    values = df.select(
        *[_known(ident(c).cast("double"), T.DoubleType()).alias(f"v{i}") for i, c in enumerate(columns)]
    )
    stats = values.agg(
        *[f(f"v{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    ).first()
    usable = [
        i for i in range(len(columns)) if stats[f"n{i}"] and abs(stats[f"lo{i}"]) < float("inf") and abs(stats[f"hi{i}"]) < float("inf")
    ]
    if not usable:
        return spark.createDataFrame([], schema)
    quartiles = exact_quantiles(df, [columns[i] for i in usable], [0.25, 0.75])
    shapes = []
    for i in usable:
        q1, q3 = quartiles[columns[i]]
        whole = isinstance(_dtype(df, columns[i]), T.IntegralType)
        low, high = stats[f"lo{i}"], stats[f"hi{i}"]
        # Where the span overflows, everything is done on a quarter of the values.
        scale = 1.0 if abs(high - low) < float("inf") else 4.0
        first, last, bins = auto_bins(stats[f"n{i}"], low / scale, high / scale, q3 / scale - q1 / scale, whole)
        shapes.append((i, columns[i], first, last, bins, (last - first) / bins, scale))

    def edge(i: Column, first, last, bins, step) -> Column:
        return F.when(i == bins, last).otherwise(i * step + first)

    # A first guess by division, as a column so that it is computed once, is then
    # corrected by the edges beside it.
    guesses = {
        f"g{i}": F.least(F.floor((F.col(f"v{i}") - first) * (bins / (last - first))), F.lit(bins - 1)).cast("long")
        for i, _, first, last, bins, _, _ in shapes
    }
    scaled = {f"v{i}": F.col(f"v{i}") / scale for i, *_, scale in shapes if scale > 1}
    cells = []
    for i, _, first, last, bins, step, _ in shapes:
        shape = [F.lit(x) for x in (first, last, bins, step)]
        value, guess = F.col(f"v{i}"), F.col(f"g{i}")
        lowered = F.when(value < edge(guess, *shape), guess - 1).otherwise(guess)
        placed = F.when((value >= edge(guess + 1, *shape)) & (guess < bins - 1), guess + 1).otherwise(lowered)
        cells.append(F.when(value.isNotNull(), F.struct(F.lit(i).alias("i"), placed.alias("bin"))))
    counts = values.withColumns(scaled).withColumns(guesses).select(F.inline(F.array_compact(F.array(*cells)))).groupBy("i", "bin").agg(F.count("*").alias("n"))
    edges = spark.createDataFrame(shapes, "i int, column string, first double, last double, bins long, step double, scale double")
    every = edges.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    shape = [F.col(c) for c in ("first", "last", "bins", "step")]
    return every.join(counts, ["i", "bin"], "left").select(
        "column",
        "bin",
        (edge(F.col("bin"), *shape) * F.col("scale")).alias("lower"),
        (edge(F.col("bin") + 1, *shape) * F.col("scale")).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("long").alias("occurrences"),
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(bin, lower, upper, occurrences) of one column."""
    return histograms(df, [column]).drop("column")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(duplicate_rows): rows equal to an earlier row in every column."""
    cells = [
        (_compact(ident(f.name)) if isinstance(f.dataType, T.StringType) else ident(f.name)).alias(f.name)
        for f in df.schema.fields
    ]
    groups = df.select(*cells).groupBy(*map(ident, df.columns)).agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def basic_info(df: DataFrame) -> DataFrame:
    """(column, column_type, total_rows, total_columns)."""
    structs = [
        F.struct(F.lit(f.name).alias("column"), F.lit(eda_label(f.dataType)).alias("column_type"))
        for f in df.schema.fields
    ]
    return df.agg(F.count("*").alias("total_rows")).select(
        F.inline(F.array(*structs)), "total_rows", F.lit(len(df.columns)).cast("long").alias("total_columns")
    )


def overview(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, count, mean, stddev, min, p25, p50, p75, max) of number columns.

    The percentiles are sketches, as in the built-in summary.
    """
    columns = list(columns or numeric_columns(df))
    aggregates = []
    for i, c in enumerate(columns):
        value = ident(c).cast("double")
        aggregates += [
            F.count(value).alias(f"n{i}"),
            F.avg(value).alias(f"mean{i}"),
            F.stddev_samp(value).alias(f"std{i}"),
            F.min(value).alias(f"lo{i}"),
            F.max(value).alias(f"hi{i}"),
            F.percentile_approx(value, [0.25, 0.5, 0.75]).alias(f"q{i}"),
        ]
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("count"),
            F.col(f"mean{i}").alias("mean"),
            F.col(f"std{i}").alias("stddev"),
            F.col(f"lo{i}").alias("min"),
            F.get(f"q{i}", F.lit(0)).alias("p25"),
            F.get(f"q{i}", F.lit(1)).alias("p50"),
            F.get(f"q{i}", F.lit(2)).alias("p75"),
            F.col(f"hi{i}").alias("max"),
        )
        for i, c in enumerate(columns)
    ]
    return long_rows(df.agg(*aggregates), structs)


# Up to this many different characters a cell is scanned once for each.
SCANNED_CHARACTERS = 32


def character_counts(cells: DataFrame) -> DataFrame:
    """Cells (..., special) as one row per character with its number of ``times``.

    A cell of few different characters is scanned for each of them. In any other
    cell the characters are sorted and each run counted, which stays near linear
    for long texts with thousands of characters. The arrays are columns of their
    own, so that they are built once per cell.
    """
    others = [c for c in cells.columns if c != "special"]
    split = cells.select(*others, "special", F.split("special", "").alias("letters"))
    distinct = split.select("*", F.array_distinct("letters").alias("kinds"))
    many = F.size("kinds") > SCANNED_CHARACTERS
    ordered = distinct.select(*others, "special", "kinds", F.when(many, F.sort_array("letters")).alias("letters"))
    is_start = lambda i: (i == 0) | (F.get("letters", i) != F.get("letters", i - 1))
    starts = F.when(many, F.filter(F.sequence(F.lit(0), F.size("letters") - 1), is_start))
    runs = ordered.select("*", starts.alias("starts"))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("letters")))

    def counted(character: Column, times: Column) -> Column:
        return F.struct(character.alias("character"), times.cast("long").alias("times"))

    scanned = F.transform(
        "kinds", lambda c: counted(c, F.length("special") - F.length(F.replace(F.col("special"), c, F.lit(""))))
    )
    sorted_runs = F.zip_with("starts", ends, lambda b, e: counted(F.get("letters", b), e - b))
    return runs.select(*others, F.inline(F.when(many, sorted_runs).otherwise(scanned))).where("character <> ''")


def special_characters(df: DataFrame, columns: Sequence[str], order_by: str) -> DataFrame:
    """(column, character, total_occurrences, rows_containing, min_row_index,
    max_row_index, avg_occurrences_per_row) of characters other than ASCII
    letters, digits and the space.

    Counting happens inside the row; the shuffle sees one line per column and
    character from each task. Row numbers are looked up afterwards for the few
    first and last rows, over the order column alone. Rows of one order key stand
    together: the first row of the first key and the last row of the last count.
    """
    cells = [
        F.struct(F.lit(c).alias("column"), special_only(as_text(ident(c), _dtype(df, c))).alias("special")) for c in columns
    ]
    per_cell = character_counts(df.select(ident(order_by).alias("ord"), F.inline(F.array(*cells))))
    stats = per_cell.groupBy("column", "character").agg(
        F.sum("times").alias("total_occurrences"),
        F.count("*").alias("rows_containing"),
        F.min("ord").alias("first"),
        F.max("ord").alias("last"),
    )
    index = row_index(df.select(ident(order_by).alias("ord")), ["ord"], "row_index")
    borders = index.groupBy("ord").agg(F.min("row_index").alias("low"), F.max("row_index").alias("high"))
    first = borders.select(F.col("ord").alias("first"), F.col("low").alias("min_row_index"))
    last = borders.select(F.col("ord").alias("last"), F.col("high").alias("max_row_index"))
    mean = F.try_divide(F.col("total_occurrences").cast("double"), F.col("rows_containing"))
    return stats.join(first, "first").join(last, "last").select(
        "column",
        "character",
        "total_occurrences",
        "rows_containing",
        "min_row_index",
        "max_row_index",
        numbers.round_half_even_scaled(mean).alias("avg_occurrences_per_row"),
    )


def special_character_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, blank_cells_count, total_special_char_occurrences)."""
    aggregates = []
    for i, c in enumerate(columns):
        value = as_text(ident(c), _dtype(df, c))
        special = F.length(special_only(value))
        aggregates += [
            F.count_if(_known(ident(c), _dtype(df, c)).isNull()).alias(f"b{i}"),
            F.coalesce(F.sum(special), F.lit(0)).cast("long").alias(f"s{i}"),
        ]
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"b{i}").alias("blank_cells_count"),
            F.col(f"s{i}").alias("total_special_char_occurrences"),
        )
        for i, c in enumerate(columns)
    ]
    return long_rows(df.agg(*aggregates), structs)


def column_profile(df: DataFrame, order_by: str, columns: Sequence[str] | None = None, values: int = 100) -> DataFrame:
    """One row per column: emptiness, types, and the statistics of its type.

    One pass yields all fixed-size statistics, the others serve all columns at
    once: format votes, distinct values, first values, days. A column is numeric when any cell is a number, else a date when its voted
    format parses any cell, else a string.
    """
    columns = list(columns or df.columns)
    fixed = []
    for i, c in enumerate(columns):
        dtype = _dtype(df, c)
        number = to_number(ident(c), dtype)
        cell = finite(ident(c)) if is_fractional(dtype) else ident(c)
        fixed += [
            F.count_if(is_empty(cell, dtype)).alias(f"empty{i}"),
            F.count(_known(ident(c), dtype)).alias(f"known{i}"),
            F.count(number).alias(f"numbers{i}"),
            F.min(finite(number)).alias(f"min{i}"),
            F.max(finite(number)).alias(f"max{i}"),
            F.avg(finite(number)).alias(f"avg{i}"),
        ]
    # One value per column and statistic: this row grows with the sheet's width only.
    stats = df.agg(*fixed).first()
    numeric = [c for i, c in enumerate(columns) if stats[f"numbers{i}"]]
    rest = [c for c in columns if c not in numeric and (is_temporal(_dtype(df, c)) or isinstance(_dtype(df, c), T.StringType))]
    formats = dates.detect_date_formats(df, rest)
    dated = [c for c in rest if formats[c] != "Unknown"]
    lines = []
    for i, c in enumerate(columns):
        kind = "numeric" if c in numeric else "datetime" if c in dated else "string"
        summary = [stats[f"{n}{i}"] if c in numeric else None for n in ("min", "max", "avg")]
        ratio = stats[f"numbers{i}"] / stats[f"known{i}"] if c in numeric else None
        lines.append((c, dtype_label(_dtype(df, c)), kind, stats[f"empty{i}"], *summary, ratio))
    base = df.sparkSession.createDataFrame(
        lines, "column string, data_type string, type string, empty_count long, min double, max double, average double, parse_ratio double"
    ).withColumns({n: numbers.two_decimals(F.col(n)) for n in ("min", "max", "average")})
    counts = distinct_count(df, columns, coerce=numeric).withColumnRenamed("unique_values", "__unique")
    result = base.join(counts, "column")
    listed = [c for c in columns if c not in dated]
    heads = distinct_head(df, listed, order_by, values) if listed else None
    if dated:
        profile = dates.date_profile(df, dated, {c: formats[c] for c in dated}).selectExpr(
            "column", "granularity", "date_format", "min_date", "max_date", "missing_dates",
            "unique_elements __days", "unique_values __day_count",
        )
        result = result.join(profile, "column", "left")
    else:
        result = result.selectExpr(
            "*",
            *[f"cast(null as string) {n}" for n in ("granularity", "date_format", "min_date", "max_date")],
            *[f"cast(null as array<string>) {n}" for n in ("missing_dates", "__days")],
            "cast(null as long) __day_count",
        )
    if heads is not None:
        # At most ``values`` rows per column reach this list.
        listed = heads.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("__head"))
        result = result.join(listed.select("column", F.col("__head.value").alias("__first")), "column", "left")
    else:
        result = result.withColumn("__first", F.lit(None).cast("array<string>"))
    return result.select(
        "column", "data_type", "type", "empty_count",
        F.coalesce("__day_count", "__unique").alias("unique_values"),
        "min", "max", "average", "parse_ratio",
        "granularity", "date_format", "min_date", "max_date", "missing_dates",
        F.coalesce("__days", "__first", F.array().cast("array<string>")).alias("unique_elements"),
    )


def eda_report(df: DataFrame, order_by: str) -> DataFrame:
    """(section, column, item, number, text): every analysis in one long form."""
    numbers_in, texts_in = numeric_columns(df), text_columns(df)

    def rows(frame: DataFrame, section: str, column: Column, item: Column, number: Column, text: Column) -> DataFrame:
        return frame.select(
            F.lit(section).alias("section"),
            column.cast("string").alias("column"),
            item.cast("string").alias("item"),
            number.cast("double").alias("number"),
            text.cast("string").alias("text"),
        )

    none = F.lit(None)
    parts = [
        rows(basic_info(df), "basic_info", F.col("column"), F.lit("column_type"), none, F.col("column_type")),
        rows(df.agg(F.count("*").alias("n")), "basic_info", none, F.lit("total_rows"), F.col("n"), none),
        rows(duplicate_rows(df), "basic_info", none, F.lit("duplicate_rows"), F.col("duplicate_rows"), none),
        rows(missing_stats(df), "missing_values", F.col("column"), F.lit("missing_count"), F.col("missing_count"), none),
    ]
    if numbers_in:
        stats = describe_numeric(df, numbers_in).unpivot(
            ["column"], ["mean", "median", "std", "min", "max"], "item", "number"
        )
        parts.append(rows(stats, "numerical_stats", F.col("column"), F.col("item"), F.col("number"), none))
        bars = histograms(df, numbers_in)
        parts.append(rows(bars, "histogram", F.col("column"), F.col("lower"), F.col("occurrences"), F.col("upper")))
    if texts_in:
        uniques = distinct_count(df, texts_in)
        parts.append(rows(uniques, "categorical_stats", F.col("column"), F.lit("unique_values"), F.col("unique_values"), none))
        top = top_values(df, texts_in, order_by)
        parts.append(rows(top, "top_categories", F.col("column"), F.col("value"), F.col("occurrences"), none))
    if len(numbers_in) > 1:
        corr = correlation_matrix(df, numbers_in)
        parts.append(rows(corr, "correlation", F.col("column_a"), F.col("column_b"), F.col("correlation"), none))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
