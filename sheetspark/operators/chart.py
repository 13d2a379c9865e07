"""Chart-ready aggregates and the summary of saved plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import to_number_or_zero
from ..functions.text import as_text, ident, is_temporal
from .dates import as_timestamp, detect_date_formats, group_dates

_METHODS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def chart_aggregate(
    df: DataFrame,
    x: Sequence[str],
    y: Sequence[str],
    method: str = "sum",
    date_grouping: str = "raw",
) -> DataFrame:
    """Aggregate each y over the groups of the x columns.

    A y cell that is null or no number counts as 0, also in ``avg``; a null x is
    ''. Groups are the columns themselves, never a joined text. A grouping other
    than ``raw`` truncates the x columns that hold dates.
    """
    if not x or not y:
        raise ValueError("a chart needs x and y columns")
    aggregate = _METHODS.get(method, F.sum)
    labels = {c: as_text(ident(c), df.schema[c].dataType) for c in x}
    if date_grouping != "raw":
        formats = detect_date_formats(df, list(x))
        for c in x:
            if is_temporal(df.schema[c].dataType) or formats[c] != "Unknown":
                stamp = group_dates(as_timestamp(df, c, formats[c]), date_grouping)
                labels[c] = F.date_format(stamp, "yyyy-MM-dd")
    keys = [F.coalesce(label, F.lit("")).alias(c) for c, label in labels.items()]
    values = [aggregate(to_number_or_zero(ident(c), df.schema[c].dataType)).alias(c) for c in y]
    return df.groupBy(*keys).agg(*values)


def series_table(df: DataFrame, x: Sequence[str], y: Sequence[str], method: str = "sum") -> DataFrame:
    """x columns, then one column per series, in the order asked for."""
    return chart_aggregate(df, x, y, method).select(*map(ident, [*x, *y]))


def group_mean(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(ident(by)).agg(F.avg(ident(value)).alias(value))


def plot_summary(plots: DataFrame) -> DataFrame:
    """One line per saved plot: name, type label, axes, date, description."""

    def listed(axes: Column) -> Column:
        return F.when(F.size(axes) > 0, F.array_join(axes, ", ")).otherwise("N/A")

    kind = F.col("chart_type")
    label = F.when(
        kind.isin("stacked", "stacked100"),
        F.concat(F.upper(kind), F.lit(" ("), F.size("y_axes").cast("string"), F.lit(" series)")),
    ).otherwise(kind)
    description = F.when(F.col("description") != "", F.col("description")).otherwise("No description")
    return plots.select(
        "plot_name",
        label.alias("chart_type"),
        listed(F.coalesce("x_axes", F.array().cast("array<string>"))).alias("x_axes"),
        listed(F.coalesce("y_axes", F.array().cast("array<string>"))).alias("y_axes"),
        F.substring(F.col("created_at").cast("string"), 1, 16).alias("created_at"),
        description.alias("description"),
    )
