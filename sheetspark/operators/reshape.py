"""Wide to long, cross-tabs and stacked shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import to_number_or_zero
from ..functions.text import as_text, ident, is_numeric
from .clean import fill_missing, rewrite
from .filters import apply_active_filters


def melt(
    df: DataFrame,
    id_vars: Sequence[str],
    value_vars: Sequence[str] = (),
    var_name: str = "Variable",
    value_name: str = "Value",
    fill: str | None = None,
) -> DataFrame:
    """One row per (row, value column); nulls stay rows, other columns go.

    Values of one type keep it, numbers of several types become double, any
    other mix becomes text. ``fill`` turns every cell into text with that word
    in place of nulls.
    """
    values = list(value_vars) or [c for c in df.columns if c not in id_vars]
    missing = [c for c in [*id_vars, *values] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    kinds = {df.schema[c].dataType.simpleString() for c in values}
    changes = {}
    if len(kinds) > 1:
        if all(is_numeric(df.schema[c].dataType) for c in values):
            changes = {c: ident(c).cast("double") for c in values}
        else:
            changes = {c: as_text(ident(c), df.schema[c].dataType) for c in values}
    long = rewrite(df, changes).unpivot([ident(c) for c in id_vars], [ident(c) for c in values], var_name, value_name)
    return long if fill is None else fill_missing(long, fill)


_AGGREGATES = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}


_HEADING = "__pivot_heading"


def pivot(
    df: DataFrame,
    rows: Sequence[str],
    columns: str | Sequence[str],
    values: Mapping[str, str],
    filters: Mapping[str, Sequence[Any]] | None = None,
    column_values: Sequence[Any] | None = None,
) -> DataFrame:
    """Cross-tab of a stored pivot: ``values`` maps a column to its aggregate.

    Several column fields are one heading, their texts joined by `` | `` (missing
    ones empty); ``column_values`` are then such headings. Naming the ``column_values``
    saves the extra job that looks them up. Rows without a heading are left out, so no
    column stands for null beside one for the text "null".
    """
    kept = apply_active_filters(df, filters or {})
    aggregates = [_AGGREGATES[how](ident(c)).alias(f"{how}_{c}") for c, how in values.items()]
    if isinstance(columns, str):
        heading = ident(columns)
    else:
        texts = [F.coalesce(as_text(ident(c), df.schema[c].dataType), F.lit("")) for c in columns]
        heading = F.concat_ws(" | ", *texts)
    grouped = kept.withColumn(_HEADING, heading).where(F.col(_HEADING).isNotNull()).groupBy(*[ident(c) for c in rows])
    table = grouped.pivot(_HEADING, list(column_values)) if column_values else grouped.pivot(_HEADING)
    return table.agg(*aggregates)


def _as_series(df: DataFrame, x: Sequence[str], y: Sequence[str]) -> tuple[list[Column], dict[str, Column]]:
    labels = [
        F.coalesce(as_text(ident(c), df.schema[c].dataType), F.lit("")).alias(c)
        if c in df.columns
        else F.lit("").alias(c)
        for c in x
    ]
    series = {
        c: to_number_or_zero(ident(c), df.schema[c].dataType) if c in df.columns else F.lit(0.0) for c in y
    }
    return labels, series


def stacked(df: DataFrame, x: Sequence[str], y: Sequence[str]) -> DataFrame:
    """Chart rows: every y a number (0 when missing or bad), missing x ''."""
    labels, series = _as_series(df, x, y)
    return df.select(*labels, *[value.alias(c) for c, value in series.items()])


def stacked100(df: DataFrame, x: Sequence[str], y: Sequence[str]) -> DataFrame:
    """Each y as percent of its row's sum; all 0 where the sum is not positive."""
    labels, series = _as_series(df, x, y)
    total = reduce(lambda a, b: a + b, series.values())
    shares = [F.when(total > 0, value / F.nullif(total, F.lit(0.0)) * 100.0).otherwise(0.0).alias(c) for c, value in series.items()]
    return df.select(*labels, *shares)
