"""Row predicates; all are pushed to the scan when the source allows it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.text import ident

# Longer id lists are joined, so the plan does not carry them as literals.
LITERAL_IDS = 1000


def filter_equal(df: DataFrame, wanted: Mapping[str, Any]) -> DataFrame:
    """Equality on every given column; an empty value means no filter."""
    for column, value in wanted.items():
        if value not in (None, ""):
            df = df.where(ident(column) == value)
    return df


def filter_contains_ci(df: DataFrame, column: str, needle: str | None) -> DataFrame:
    return df.where(text.contains_ci(ident(column), needle)) if needle else df


def filter_equals_ci(df: DataFrame, column: str, value: str | None) -> DataFrame:
    return df.where(text.equals_ci(ident(column), value)) if value else df


def _as_day(value: str | date | None) -> date | None:
    if isinstance(value, (date, datetime)) or value is None:
        return value
    try:
        return datetime.strptime(value, "%Y-%m-%d").date()
    except ValueError:
        return None


def filter_time(
    df: DataFrame, column: str, start: str | date | None = None, end: str | date | None = None
) -> DataFrame:
    """Rows of the days start..end, both whole; a text that is no date is ignored."""
    first, last = _as_day(start), _as_day(end)
    if first is not None:
        df = df.where(ident(column) >= F.lit(first))
    if last is not None:
        df = df.where(ident(column) < F.lit(last + timedelta(days=1)))
    return df


def exclude_any(df: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    """Drop rows whose text holds any of the words, in any case."""
    return df.where(~text.contains_any_ci(ident(column), list(words)))


def has_all_tags(df: DataFrame, column: str, tags: Sequence[str]) -> DataFrame:
    """Rows whose array holds every tag."""
    checks = [F.array_contains(ident(column), tag) for tag in tags]
    return df.where(reduce(lambda a, b: a & b, checks)) if checks else df


def in_list(df: DataFrame, column: str, ids: Sequence[Any] | DataFrame) -> DataFrame:
    """Rows whose value is listed; an empty list keeps every row.

    A DataFrame of ids is a semi-join whose strategy Spark picks by size.
    """
    if isinstance(ids, DataFrame):
        wanted = ids.select(ident(ids.columns[0]).alias(column)).distinct()
        return df.join(wanted, column, "left_semi")
    if not ids:
        return df
    if len(ids) <= LITERAL_IDS:
        return df.where(ident(column).isin(list(ids)))
    schema = T.StructType([T.StructField(column, df.schema[column].dataType)])
    return df.join(df.sparkSession.createDataFrame([(i,) for i in set(ids)], schema), column, "left_semi")


SCOPES = {
    "user": ["user_id"],
    "project": ["project_id"],
    "sheet": ["project_id", "file_name", "sheet_name"],
}


def scope_filter(df: DataFrame, level: str, keys: Mapping[str, Any], scopes: Mapping[str, Sequence[str]] = SCOPES) -> DataFrame:
    """Rows of one user, project or sheet; a missing key is an error."""
    if level not in scopes or any(keys.get(c) in (None, "") for c in scopes[level]):
        raise ValueError(f"level {level!r} needs {list(scopes.get(level, []))}")
    return filter_equal(df, {c: keys[c] for c in scopes[level]})


def active_only(df: DataFrame, flag: str = "is_active") -> DataFrame:
    return df.where(ident(flag))


def rows_with_columns(df: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    """Map records that carry all the wanted keys."""
    for key in wanted:
        df = df.where(F.map_contains_key(ident(column), key))
    return df


def filter_expr(df: DataFrame, condition: str | Column) -> DataFrame:
    return df.where(condition)


def apply_active_filters(df: DataFrame, active: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Keep the chosen values of each filtered column; no choice means all."""
    for column, values in active.items():
        if values:
            df = in_list(df, column, values)
    return df
