"""Cleaning: every operator is one projection, so chains collapse to one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, text
from ..functions.text import as_text, ident


def rewrite(df: DataFrame, changes: Mapping[str, Column]) -> DataFrame:
    """One select that replaces the named columns and keeps the column order."""
    return df.select(*[changes[c].alias(c) if c in changes else ident(c) for c in df.columns])


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _text_of(df: DataFrame, column: str) -> Column:
    return as_text(ident(column), df.schema[column].dataType)


def lowercase(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower-case the named columns; unknown names are ignored."""
    return rewrite(df, {c: F.lower(_text_of(df, c)) for c in _present(df, columns)})


def remove_spaces(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Delete every plain space."""
    return rewrite(df, {c: text.remove_spaces(_text_of(df, c)) for c in _present(df, columns)})


def remove_chars(df: DataFrame, options: Mapping[str, Mapping[str, bool]]) -> DataFrame:
    """Delete the flagged literal characters of each named column."""
    changes = {}
    for column in _present(df, list(options)):
        literals = [literal for literal, flag in options[column].items() if flag]
        if literals:
            changes[column] = text.remove_literals(_text_of(df, column), literals)
    return rewrite(df, changes)


def clean(
    df: DataFrame,
    lowercase_columns: Sequence[str] = (),
    remove_spaces_columns: Sequence[str] = (),
    remove_special_chars: Mapping[str, Mapping[str, bool]] | None = None,
) -> DataFrame:
    """The three cleaning steps in their fixed order."""
    lowered = lowercase(df, lowercase_columns)
    return remove_chars(remove_spaces(lowered, remove_spaces_columns), remove_special_chars or {})


def collapse_ws(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rewrite(df, {c: text.collapse_whitespace(_text_of(df, c)) for c in _present(df, columns)})


def fill_missing(df: DataFrame, fill: str = "NA", columns: Sequence[str] | None = None) -> DataFrame:
    """Null, and infinity in number columns, become ``fill``; all cells become text."""
    changes = {}
    for column in _present(df, columns if columns is not None else df.columns):
        dtype = df.schema[column].dataType
        value = numbers.finite(ident(column)) if text.is_fractional(dtype) else ident(column)
        changes[column] = F.coalesce(as_text(value, dtype), F.lit(fill))
    return rewrite(df, changes)


def null_infinite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """+-infinity and NaN become null in every float column."""
    names = [c for c in (columns or df.columns) if text.is_fractional(df.schema[c].dataType)]
    return rewrite(df, {c: numbers.finite(ident(c)) for c in names})


def round_numeric(df: DataFrame, places: int = 2) -> DataFrame:
    """Round float columns; a tie of the scaled value goes to the even digit."""
    changes = {}
    for field in df.schema.fields:
        if text.is_fractional(field.dataType):
            changes[field.name] = numbers.round_half_even_scaled(ident(field.name), places)
        elif isinstance(field.dataType, T.DecimalType):
            changes[field.name] = F.bround(ident(field.name), places)
    return rewrite(df, changes)


def stringify_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null becomes '', the rest becomes text."""
    return rewrite(df, {c: F.coalesce(_text_of(df, c), F.lit("")) for c in _present(df, columns)})


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename by position; two columns may not end up with one name."""
    repeated = sorted({n for n in names if list(names).count(n) > 1})
    if repeated:
        raise ValueError(f"column names would collide: {repeated}")
    return df.toDF(*names)


def trim_names(df: DataFrame) -> DataFrame:
    return rename_all(df, [c.strip() for c in df.columns])


def sanitize_names(df: DataFrame) -> DataFrame:
    """Headers fit for export."""
    return rename_all(df, [text.clean_header(c) for c in df.columns])


def select_in_order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*[ident(c) for c in columns])


def add_constant(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def export_text(df: DataFrame) -> DataFrame:
    """Every cell as export text: null is '', timestamps are ISO, nested cells JSON."""
    cells = []
    for field in df.schema.fields:
        value, dtype = ident(field.name), field.dataType
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            shown = text.timestamp_text(value, "T")
        elif isinstance(dtype, T.StringType):
            shown = text.strip_period_prefix(value)
        elif text.is_fractional(dtype):
            shown = as_text(F.when(~F.isnan(value), value), dtype)
        else:
            shown = as_text(value, dtype)
        cells.append(F.coalesce(shown, F.lit("")).alias(field.name))
    return df.select(*cells)
