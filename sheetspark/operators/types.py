"""What a column holds: sniffed types, numeric restore, type labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers
from ..functions.text import ident, is_error_token, is_fractional, is_numeric, is_temporal
from .clean import rewrite


def dtype_label(dtype: T.DataType) -> str:
    """int, float, bool, datetime or str."""
    if isinstance(dtype, T.IntegralType):
        return "int"
    if is_fractional(dtype) or isinstance(dtype, T.DecimalType):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return "datetime" if is_temporal(dtype) else "str"


def eda_label(dtype: T.DataType) -> str:
    """numerical, datetime or categorical; booleans count as numerical."""
    if is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        return "numerical"
    return "datetime" if is_temporal(dtype) else "categorical"


def column_types(df: DataFrame) -> dict[str, str]:
    return {f.name: dtype_label(f.dataType) for f in df.schema.fields}


def value_kind(value: Column) -> Column:
    """int, float or str of one text: digits with at most one dot are numbers."""
    return (
        F.when(value.rlike(r"^\d+$"), "int")
        .when(value.rlike(r"^(\d+\.\d*|\.\d+)$"), "float")
        .otherwise("str")
    )


def long_rows(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """The fields of each struct in ``structs`` as one row, from a one-row frame."""
    return df.select(F.inline(F.array(*structs)))


def sniff_types(df: DataFrame, order_by: str | Column) -> DataFrame:
    """(column, column_type): kind of the first non-empty cell that is no error text."""
    order = ident(order_by) if isinstance(order_by, str) else order_by
    skip = order_by if isinstance(order_by, str) else None
    columns = [c for c in df.columns if c != skip and not c.startswith("__")]
    firsts = []
    for i, column in enumerate(columns):
        value = ident(column).cast("string")
        usable = (value != "") & ~is_error_token(value)
        firsts.append(F.min_by(F.when(usable, value), F.when(usable, order)).alias(f"v{i}"))
    row = df.agg(*firsts)
    return long_rows(
        row,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.when(F.col(f"v{i}").isNull(), "Unknown").otherwise(value_kind(F.col(f"v{i}"))).alias("column_type"),
            )
            for i, c in enumerate(columns)
        ],
    )


BOOLEAN_TEXTS = ["True", "False", "TRUE", "FALSE", "true", "false"]


def _restore_types(df: DataFrame, columns: Sequence[str] | None, booleans: bool) -> DataFrame:
    """Types of text columns by one aggregate over all of them."""
    texts = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)
    ]
    if not texts:
        return df
    checks = []
    for i, column in enumerate(texts):
        number = numbers.to_number(ident(column))
        digits = ident(column).rlike(r"^\s*[+-]?\d+\s*$")
        whole = digits & F.trim(ident(column)).try_cast("long").isNotNull()
        checks += [
            F.count(ident(column)).alias(f"n{i}"),
            F.count(number).alias(f"d{i}"),
            F.count_if(whole).alias(f"l{i}"),
            F.count_if(digits & F.trim(ident(column)).try_cast("decimal(38,0)").isNotNull()).alias(f"e{i}"),
            F.count_if(ident(column).isin(BOOLEAN_TEXTS)).alias(f"b{i}"),
        ]
    row = df.agg(*checks).first()
    changes = {}
    for i, column in enumerate(texts):
        known = row[f"n{i}"]
        if known and row[f"l{i}"] == known:
            changes[column] = F.trim(ident(column)).try_cast("long")
        elif booleans and known and row[f"e{i}"] == known:
            # Whole numbers of which some need more than 64 bits stay exact.
            changes[column] = F.trim(ident(column)).try_cast("decimal(38,0)")
        elif known and row[f"d{i}"] == known:
            changes[column] = numbers.to_number(ident(column))
        elif known and booleans and row[f"b{i}"] == known:
            changes[column] = F.lower(ident(column)) == "true"
    return rewrite(df, changes)


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns become numbers where every non-null cell is one.

    One aggregate decides for all columns; whole numbers become longs.
    """
    return _restore_types(df, columns, booleans=False)


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Like :func:`coerce_numeric`, and columns of true/false become booleans; whole
    numbers of which some do not fit a long become decimals of 38 digits."""
    return _restore_types(df, columns, booleans=True)
