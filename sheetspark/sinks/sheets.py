"""CSV, Parquet and payload output; every write is distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..functions.text import ident, is_fractional
from ..operators.types import coerce_numeric
from ..sources.sheets import CSV_GRAMMAR


def _refuse_own_input(df: DataFrame, path: str) -> None:
    """An overwrite of a folder still being read would destroy its own input."""
    target = path.split("://")[-1].split(":", 1)[-1].rstrip("/")
    if any(f.split("://")[-1].split(":", 1)[-1].startswith(target + "/") for f in df.inputFiles()):
        raise ValueError(f"{path} is an input of this table; write to a new path")


_BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_sheet(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """Replace a CSV sheet; never one this table is read from."""
    _refuse_own_input(df, path)
    df.write.mode("overwrite").options(**CSV_GRAMMAR, **_BLANKS, encoding=encoding).csv(path)


def append_partitions(df: DataFrame, path: str, column: str) -> None:
    """Add CSV sheets to a folder, below one folder for each value of a column."""
    df.write.mode("append").partitionBy(column).options(**CSV_GRAMMAR, **_BLANKS).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    _refuse_own_input(df, path)
    df.write.mode("overwrite").parquet(path)


def export_sheet(df: DataFrame, path: str) -> DataFrame:
    """Numeric columns restored from text, then written; returns what was written."""
    restored = coerce_numeric(df)
    write_sheet(restored, path)
    return restored


def to_payload(df: DataFrame, order_by: Sequence[str | Column], cap: int | None = None) -> DataFrame:
    """(columns, row, total_rows, is_complete_data): rows as JSON-safe lists.

    All rows, or the first ``cap`` of the order where the caller names one; NaN
    and infinity are null.
    """
    safe = [
        (finite(ident(f.name)) if is_fractional(f.dataType) else ident(f.name)).alias(f.name) for f in df.schema.fields
    ]
    total = df.count()
    keys = [ident(c) if isinstance(c, str) else c for c in order_by]
    shown = df if cap is None else df.orderBy(*keys).limit(cap)
    row = F.to_json(F.struct(*safe), {"ignoreNullFields": "false"})
    return shown.select(
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        row.alias("row"),
        F.lit(total).cast("long").alias("total_rows"),
        F.lit(cap is None or total <= cap).alias("is_complete_data"),
    )


def result_record(df: DataFrame, output_path: str, source: str) -> DataFrame:
    """One row: counts, names and where a processed sheet was written."""
    return df.agg(F.count("*").alias("total_rows")).select(
        "total_rows",
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
        F.array_join(F.array(*[F.lit(c) for c in df.columns]), ",").alias("columns"),
        F.lit(output_path).alias("output_path"),
        F.lit(source).alias("file_processed"),
    )
