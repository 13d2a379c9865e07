"""Concatenation of sheets, de-duplication, set operations on names and rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_text, ident, is_numeric
from .clean import fill_missing, rewrite, stringify_keys


def align_types(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """Give a column that differs in type one type: double for numbers, else text."""
    kinds: dict[str, list] = {}
    for df in frames:
        for field in df.schema.fields:
            kinds.setdefault(field.name, []).append(field.dataType)
    mixed = {c: t for c, t in kinds.items() if len({d.simpleString() for d in t}) > 1}
    aligned = []
    for df in frames:
        changes: dict[str, Column] = {}
        for column in df.columns:
            if column in mixed:
                numeric = all(is_numeric(d) for d in mixed[column])
                dtype = df.schema[column].dataType
                changes[column] = ident(column).cast("double") if numeric else as_text(ident(column), dtype)
        aligned.append(rewrite(df, changes))
    return aligned


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name in first-appearance order; absent columns are null."""
    if not frames:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), align_types(frames))


def concat_sheets(sheets: Mapping[str, DataFrame], fill: str | None = "NA") -> DataFrame:
    """Sheets of one file below each other, tagged with ``source_sheet``."""
    tagged = [df.withColumn("source_sheet", F.lit(name)) for name, df in sheets.items()]
    merged = union_all(tagged)
    return merged if fill is None else fill_missing(merged, fill)


def concat_name(names: Sequence[str]) -> str:
    """``a+b.csv`` from the sheet names without their extensions."""
    return "+".join(n.rsplit(".", 1)[0] if "." in n.lstrip(".") else n for n in names) + ".csv"


def concat_project(sheets: Mapping[tuple[str, str], DataFrame | None]) -> DataFrame:
    """Sheets across files by (file, sheet): all text, missing cells ''.

    A pair without a frame (an unknown or unreadable sheet) is skipped.
    """
    tagged = []
    for (file_name, sheet_name), df in sheets.items():
        if df is not None:
            textual = stringify_keys(df, df.columns)
            tagged.append(
                textual.withColumn("source_file", F.lit(file_name)).withColumn("source_sheet", F.lit(sheet_name))
            )
    merged = union_all(tagged)
    return stringify_keys(merged, merged.columns)


def dedupe(df: DataFrame) -> DataFrame:
    """Distinct rows; nulls are equal."""
    return df.distinct()


def except_rows(expected: DataFrame, present: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``expected`` whose key is absent from ``present``."""
    keys = present.select(*[ident(c) for c in columns]).distinct()
    return expected.join(keys, list(columns), "left_anti")


def intersect_rows(wanted: DataFrame, present: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` whose key occurs in ``present``."""
    keys = present.select(*[ident(c) for c in columns]).distinct()
    return wanted.join(keys, list(columns), "left_semi")


def union_axes(x_axes: Column, y_axes: Column) -> Column:
    """Distinct columns a chart uses, x before y."""
    return F.array_union(x_axes, y_axes)
