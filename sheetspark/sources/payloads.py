"""Sheets that arrive as JSON payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ident

_SHEET = "columns array<string>, data array<array<string>>"


def from_records(df: DataFrame, payload: str, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of payload texts as the named text columns, by header not position.

    A payload is ``{"columns": [...], "data": [[...]]}`` or a list of records.
    ``keep`` carries columns of the payload table along.
    """
    kept = [ident(c) for c in keep]
    sheet = F.from_json(ident(payload), _SHEET)
    records = F.from_json(ident(payload), "array<map<string,string>>")
    is_list = F.ltrim(ident(payload)).startswith("[")
    as_maps = F.transform(sheet["data"], lambda row: F.map_from_arrays(sheet["columns"], row))
    rows = df.select(*kept, F.explode(F.when(is_list, records).otherwise(as_maps)).alias("__row"))
    return rows.select(*kept, *[F.try_element_at("__row", F.lit(c)).alias(c) for c in columns])


def validate_payload(df: DataFrame, payload: str) -> DataFrame:
    """Add ``is_valid``: both parts are lists and every row has one cell per column."""
    sheet = F.from_json(ident(payload), _SHEET)
    fits = F.forall(sheet["data"], lambda row: F.size(row) == F.size(sheet["columns"]))
    valid = sheet["columns"].isNotNull() & sheet["data"].isNotNull() & F.coalesce(fits, F.lit(False))
    return df.withColumn("is_valid", F.coalesce(valid, F.lit(False)))
