"""Sheet versions as snapshot folders and one manifest table.

A snapshot is written whole before its manifest row, so a reader that goes by
the manifest never sees part of one. A failed write leaves a folder no manifest
row names. A restored version is a manifest row that points to the older
snapshot; no data is copied. Two writers at once may take one ordinal: versions
are in the order of (ordinal, time, hash).
"""

from __future__ import annotations

from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.numbers import finite
from ..functions.text import as_text, ident, is_fractional
from ..operators.clean import fill_missing

VALUE_ERROR = "value error"
_MANIFEST = (
    "sheet string, ordinal long, hash string, parents array<string>, operation string, message string, committed_at timestamp, snapshot string"
)
_NEWEST = ["ordinal", "committed_at", "hash"]


def manifest(spark: SparkSession, root: str, sheet: str | None = None) -> DataFrame:
    """Versions of one sheet or of all; the sheet prunes the folders read."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException:
        rows = spark.createDataFrame([], _MANIFEST)
    return rows if sheet is None else rows.where(F.col("sheet") == sheet)


def _snapshot(root: str, version: str) -> str:
    return f"{root}/snapshots/version_id={version}"


def commit(df: DataFrame, root: str, sheet: str, operation: str, message: str = "", parent: str | None = None) -> str:
    """Write a new version of a sheet and return its hash."""
    version = uuid4().hex
    df.write.mode("errorifexists").parquet(_snapshot(root, version))
    return _record(df.sparkSession, root, sheet, version, version, operation, message, parent)


def _record(
    spark: SparkSession, root: str, sheet: str, version: str, snapshot: str, operation: str, message: str = "", parent: str | None = None
) -> str:
    """Add the manifest row of a version whose content is a snapshot."""
    newest = manifest(spark, root, sheet).orderBy(*[F.desc(c) for c in _NEWEST])
    latest = newest.select("ordinal", "hash").limit(1).collect()
    ordinal = latest[0]["ordinal"] + 1 if latest else 0
    parents = [parent] if parent else [latest[0]["hash"]] if latest else []
    row = (sheet, ordinal, version, parents, operation, message or f"{operation} - {sheet}", datetime.now(timezone.utc), snapshot)
    spark.createDataFrame([row], _MANIFEST).write.mode("append").partitionBy("sheet").parquet(f"{root}/manifest")
    return version


def as_of(spark: SparkSession, root: str, version: str, display: bool = False) -> DataFrame:
    """Content of a version; ``display`` gives text with "value error" for nulls."""
    named = manifest(spark, root).where(F.col("hash") == version).select(F.coalesce("snapshot", "hash")).limit(1).collect()
    df = spark.read.parquet(_snapshot(root, named[0][0] if named else version))
    if not display:
        return df
    cells = []
    for field in df.schema.fields:
        value = finite(ident(field.name)) if is_fractional(field.dataType) else ident(field.name)
        cells.append(F.coalesce(as_text(value, field.dataType), F.lit(VALUE_ERROR)).alias(field.name))
    return df.select(*cells)


def restore(spark: SparkSession, root: str, sheet: str, version: str, action: str = "undo") -> str:
    """New version that points to the content of an older one; needs two versions."""
    hashes = [r["hash"] for r in manifest(spark, root, sheet).select("hash").limit(2).collect()]
    if len(hashes) < 2:
        raise ValueError("no previous state available")
    known = manifest(spark, root, sheet).where(F.col("hash") == version).select(F.coalesce("snapshot", "hash")).limit(1).collect()
    if not known:
        raise ValueError(f"{version} is no version of {sheet}")
    return _record(spark, root, sheet, uuid4().hex, known[0][0], action)


def shown_after_restore(df: DataFrame) -> DataFrame:
    """Restored content as displayed: nulls and infinity are "NA"."""
    return fill_missing(df)


def replace_sheet(
    spark: SparkSession, root: str, sheet: str, columns: list[str], data: list[list] | DataFrame
) -> str:
    """Full overwrite by a payload of columns and rows, as version ``updated``."""
    if not isinstance(columns, list) or not isinstance(data, (list, DataFrame)):
        raise TypeError("columns and data must be lists")
    if isinstance(data, DataFrame):
        frame = data.toDF(*columns)
    else:
        if any(len(row) != len(columns) for row in data):
            raise ValueError("every row needs one cell per column")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        frame = spark.createDataFrame([tuple(None if v is None else str(v) for v in row) for row in data], schema)
    return commit(frame, root, sheet, "updated")
