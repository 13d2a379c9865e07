"""CSV records over the splits of a file, for cells with line breaks.

Whether a line begins a record follows from the quotes before it in the file: an even
number, it does; an odd number, it goes on in a cell. A first pass adds up the quotes
of each split, a prefix sum over the splits of a file gives each one the state it
begins in, and then every split joins its own lines to records. Only the pieces at
split borders, two a split at most, are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import saved

RECORD, TAIL, HEAD, MIDDLE = 0, 1, 2, 3
LATIN = "ISO-8859-1"
_PIECES = "path string, start long, row long, kind int, first boolean, text string"
BATCH = 10_000


def _lines(spark: SparkSession, places: str | Sequence[str], options: dict) -> DataFrame:
    """Lines up to "\\n" with their split, as raw bytes in text columns; a "\\r" before
    the break stays."""
    lines = spark.read.options(lineSep="\n", **options).text(places if isinstance(places, str) else list(places))
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def open_quotes(line: Column) -> Column:
    """Whether a quote of the line is not closed in it: its cell has a line break."""
    return _quotes(line) % 2 == 1


def file_splits(spark: SparkSession, places: str | Sequence[str], **options) -> DataFrame:
    """A saved row for each split that has lines: its bytes' validity as utf-8, whether
    cells hold line breaks, whether a "\\r" stands alone, the first line, and whether
    the split begins inside a cell (``open``)."""
    value = F.col("value")
    found = (
        _lines(spark, places, options)
        .groupBy("path", "start")
        .agg(
            F.max("size").alias("size"),
            F.max("modified").alias("modified"),
            F.bool_and(F.is_valid_utf8(value)).alias("is_utf8"),
            F.bool_or(F.exists(F.split(value, "\r"), open_quotes)).alias("breaks"),
            F.bool_or(F.instr(F.regexp_replace(value, "\r$", ""), "\r") > 0).alias("lone"),
            (F.sum(_quotes(value)) % 2).alias("odd"),
            F.min_by("value", "row").alias("first_line"),
        )
    )
    # A window over the splits of a file: a row for each 128 MB or so of it.
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return saved(found.withColumn("open", F.coalesce(F.sum("odd").over(before) % 2 == 1, F.lit(False))))


def decoded(raw: Column, is_utf8: Column) -> Column:
    """Text of raw bytes: utf-8 where it is valid, else latin-1."""
    return F.when(is_utf8, raw).otherwise(F.decode(raw.cast("binary"), LATIN))


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    split = first = None
    held: list[str] = []
    begun, inside = 0, False

    def piece(kind: int) -> tuple:
        return (*split, begun, kind, first, "\n".join(held))

    def end_of_split() -> None:
        if held:
            out.append(piece(MIDDLE if inside else TAIL))

    for batch in batches:
        for path, start, row, starts_open, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (path, start) != split:
                end_of_split()
                split, held, inside, first = (path, start), [], starts_open, start == 0
            if not held:
                begun = row
                if not inside and text in ("", "\r"):
                    continue
            odd = text.count('"') % 2 == 1
            going = bool(held) or inside
            held.append(text)
            if going == odd:
                # Even and begun here, or odd and begun before: the record ends.
                out.append(piece(HEAD if inside else RECORD))
                held, inside, first = [], False, False
        if len(out) >= BATCH:
            yield _batch(out)
            out = []
    end_of_split()
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    names = ["path", "start", "row", "kind", "first", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def records(spark: SparkSession, places: str | Sequence[str], splits: DataFrame, encoding: str | None = None, **options) -> DataFrame:
    """(path, start, row, first, text): the records of files, with the place of their
    first line; ``first`` marks that of the file. Empty lines are no records.

    ``splits`` comes from :func:`file_splits` over the same files. Text is decoded by
    ``encoding``, or as utf-8 or latin-1 by file.
    """
    by_file = Window.partitionBy("path")
    # One row a split, far fewer than lines.
    states = F.broadcast(splits.select("path", "start", "open", F.min("is_utf8").over(by_file).alias("is_utf8")))
    value = F.col("value")
    text = F.decode(value.cast("binary"), encoding) if encoding else decoded(value, F.col("is_utf8"))
    lines = _lines(spark, places, options).join(states, ["path", "start"]).select("path", "start", "row", "open", text.alias("text"))
    pieces = saved(lines.mapInArrow(_join_lines, _PIECES))
    edges = pieces.where(F.col("kind") != RECORD)
    tail = F.col("kind") == TAIL
    # The pieces of a record follow its tail; a split's head comes before its tail.
    since = Window.partitionBy("path").orderBy("start", tail).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(tail, F.struct("start", "row", "first")), ignorenulls=True).over(since)
    parts = F.array_sort(F.collect_list(F.struct("start", "text")))
    joined = (
        edges.withColumn("owner", owner)
        .groupBy("path", "owner")
        .agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
        .select("path", "owner.start", "owner.row", "owner.first", "text")
    )
    whole = pieces.where(F.col("kind") == RECORD).select("path", "start", "row", "first", "text").unionByName(joined)
    return whole.withColumn("text", F.regexp_replace("text", "\r\\z", ""))
