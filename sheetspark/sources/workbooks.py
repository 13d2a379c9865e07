"""Workbooks in bulk: sheet lists and rows, read inside the tasks.

A workbook is an archive with a directory at its end. One pass reads the directories
and the sheet lists alone and plans a unit of work for each sheet part; then each
unit reads the byte ranges of its part and streams its rows. So the sheets of one
book are read by different tasks, small ones share a task, a sheet that is not asked
for is not read, and no file is held as a whole, whatever its size.
"""

from __future__ import annotations

import io
import re
import zipfile
from array import array
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import range_ordered, running
from ..session import saved

BATCH_ROWS = 10_000
#: Packed bytes of sheet parts that one task reads, about.
TASK_BYTES = 32 << 20
BUFFER = 1 << 20
#: File systems whose files tasks can open for ranged reads.
RANGED = {"file", "s3", "s3a", "s3n", "gs"}
# The built-in number formats that show a date or a time.
BUILT_IN_DATES = [14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47]
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, part path) in workbook order."""
    targets = {
        rel.get("Id"): rel.get("Target", "")
        for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    sheets = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
    parts = []
    for sheet in sheets:
        target = targets.get(sheet.get(_REL_ID), "")
        parts.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else "xl/" + target))
    return parts


def _texts(element) -> str:
    return "".join(t.text or "" for t in element.iter() if _local(t.tag) == "t")


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]*", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dated = set(BUILT_IN_DATES)
    for fmt in (e for e in root.iter() if _local(e.tag) == "numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", fmt.get("formatCode", ""))
        if re.search(r"[dmyhs]", code, re.IGNORECASE):
            dated.add(int(fmt.get("numFmtId")))
    formats = next((e for e in root if _local(e.tag) == "cellXfs"), ())
    return {i for i, style in enumerate(formats) if int(style.get("numFmtId", 0)) in dated}


def _number_text(value: str, is_date: bool, epoch: datetime) -> str:
    number = float(value)
    if is_date:
        return str(epoch + timedelta(milliseconds=round(number * 86_400_000)))
    return str(int(number)) if number == int(number) else repr(number)


class _Strings:
    """Shared strings in one buffer; a book may have millions of them."""

    def __init__(self, stream=None):
        buffer, ends = io.BytesIO(), array("q", [0])
        if stream is not None:
            holder = None
            for event, element in ElementTree.iterparse(stream, events=("start", "end")):
                holder = element if holder is None else holder
                if event == "end" and _local(element.tag) == "si":
                    buffer.write(_texts(element).encode("utf-8", "surrogatepass"))
                    ends.append(buffer.tell())
                    holder.clear()
        self.data, self.ends = buffer.getbuffer(), ends

    def __getitem__(self, i: int) -> str:
        return str(self.data[self.ends[i] : self.ends[i + 1]], "utf-8", "surrogatepass")


class _Book:
    """What the cells of one workbook refer to."""

    def __init__(self, book: zipfile.ZipFile):
        self.shared = _Strings()
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as stream:
                self.shared = _Strings(stream)
        self.dates = _date_styles(book)
        properties = (e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(e.tag) == "workbookPr")
        is_1904 = any(p.get("date1904") in ("1", "true") for p in properties)
        self.epoch = datetime(1904, 1, 1) if is_1904 else datetime(1899, 12, 30)

    def text(self, cell) -> str | None:
        """Cell as text: whole numbers without fraction, dates as ISO, errors null."""
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return _texts(cell)
        value = next((v.text for v in cell if _local(v.tag) == "v"), None)
        if value is None or kind == "e":
            return None
        if kind == "s":
            return self.shared[int(value)]
        if kind == "b":
            return "True" if value == "1" else "False"
        return _number_text(value, int(cell.get("s", 0)) in self.dates, self.epoch) if kind == "n" else value


def _sheet_rows(book: zipfile.ZipFile, part: str, known: _Book) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 0, cells) with skipped cells as null; streamed."""
    number, holder = -1, None
    with book.open(part) as stream:
        for event, element in ElementTree.iterparse(stream, events=("start", "end")):
            if event == "start":
                holder = element if _local(element.tag) == "sheetData" else holder
                continue
            if _local(element.tag) != "row":
                continue
            number = int(element.get("r")) - 1 if element.get("r") else number + 1
            cells: list[str | None] = []
            for cell in element:
                place = _column_number(cell.get("r") or "") if cell.get("r") else len(cells)
                cells.extend([None] * (place - len(cells)))
                cells.append(known.text(cell))
            element.clear()
            if holder is not None:
                holder.clear()
            yield number, cells


def _scheme(path: str) -> str:
    return path.split(":", 1)[0] if re.match(r"[a-z][a-z0-9+.-]*:", path) else "file"


def opened_store(path: str):
    """File system of a path as tasks open it, and the place in it."""
    from pyarrow import fs

    if _scheme(path) == "file":
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


@contextmanager
def _ranged(path: str) -> Iterator[zipfile.ZipFile]:
    """The archive at a path, of which only what is asked for is read."""
    store, place = opened_store(path)
    with store.open_input_file(place) as file, io.BufferedReader(file, BUFFER) as stream, zipfile.ZipFile(stream) as book:
        yield book


def _planned(path: str, book: zipfile.ZipFile) -> pd.DataFrame:
    """A row for each sheet of a book, with the packed size of its part."""
    parts = _sheet_parts(book)
    sizes = [book.getinfo(part).compress_size if part in book.NameToInfo else 0 for _, part in parts]
    return pd.DataFrame(
        {"path": path, "sheet_name": [n for n, _ in parts], "ordinal": range(len(parts)), "part": [p for _, p in parts], "size": sizes}
    )


_PLAN = "path string, sheet_name string, ordinal int, part string, size long"
_ROWS = "path string, sheet_name string, ordinal int, row_number long, cells array<string>"


def _plan(batches):
    for batch in batches:
        for row in batch.itertuples(index=False):
            if hasattr(row, "content"):
                with zipfile.ZipFile(io.BytesIO(row.content)) as book:
                    yield _planned(row.path, book)
            else:
                with _ranged(row.path) as book:
                    yield _planned(row.path, book)


def _sheet(book: zipfile.ZipFile, known: _Book, path: str, name: str, ordinal: int, part: str) -> Iterator[pd.DataFrame]:
    """Rows of one sheet, some at a time."""
    if part not in book.NameToInfo:
        return
    numbers, cells = [], []

    def frame() -> pd.DataFrame:
        return pd.DataFrame({"path": path, "sheet_name": name, "ordinal": ordinal, "row_number": numbers, "cells": cells})

    for number, row in _sheet_rows(book, part, known):
        numbers.append(number)
        cells.append(row)
        if len(numbers) == BATCH_ROWS:
            yield frame()
            numbers, cells = [], []
    if numbers:
        yield frame()


def _units(batches):
    """Rows of the planned sheets of a task; sheets of one book follow each other."""
    path, known = None, None
    for batch in batches:
        for row in batch.itertuples(index=False):
            with _ranged(row.path) as book:
                if row.path != path:
                    path, known = row.path, _Book(book)
                yield from _sheet(book, known, row.path, row.sheet_name, row.ordinal, row.part)


def _whole(wanted: list[str] | None) -> Callable:
    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    known = _Book(book)
                    for ordinal, (name, part) in enumerate(_sheet_parts(book)):
                        if wanted is None or name in wanted:
                            yield from _sheet(book, known, path, name, ordinal, part)

    return run


def _files(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, bool]:
    """The workbooks below some paths, and whether tasks can read ranges of them."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True)
    places = [paths] if isinstance(paths, str) else list(paths)
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    schemes = {_scheme(p) if ":" in p else _scheme(default) for p in places}
    return reader.load(places), schemes <= RANGED


def plan_workbooks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, sheet_name, ordinal, part, size): the sheet parts of every workbook.

    Reads the archive directories and sheet lists only, where ranges can be read.
    """
    files, ranged = _files(spark, paths)
    if not ranged:
        return files.select("path", "content").mapInPandas(_plan, _PLAN)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path").repartition(tasks).mapInPandas(_plan, _PLAN)


def list_sheets(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, sheet_name, ordinal) of every sheet of every workbook."""
    return plan_workbooks(spark, paths).select("path", "sheet_name", "ordinal")


def read_workbooks(
    spark: SparkSession, paths: str | Sequence[str], sheets: Sequence[str] | None = None, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """(path, sheet_name, ordinal, row_number, cells): all rows as text, or those of
    the named sheets. Row 0 holds the header of a sheet that has one.

    A sheet part is the unit of work: neighbouring units of a book, about
    ``task_bytes`` of packed bytes, make one task, a larger one is a task of its own. A task holds
    the shared strings of the book it reads. On file systems that tasks cannot open
    themselves, Spark reads each workbook as a whole.
    """
    files, ranged = _files(spark, paths)
    wanted = None if sheets is None else list(sheets)
    if not ranged:
        return files.select("path", "content").mapInPandas(_whole(wanted), _ROWS)
    planned = plan_workbooks(spark, paths)
    units = planned if wanted is None else planned.where(F.col("sheet_name").isin(wanted))
    placed = running(range_ordered(units, ["path", "ordinal"]), [], {"upto": ("sum", F.col("size") + 1)})
    before = F.col("upto") - F.col("size") - 1
    numbered = saved(placed.select("path", "sheet_name", "ordinal", "part", F.floor(before / task_bytes).cast("long").alias("unit")))
    groups = saved(numbered.select("unit").distinct())
    tasks = max(1, groups.count())
    dense = running(range_ordered(groups, ["unit"]), [], {"task": ("count", F.lit(1))}).select("unit", (F.col("task") - 1).cast("int").alias("task"))
    spread = numbered.join(dense, "unit").repartitionById(tasks, F.col("task")).sortWithinPartitions("path", "ordinal")
    return spread.select("path", "sheet_name", "ordinal", "part").mapInPandas(_units, _ROWS)


def sheet_table(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Workbook rows of sheets with one header, as named text columns."""
    cells = [F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)]
    return rows.where("row_number > 0").select("path", "sheet_name", "row_number", *cells)


def headers(rows: DataFrame) -> DataFrame:
    """(path, sheet_name, columns): header of each sheet; blanks are ``Unnamed: i``."""
    named = F.transform(
        "cells", lambda c, i: F.when(F.coalesce(c, F.lit("")) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(c)
    )
    return rows.where("row_number = 0").select("path", "sheet_name", named.alias("columns"))
