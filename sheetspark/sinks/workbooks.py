"""Workbooks written by tasks: a book for each value of a column, a sheet for each
value of another, rows in order."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import date, datetime
from math import isfinite
from uuid import uuid4
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ident
from ..session import saved
from ..sources.workbooks import opened_store

# Names and types of the parts of a workbook archive.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml."
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Characters that XML cannot hold.
_BARRED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")
_EPOCH = datetime(1899, 12, 30)
#: Number of the cell style that shows a date.
DATED = 1
#: Larger whole numbers are no numbers of a sheet; they are written as text.
EXACT = 1 << 53
_STYLES = (
    f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>'
)


def column_letters(number: int) -> str:
    """A, B, ... Z, AA of a column number from 0."""
    letters = ""
    number += 1
    while number:
        number, rest = divmod(number - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def _cell(place: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, date):
        moment = value.replace(tzinfo=None) if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
        return f'<c r="{place}" s="{DATED}"><v>{(moment - _EPOCH).total_seconds() / 86_400!r}</v></c>'
    if isinstance(value, float):
        return f'<c r="{place}"><v>{value!r}</v></c>' if isfinite(value) else ""
    if isinstance(value, int) and abs(value) <= EXACT:
        return f'<c r="{place}"><v>{value}</v></c>'
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(_BARRED.sub("", str(value)))}</t></is></c>'


def _row(number: int, values: Sequence) -> bytes:
    cells = "".join(_cell(f"{column_letters(i)}{number}", v) for i, v in enumerate(values))
    return f'<row r="{number}">{cells}</row>'.encode()


class _Writer:
    """One workbook, written sheet by sheet as its rows come."""

    def __init__(self, stream: io.RawIOBase, header: Sequence[str]):
        self.book = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
        self.header, self.names, self.part, self.number = header, [], None, 0

    def sheet(self, name: str) -> None:
        self._end_sheet()
        self.names.append(name)
        self.part = self.book.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
        self.part.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self.part.write(_row(1, self.header))
        self.number = 1

    def row(self, values: Sequence) -> None:
        self.number += 1
        self.part.write(_row(self.number, values))

    def _end_sheet(self) -> None:
        if self.part is not None:
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()

    def close(self) -> None:
        self._end_sheet()
        numbers = range(1, len(self.names) + 1)
        sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, self.names, strict=True))
        links = "".join(f'<Relationship Id="rId{i}" Type="{_LINK}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        links += f'<Relationship Id="rId{len(self.names) + 1}" Type="{_LINK}/styles" Target="styles.xml"/>'
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPES}worksheet+xml"/>' for i in numbers)
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINK}"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPES}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPES}styles+xml"/>{kinds}</Types>',
        }
        for name, body in parts.items():
            self.book.writestr(name, _HEAD + body)
        self.book.writestr("xl/styles.xml", _STYLES)
        self.book.close()


def _write(root: str, header: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = opened_store(root)
        writer = stream = name = held = None

        def finish() -> pa.RecordBatch:
            writer.close()
            stream.close()
            store.move(held, f"{folder}/{name}.xlsx")
            row = {"path": [f"{root}/{name}.xlsx"], "book": [name], "sheets": pa.array([len(writer.names)], pa.int32())}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for book, sheet, *values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if book != name or writer is None:
                    if writer is not None:
                        yield finish()
                    # Written aside and moved: an attempt that is lost leaves no book.
                    name, held = book, f"{folder}/.{uuid4().hex}.tmp"
                    stream = store.open_output_stream(held, compression=None)
                    writer = _Writer(stream, header)
                if not writer.names or writer.names[-1] != sheet:
                    writer.sheet(sheet)
                writer.row(values)
        if writer is not None:
            yield finish()

    return run


_CELLS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def write_workbooks(df: DataFrame, root: str, book: str | Column, sheet: str | Column, order_by: Sequence[str | Column]) -> DataFrame:
    """(path, book, sheets) of the workbooks written below ``root``: a file
    ``<book>.xlsx`` for each value of ``book``, with a sheet for each value of ``sheet``
    in order, a header row, and rows by ``order_by``.

    Numbers, booleans, dates and times are cells of their kind, everything else and
    whole numbers beyond 2^53 are text; null, NaN and infinite cells are left out, as
    are rows without book or sheet. A book is written by one task as its sorted rows
    stream through it; a path on a file system that tasks can open is needed.
    """
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)

    def column(c: str | Column) -> Column:
        return ident(c) if isinstance(c, str) else c

    cells = [(ident(f.name) if isinstance(f.dataType, _CELLS) else ident(f.name).cast("string")).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]
    keys = [column(k).alias(f"o{i}") for i, k in enumerate(order_by)]
    named = df.select(column(book).cast("string").alias("book"), column(sheet).cast("string").alias("sheet"), *cells, *keys)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = named.where("book is not null and sheet is not null").repartition(tasks, "book")
    ordered = spread.sortWithinPartitions("book", "sheet", *[f"o{i}" for i in range(len(keys))])
    kept = ordered.select("book", "sheet", *[f"c{i}" for i in range(len(cells))])
    return saved(kept.mapInArrow(_write(root, df.columns), "path string, book string, sheets int"))
