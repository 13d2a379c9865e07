"""What the operators share: row keys, column names, small expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import saved, scratch_path  # noqa: F401

BLANKS = "\t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK_BYTES = b" \t\n\x0b\x0c\r"
IS_BLANK = np.isin(np.arange(256), list(BLANK_BYTES))


class Opened:
    """A table under plain column names, each row with a unique long ``key``.

    The key is the id itself where ids are integers, present and different.
    Otherwise rows are numbered in the order of (id, nulls last; text; the other
    columns), written to the shared folder so that the numbers stay: repeated
    rows are then documents of their own, and the later ones are copies.
    Input columns are called ``in_<position>``, so no name can clash. ``id_is_key``
    says which of the two it is.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str | None):
        self.names = docs.columns
        plain = docs.toDF(*[f"in_{i}" for i in range(len(self.names))])
        self.id = f"in_{self.names.index(id_col)}"
        self.text = f"in_{self.names.index(text_col)}" if text_col else None
        kind = plain.schema[self.id].dataType
        repeated = plain.groupBy(self.id).count().where(F.col(self.id).isNull() | (F.col("count") > 1))
        integers = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        self.id_is_key = integers and repeated.isEmpty()
        if self.id_is_key:
            self.df = plain.withColumn("key", F.col(self.id).cast("long"))
        else:
            sortable = [c for c in plain.columns if not isinstance(plain.schema[c].dataType, (T.MapType, T.VariantType))]
            order = [self.id, *([self.text] if self.text else []), *sortable]
            ranked = plain.orderBy(*[F.col(c).asc_nulls_last() for c in dict.fromkeys(order)])
            self.df = saved(ranked.withColumn("key", F.monotonically_increasing_id()))

    def closed(self, df: DataFrame, results: dict[str, Column], texts: Column | None = None) -> DataFrame:
        """Input columns under their names, then the results; a result takes
        the place of an input column of the same name."""
        kept = [
            (texts if texts is not None and f"in_{i}" == self.text else F.col(f"in_{i}")).alias(name)
            for i, name in enumerate(self.names)
            if name not in results
        ]
        return df.select(*kept, *[column.alias(name) for name, column in results.items()])


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def numbered_words(raw: bytes | bytearray, bounds: np.ndarray, more: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of texts that lie in ``raw`` from bound to bound, parted at ASCII white space
    and before each place of ``more``: the different ones, the number of each word in
    order (from 1 on), and the words of each text."""
    blank = IS_BLANK[np.frombuffer(raw, np.uint8)]
    cut = np.ones(len(raw) + 1, bool)
    cut[1:-1] = blank[1:] | blank[:-1]
    cut[bounds] = True
    if more is not None:
        cut[more] = True
    starts, stops = np.flatnonzero(cut[:-1] & ~blank), np.flatnonzero(cut[1:] & ~blank)
    ends = np.append(0, np.cumsum(stops + 1 - starts))
    letters = raw.translate(None, BLANK_BYTES)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy() + np.int32(1), np.diff(np.searchsorted(starts, bounds))


def parts_for(spark: SparkSession, amount: float, each: float) -> int:
    """Partitions so that each holds about ``each`` of an amount; at least as
    many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(amount / each))


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of this application from the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
