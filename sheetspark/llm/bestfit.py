"""Packed token ids in binary: best-fit-decreasing with a segment tree over free space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Opened, scratch_path
from .tokens import word_ids


class FreeSpace:
    """Bins by free space, with a segment tree that finds the least space that is enough."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, space: int, number: int) -> None:
        self.bins[space].append(number)
        self._add(space, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A bin with the least free space of ``need`` or more, and that space."""
        space = self._first(need)
        if space is None:
            return None
        self._add(space, -1)
        return self.bins[space].pop(), space

    def _add(self, space: int, by: int) -> None:
        node = space + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def _first(self, need: int) -> int | None:
        node = need + self.width
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of positions, longest pieces first, each into the fullest bin that holds it."""
    space, bins = FreeSpace(size), []
    for at in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = space.take(lengths[at])
        if found is None:
            found = (len(bins), size)
            bins.append([])
        number, free = found
        bins[number].append(at)
        if free > lengths[at]:
            space.put(free - lengths[at], number)
    return bins


ROW = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<string>, starts array<long>"


def _packed(path: str | None, size: int, end_id: int, pad_id: int, pool_tokens: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(path)
        number = TaskContext.get().partitionId() << 36
        pool: list[tuple] = []
        held = 0

        def row(pieces: list[tuple]) -> tuple:
            nonlocal number
            ids = np.concatenate([x for _, _, x in pieces])
            stops = np.cumsum([len(x) for _, _, x in pieces]).tolist()
            whole = np.full(size, pad_id, "<u4")
            whole[: len(ids)] = ids
            number += 1
            return (number - 1, len(ids), whole.tobytes(), [0, *stops], [0, *stops[:-1]], [d for d, _, _ in pieces], [s for _, s, _ in pieces])

        def emptied(last: bool) -> list[tuple]:
            """Pack what is held; bins less than half full wait for more pieces."""
            nonlocal pool, held
            bins = best_fit_decreasing([len(x) for _, _, x in pool], size)
            full, rest = [], []
            for members in bins:
                pieces = [pool[i] for i in members]
                if last or 2 * sum(len(x) for _, _, x in pieces) >= size:
                    full.append(row(pieces))
                else:
                    rest += pieces
            pool, held = rest, sum(len(x) for _, _, x in rest)
            return full

        names = [f.split()[0] for f in ROW.split(", ")]
        for whole in batches:
            for start in range(0, len(whole), 500):
                pdf = whole.iloc[start : start + 500]
                done = []
                for doc, raw in zip(pdf["id"], words.encode(pdf["text"], end_id), strict=True):
                    ids = np.frombuffer(raw, "<u4")
                    for at in range(0, len(ids), size):
                        piece = ids[at : at + size]
                        if len(piece) == size:
                            done.append(row([(doc, at, piece)]))
                        else:
                            pool.append((doc, at, piece))
                            held += len(piece)
                if held >= pool_tokens:
                    done += emptied(False)
                if done:
                    yield pd.DataFrame(done, columns=names)
        done = emptied(True)
        for start in range(0, len(done), 1000):
            yield pd.DataFrame(done[start : start + 1000], columns=names)

    return run


def pack_best_fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4096,
    end_id: int = 2,
    pad_id: int = 0,
    tokenizer_path: str | None = None,
    pool_tokens: int = 2_000_000,
) -> DataFrame:
    """Sequences of ``size`` ids, one row each, for ``write_packed``.

    A document is its ids and ``end_id``. Longer ones are split at multiples of
    ``size``, without loss; whole pieces are sequences, the rest of each document
    is packed best-fit-decreasing with others of the same task, in pools of about
    ``pool_tokens``. Documents are not shuffled, and a task holds one pool.

    Rows: ``sequence_id n_tokens ids`` (32-bit little-endian, padded with
    ``pad_id``) ``cu_seqlens`` (0 and the end of each segment) ``position_resets``
    (where positions start again from 0) ``doc_ids starts`` (each segment's
    document, as text, and its place in the document). Null and empty texts are an
    end id alone; a null id is null; repeated rows are documents each.
    """
    opened = Opened(docs, id_col, text_col)
    texts = opened.df.select(F.col(opened.id).cast("string").alias("id"), F.col(opened.text).cast("binary").alias("text"))
    return texts.mapInPandas(_packed(tokenizer_path, size, end_id, pad_id, pool_tokens), ROW)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write sequences as a table of binary rows; one row is one line of the id matrix."""
    packed.write.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(path)


def segments(packed: DataFrame) -> DataFrame:
    """One row a segment: ``doc_id start length ids sequence_id offset``."""
    each = packed.select("sequence_id", "ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "starts")).alias("i", "of"))
    offset, stop = F.get("cu_seqlens", F.col("i")), F.get("cu_seqlens", F.col("i") + 1)
    return each.select(
        F.col("of.doc_ids").alias("doc_id"),
        F.col("of.starts").alias("start"),
        (stop - offset).cast("long").alias("length"),
        F.substring("ids", 4 * offset + 1, 4 * (stop - offset)).alias("ids"),
        "sequence_id",
        offset.cast("long").alias("offset"),
    )


def op7_packed_binary(spark, folder: str) -> DataFrame:
    """Documents packed, written, read again, and listed by segment."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    path = scratch_path(spark, "packed")
    write_packed(pack_best_fit(docs), path)
    listed = segments(read_packed(spark, path))
    return listed.select(
        F.col("doc_id").cast("long").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
