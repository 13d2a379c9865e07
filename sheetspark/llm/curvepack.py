"""Packing along a space-filling curve: neighbouring documents share sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Opened, parts_for, saved
from .tokens import word_ids

FEATURES = 1024
DIMENSIONS = 4
BITS = 12
FRAME_BYTES = 1 << 20


def _signs() -> np.ndarray:
    """Fixed random directions: +1 or -1 for each feature and dimension."""
    x = np.arange(1, FEATURES * DIMENSIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (((x >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1).reshape(FEATURES, DIMENSIONS)


def _features(ids: np.ndarray) -> np.ndarray:
    """Hashed token vector of a document: square roots of counts, of length 1."""
    slots = (ids * np.uint32(2654435761)) >> np.uint32(32 - 10)
    vector = np.sqrt(np.bincount(slots, minlength=FEATURES))
    return vector / np.sqrt(max(len(ids), 1))


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (row of whole numbers under 2^bits) on the Hilbert curve."""
    axes = [column.astype(np.int64) for column in points.T]
    n = len(axes)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            upper = (axes[i] >> level) & 1 == 1
            swap = np.where(upper, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(upper, axes[0] ^ low, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap
    for i in range(1, n):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((axes[n - 1] >> level) & 1 == 1, turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> level) & 1)
    return key


def _placed(path: str | None, end_id: int):
    """Ids as they are kept between the two passes: two bytes each where the
    vocabulary allows, else four."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, signs = word_ids(path), _signs()
        kind = words.kind(end_id)

        def frame(pdf: pd.DataFrame, points: list, kept: list) -> pd.DataFrame:
            scaled = np.floor((np.array(points) + 4) / 8 * (1 << BITS)).clip(0, (1 << BITS) - 1)
            width = np.full(len(kept), np.dtype(kind).itemsize, np.int32)
            return pd.DataFrame({"key": pdf["key"].to_numpy(), "id": pdf["id"].to_numpy(), "curve": hilbert_keys(scaled, BITS), "ids": kept, "width": width})

        for pdf in batches:
            points, kept, held, first = [], [], 0, 0
            for last, raw in enumerate(words.encode(pdf["text"], end_id), 1):
                ids = np.frombuffer(raw, "<u4")
                points.append(_features(ids) @ signs)
                kept.append(ids.astype(kind).tobytes())
                held += len(kept[-1])
                if held >= FRAME_BYTES or last == len(pdf):
                    yield frame(pdf.iloc[first:last], points, kept)
                    points, kept, held, first = [], [], 0, last

    return run


def powers(total: int) -> list[int]:
    """Powers of two that add up to the total, largest first."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


class _Sequences:
    """Cuts a stream of documents into sequences; only one is open at a time."""

    def __init__(self, size: int, first: int):
        self.size, self.number = size, first
        self.open: list[tuple] = []
        self.used = 0
        self.done: list[tuple] = []

    def add(self, doc, curve: int, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while at < total:
            take = min(total - at, self.size - self.used)
            self.open.append((doc, at, ids[4 * at : 4 * (at + take)], total, curve))
            self.used += take
            at += take
            if self.used == self.size:
                self._close(self.open)
                self.open, self.used = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total, curve in pieces:
            self.done.append((doc, start, len(ids) // 4, ids, total, curve, self.number, offset))
            offset += len(ids) // 4
        self.number += 1

    def finish(self) -> None:
        """What is left goes into sequences of powers of two, which need no padding."""
        rest, self.open = self.open, []
        for size in powers(self.used):
            taken = []
            while size:
                doc, start, ids, total, curve = rest.pop(0)
                n = min(size, len(ids) // 4)
                taken.append((doc, start, ids[: 4 * n], total, curve))
                if 4 * n < len(ids):
                    rest.insert(0, (doc, start + n, ids[4 * n :], total, curve))
                size -= n
            self._close(taken)
        self.used = 0


PIECE = ["id", "start", "length", "ids", "doc_tokens", "curve", "sequence_id", "offset"]


def _packed(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _Sequences(size, TaskContext.get().partitionId() << 36)
        for pdf in batches:
            for doc, curve, ids, width in zip(pdf["id"], pdf["curve"], pdf["ids"], pdf["width"], strict=True):
                out.add(doc, curve, np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
                if len(out.done) >= 1000:
                    yield pd.DataFrame(out.done, columns=PIECE)
                    out.done = []
        out.finish()
        yield pd.DataFrame(out.done, columns=PIECE)

    return run


def pack_along_curve(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4096,
    end_id: int = 2,
    tokenizer_path: str | None = None,
    part_tokens: int = 8_000_000,
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``size`` tokens.

    A document's ids (closed by ``end_id``) give a hashed vector of 1,024 features,
    projected to four dimensions by fixed random signs; the cell of that point on
    a Hilbert curve of 12 bits per dimension is its key. Documents are
    range-partitioned and sorted by (key, document), and each partition is cut
    into sequences as it streams by, holding one open sequence. The rest of a
    partition goes into sequences of powers of two, so nothing is padded.

    Returns one row a piece: ``id_col start length ids doc_tokens curve sequence_id
    offset`` (ids 32-bit little-endian). Null and empty text: the end id alone.
    Repeated rows are documents each. Other columns are left out. Tokens are
    written once to the shared folder, so finding the ranges tokenizes nothing
    again.
    """
    opened = Opened(docs, id_col, text_col)
    spark = docs.sparkSession
    kind = opened.df.schema[opened.id].dataType.simpleString()
    texts = opened.df.select("key", F.col(opened.id).cast("string").alias("id"), F.col(opened.text).cast("binary").alias("text"))
    placed = saved(texts.mapInPandas(_placed(tokenizer_path, end_id), "key long, id string, curve long, ids binary, width int"))
    tokens = placed.agg(F.sum(F.length("ids") / F.col("width"))).first()[0] or 0
    parts = parts_for(spark, tokens, part_tokens)
    ranged = placed.repartitionByRange(parts, "curve", "key").sortWithinPartitions("curve", "key")
    fields = "id string, start long, length long, ids binary, doc_tokens long, curve long, sequence_id long, offset long"
    pieces = ranged.select("id", "curve", "ids", "width").mapInPandas(_packed(size), fields)
    return pieces.select(F.col("id").cast(kind).alias(id_col), *PIECE[1:])


def op4_curve_packing(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    pieces = pack_along_curve(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
