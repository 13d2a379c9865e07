"""Document fingerprints of improbable features.

Every window of 32 bytes is a candidate. Its entropy gives a level, the corpus gives
the rarity of that level, and the windows that are the rarest of 32 neighbours often
enough become the features of the text. Features go into a chain of Bloom filters;
two texts are compared by the bits that their filters share beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import range_ordered, running
from .common import Opened, parts_for

WIDTH = 32
REACH = 32
POPULAR = 8
LEVELS = 1000
#: Windows below this level (runs of a few bytes) are taken only where nothing else is.
PLAIN = 100
BITS, HASHES, FULL = 2048, 5, 160
CHUNK = 1 << 16
GROUP = 1 << 20
PART_BYTES = 32 << 20
MOST_PARTS = 100_000

_SHIFT = 20
#: Sum over a window's byte values of count * log2(count), in steps of a level / 2^20.
_SUMS = np.array([round(c * math.log2(c or 1) / (WIDTH * math.log2(WIDTH)) * (LEVELS << _SHIFT)) for c in range(WIDTH + 1)], np.int32)
_STEP = np.diff(_SUMS, prepend=np.int32(0)).astype(np.int32)


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy of each window of ``WIDTH`` bytes, 0 to ``LEVELS``.

    A window's sum changes by what its first byte was worth and by what the next one
    is: both follow from how often that byte occurs within ``WIDTH`` places after and
    before it. The sums are integers, so equal windows have equal levels anywhere.
    """
    n = len(data)
    ahead, behind, same = np.ones(n, np.uint8), np.ones(n, np.uint8), np.empty(n, bool)
    for d in range(1, WIDTH):
        equal = np.equal(data[:-d], data[d:], out=same[: n - d]).view(np.uint8)
        ahead[:-d] += equal
        behind[d:] += equal
    sums = np.empty(n - WIDTH + 1, np.int32)
    sums[0] = _STEP[behind[:WIDTH]].sum()
    np.cumsum(_STEP[behind[WIDTH:]] - _STEP[ahead[:-WIDTH]], out=sums[1:])
    sums[1:] += sums[0]
    return ((LEVELS << _SHIFT) - sums) >> _SHIFT


class Joined:
    """Some texts in one buffer."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def whole(self, reach: int) -> np.ndarray:
        """Which places begin ``reach`` bytes of one text."""
        marks = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(marks, np.maximum(self.starts, self.ends - reach + 1), 1)
        np.add.at(marks, self.ends, -1)
        return np.cumsum(marks[:-1], out=marks[:-1]) == 0


def level_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each level."""
    joined, counts = Joined(texts), np.zeros(LEVELS + 1, np.int64)
    inside = joined.whole(WIDTH)
    for at in range(0, len(joined.data) - WIDTH + 1, CHUNK):
        found = levels(joined.data[at : at + CHUNK + WIDTH - 1])
        counts += np.bincount(found[inside[at : at + len(found)]], minlength=LEVELS + 1)
    return counts


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, the rarest first, plain ones after all others."""
    order = np.lexsort((np.arange(LEVELS + 1), counts, np.arange(LEVELS + 1) < PLAIN))
    ranks = np.empty(LEVELS + 1, np.uint32)
    ranks[order] = np.arange(LEVELS + 1, dtype=np.uint32)
    return ranks


def _popular(joined: Joined, ranks: np.ndarray) -> np.ndarray:
    """Places that are the leftmost rarest window of ``POPULAR`` runs or more of
    ``REACH`` neighbouring windows.

    Runs may reach over the ends of a text; places there, which are no windows of one
    text, are common without limit. There are ``WIDTH - 1`` of them between texts, so
    no run meets two texts, and the rarest window of a text is in ``REACH`` runs.
    """
    n, inside, chosen = len(joined.data), joined.whole(WIDTH), []
    none = np.uint32(len(ranks))
    bits = np.uint32((CHUNK + 3 * REACH).bit_length())
    for at in range(0, n, CHUNK):
        end, begin = min(at + CHUNK, n), at - REACH + 1
        lo, hi = max(0, begin), min(n - WIDTH + 1, end + REACH - 1)
        rank = np.full(end + REACH - 1 - begin, none)
        if hi > lo:
            rank[lo - begin : hi - begin] = np.where(inside[lo:hi], ranks[levels(joined.data[lo : hi + WIDTH - 1])], none)
        low = rank << bits | np.arange(len(rank), dtype=np.uint32)
        span = 1
        while span < REACH:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        places = (low & ((np.uint32(1) << bits) - np.uint32(1)))[low >> bits < none]
        popularity = np.bincount(places, minlength=len(rank))[at - begin : end - begin]
        chosen.append(at + np.flatnonzero(popularity >= POPULAR))
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _hashed(windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of ``WIDTH`` bytes."""
    words = np.ascontiguousarray(windows).view("<u8")
    out = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(words.shape[1]):
        out = (out ^ words[:, i]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def features(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the features, in the order of the texts.

    A text shorter than a window is its own feature; an empty one has none.
    """
    joined = Joined(texts)
    places = _popular(joined, ranks)
    owner = np.searchsorted(joined.ends, places, side="right")
    windows = np.lib.stride_tricks.sliding_window_view(joined.data, WIDTH)[places] if len(places) else np.zeros((0, WIDTH), np.uint8)
    hashes = _hashed(windows, np.full(len(places), WIDTH))
    short = np.flatnonzero((joined.sizes > 0) & (joined.sizes < WIDTH))
    if len(short):
        padded = np.frombuffer(b"".join(texts[i].ljust(WIDTH, b"\0") for i in short), np.uint8).reshape(-1, WIDTH)
        hashes = np.concatenate([hashes, _hashed(padded, joined.sizes[short])])
        owner = np.concatenate([owner, short])
    order = np.argsort(owner, kind="stable")
    return owner[order], hashes[order]


class Digest:
    """Chained filters of one text; every filter but the last holds ``FULL`` features."""

    __slots__ = ("n", "filters", "weights")

    def __init__(self, n: int, filters: np.ndarray):
        self.n, self.filters = n, filters
        self.weights = np.minimum(n - np.arange(len(filters)) * FULL, FULL)

    def __str__(self) -> str:
        return f"{self.n}:{base64.b64encode(self.filters.tobytes()).decode()}"


def digests(texts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    owner, hashes = features(texts, ranks)
    # A feature counts where it occurs first in its text.
    order = np.lexsort((np.arange(len(owner)), hashes, owner))
    o, h = owner[order], hashes[order]
    first = np.ones(len(o), bool)
    first[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    kept = np.sort(order[first])
    owner, hashes = owner[kept], hashes[kept]
    counts = np.bincount(owner, minlength=len(texts))
    place = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
    chains = -(-counts // FULL)
    begins = np.cumsum(chains) - chains
    row = begins[owner] + place // FULL
    table = np.zeros((int(chains.sum()), BITS), bool)
    for i in range(HASHES):
        table[row, (hashes >> np.uint64(11 * i) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(table, axis=1)
    return [Digest(int(n), packed[b : b + c]) for n, b, c in zip(counts, begins, chains, strict=True)]


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: how far the filters of the smaller digest are in the other one.

    Each filter of the digest with fewer features takes its best partner by the bits
    shared beyond chance, as a part of the bits that could be; overlaps within three
    deviations of chance (more among many partners) are none. Filters weigh as their features. Two empty digests
    are alike, an empty one is unlike any other.
    """
    if not a.n or not b.n:
        return float(a.n == b.n)
    if (b.n, b.filters.tobytes()) < (a.n, a.filters.tobytes()):
        a, b = b, a
    bits = np.bitwise_count(b.filters).sum(axis=1, dtype=np.int64)
    unsure = math.sqrt(9 + 2 * math.log(len(bits)))
    total = 0.0
    for one, weight in zip(a.filters, a.weights, strict=True):
        own = int(np.bitwise_count(one).sum(dtype=np.int64))
        shared = np.bitwise_count(b.filters & one).sum(axis=1, dtype=np.int64)
        most = np.minimum(bits, own)
        density = np.maximum(bits, own) / BITS
        chance = most * density
        beyond = shared - chance
        sure = beyond > unsure * np.sqrt(chance * (1 - density))
        total += weight * float(np.where(sure, beyond / (most - chance), 0.0).max())
    return min(1.0, total / a.n)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(LEVELS + 1, np.int64)
    for batch in batches:
        for texts in _groups(batch.column(0).to_pylist()):
            counts += level_counts(texts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS + 1)), pa.array(counts)], names=["level", "n"])


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _fingerprints(ranks: np.ndarray, schema: list[str]):
    def results(rows: list[tuple], prints: list[Digest]) -> pa.RecordBatch:
        """One result for each row but the last, which is only a next one here."""
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1]]
        changed = [edited(rows[i][2], rows[i + 1][2]).encode() for i in pairs]
        made = digests(changed, ranks)
        columns = [
            pa.array([rows[i][0] for i in pairs]),
            pa.array([len(rows[i][2]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(raw).hexdigest() for raw in changed], pa.string()),
            pa.array([str(prints[i]) for i in pairs], pa.string()),
            pa.array([str(d) for d in made], pa.string()),
            pa.array([likeness(prints[i], d) for i, d in zip(pairs, made, strict=True)], pa.float64()),
            pa.array([likeness(prints[i], prints[i + 1]) for i in pairs], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        prints: list[Digest] = []
        fresh: list[tuple] = []
        size = 0

        def flush():
            nonlocal rows, prints, fresh, size
            rows, prints = rows + fresh, prints + digests([r[2].encode() for r in fresh], ranks)
            out = results(rows, prints) if any(not r[1] for r in rows[:-1]) else None
            rows, prints, fresh, size = rows[-1:], prints[-1:], [], 0
            return out

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fresh.append(row)
                size += len(row[2])
                if size >= GROUP and (out := flush()) is not None:
                    yield out
        if fresh and (out := flush()) is not None:
            yield out

    return run


def _cuts(keyed: DataFrame) -> np.ndarray:
    """Largest keys of the parts of about equal bytes, descending; the first is the
    largest key of all. As many as there are parts, at most ``MOST_PARTS``."""
    sized = keyed.select("key", (F.octet_length("t") + WIDTH).cast("long").alias("size"))
    total = sized.agg(F.sum("size")).first()[0]
    if total is None:
        return np.zeros(0, np.int64)
    each = max(1, total // min(MOST_PARTS, parts_for(keyed.sparkSession, total, PART_BYTES)))
    places = running(range_ordered(sized, [F.desc("key")]), [], {"upto": ("sum", "size")})
    part = ((F.col("upto") - F.col("size")) / F.lit(each)).cast("long")
    return np.array(sorted(r[0] for r in places.groupBy(part.alias("part")).agg(F.max("key")).select("max(key)").collect())[::-1], np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id> n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next``.

    The fingerprint of a text is ``<features>:<base64 of its filters>``; the edited text
    is the text with its last half (rounded down, in code points) replaced by the
    beginning of the next document's, by descending id, the first being next to the last.

    One pass over the texts counts the windows of each level, a row of each level from
    each task. Then texts are shuffled once, into ranges of ids of about equal bytes;
    a range has its successor's first document as well, and streams in sorted order
    in groups of about a MB, so neither a range nor the table is held. The driver has the
    counts of 1,001 levels and the cuts of the ranges.

    Null texts are empty; an empty text has no features and the fingerprint ``0:``. Equal
    texts have equal fingerprints. Very long texts have a filter for each 160 features
    and are compared filter by filter. Where ids are no integers, missing or repeated,
    "next" follows the order of (id, nulls last; text; other columns) descending, and
    every row is a document; the id comes back as given. A single document is its own
    next. An empty table has no rows. Other columns are not read or returned.
    """
    opened = Opened(docs, id_col, text_col)
    keyed = opened.df.select("key", F.col(opened.id).alias("id"), F.coalesce(F.col(opened.text), F.lit("")).alias("t"))
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    more = T.StructType.fromDDL("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    schema = T.StructType([T.StructField("key", T.LongType()), *more.fields])
    cuts = _cuts(keyed)
    if not len(cuts):
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *more.fields]))
    counted = keyed.select(F.col("t").cast("binary")).mapInArrow(_counted, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    counts = np.zeros(LEVELS + 1, np.int64)
    for level, n in counted.collect():
        counts[level] = n
    parts, rising = len(cuts), cuts[::-1]

    # Twice the range of a key, and one more where the key is the first of its range.
    @F.pandas_udf("long")
    def place(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(rising, keys.to_numpy())
        return pd.Series(2 * (parts - 1 - at) + (rising[at] == keys.to_numpy()))

    to = F.shiftright(F.col("place"), 1)
    own, border = F.struct(to.alias("part"), F.lit(False).alias("border")), F.struct(F.pmod(to - 1, F.lit(parts)).alias("part"), F.lit(True).alias("border"))
    sides = F.when(F.col("place") % 2 == 1, F.array(own, border)).otherwise(F.array(own))
    dealt = keyed.withColumn("place", place("key")).select("key", "t", F.inline(sides))
    spread = dealt.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "border", F.desc("key"))
    result = spread.select("key", "border", "t").mapInArrow(_fingerprints(rarity(counts), schema.names), schema)
    if opened.id_is_key:
        return result.select(F.col("key").cast(docs.schema[id_col].dataType).alias(id_col), *names[1:])
    return opened.df.select("key", F.col(opened.id).alias(id_col)).join(result, "key").select(*[F.col(n) for n in names])


def op12_fingerprints(spark, folder: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
