"""Removal of repeated byte strings: samples chosen by content, joined by 64-bit hashes
of them and of the bytes around them. No suffix is sorted and no rank is computed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Opened, parts_for
from .jaccard import MULTIPLIER, mixed

SAMPLE = 32
BUFFER = 1 << 18
MOST_CONTEXTS = 16
U = np.uint64
#: Odd base of the polynomial over bytes, and its inverse modulo 2^64.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int, made: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """The first n powers; the longest array made is kept."""
    if base not in made or len(made[base]) < n:
        out = np.full(max(n, 2 * BUFFER), base, U)
        out[0] = 1
        made[base] = np.multiply.accumulate(out)
    return made[base][:n]


class Texts:
    """Bytes of some documents in one buffer, with fingerprints of any range.

    Every string of ``length`` bytes has one sample in it, chosen by its bytes
    alone: the substring of ``SAMPLE`` bytes with the least hash, the leftmost of
    equal ones. So equal strings have equal samples at equal offsets. Strings that
    follow each other and share a sample are a run.
    """

    def __init__(self, parts: list[bytes], length: int):
        self.length = length
        self.sizes = np.array([len(x) for x in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        data = np.frombuffer(b"".join(parts), np.uint8)
        n = len(data)
        values = mixed(np.arange(256, dtype=U) + U(MULTIPLIER))
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values[data] * _powers(BASE, n), out=self.sums[1:])
        self.scale = _powers(INVERSE, n + 1)
        self.lo = self.hi = self.at = self.doc = np.zeros(0, np.int64)
        self.sample = self.context = np.zeros(0, U)
        if n >= length:
            self._runs(n)

    def marks(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of the ranges [start, end)."""
        return mixed((self.sums[end] - self.sums[start]) * self.scale[start] + (end - start).astype(U))

    def _runs(self, n: int) -> None:
        grams = mixed((self.sums[SAMPLE:] - self.sums[:-SAMPLE]) * self.scale[: n - SAMPLE + 1])
        bits = U(int(n).bit_length())
        low = grams >> bits << bits | np.arange(len(grams), dtype=U)
        width = self.length - SAMPLE + 1
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        at = (low & U((1 << int(bits)) - 1)).astype(np.int64)
        ok = np.zeros(len(at) + 1, bool)
        for s, e in zip(self.starts.tolist(), (self.starts + self.sizes - self.length + 1).tolist(), strict=True):
            if e > s:
                ok[s:e] = True
        ok = ok[:-1]
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)[: len(at)]
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        last = ok.copy()
        last[:-1] &= ~ok[1:] | new[1:]
        self.lo, self.hi = np.flatnonzero(new), np.flatnonzero(last)
        self.at, self.doc = at[self.lo], doc[self.lo]
        # Samples are least hashes; mixed once more they fill the buckets evenly.
        self.sample = mixed(grams[self.at] + U(MULTIPLIER))
        self.context = mixed(self.marks(self.lo, self.hi + self.length) + (self.at - self.lo).astype(U))


def _buffers(docs: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Documents in the order of their keys, in buffers of a quarter megabyte; yields
    the row numbers and the bytes."""
    order = np.argsort(docs["key"].to_numpy(), kind="stable")
    texts = docs["text"].tolist()
    rows, parts, size = [], [], 0
    for i in order:
        rows.append(i)
        parts.append(texts[i] or b"")
        size += len(parts[-1])
        if size >= BUFFER:
            yield np.array(rows), parts
            rows, parts, size = [], [], 0
    if rows:
        yield np.array(rows), parts


class Block:
    """All runs of a block of documents, in the order of (document, place)."""

    def __init__(self, docs: pd.DataFrame, length: int):
        self.keys = docs["key"].to_numpy()
        self.texts: list[tuple[np.ndarray, Texts]] = []
        self.parts: list[list[bytes]] = []
        samples, contexts, keys = [], [], []
        for rows, parts in _buffers(docs):
            texts = Texts(parts, length)
            self.texts.append((rows, texts))
            self.parts.append(parts)
            samples.append(texts.sample)
            contexts.append(texts.context)
            keys.append(self.keys[rows][texts.doc])
        self.sample = np.concatenate(samples) if samples else np.zeros(0, U)
        self.context = np.concatenate(contexts) if contexts else np.zeros(0, U)
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        # Runs with one sample and context are equal; the first of a block stands for them.
        order = np.lexsort((self.context, self.sample))
        s, c = self.sample[order], self.context[order]
        head = np.ones(len(order), bool)
        head[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(head) - 1
        self.first = order[head]
        self.group_sample, self.group_context = s[head], c[head]
        self.is_first = np.zeros(len(order), bool)
        self.is_first[self.first] = True
        top = np.ones(len(self.first), bool)
        top[1:] = self.group_sample[1:] != self.group_sample[:-1]
        self.sample_of_group = np.cumsum(top) - 1
        self.contexts_of_sample = np.bincount(self.sample_of_group) if len(top) else np.zeros(0, np.int64)

    def answered(self, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """By group: whether an earlier block has the run; whether its strings have to
        be told apart one by one."""
        seen = np.zeros(len(self.first), bool)
        apart = self.contexts_of_sample[self.sample_of_group] > 1 if len(self.first) else seen.copy()
        for samples, contexts, codes in zip(answers["a"], answers["b"], answers["codes"], strict=True):
            samples, contexts, codes = np.frombuffer(samples, U), np.frombuffer(contexts, U), np.frombuffer(codes, np.uint8)
            begin = np.searchsorted(self.group_sample, samples, "left")
            end = np.searchsorted(self.group_sample, samples, "right")
            for i, j, context, code in zip(begin.tolist(), end.tolist(), contexts, codes.tolist(), strict=True):
                if code & HEAVY:
                    apart[i:j] = True
                    continue
                at = i + int(np.searchsorted(self.group_context[i:j], context))
                if at < j and self.group_context[at] == context:
                    seen[at] |= not code & EARLIEST
                    apart[at] |= bool(code & SEVERAL)
        return seen, apart

    def strings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Strings of the chosen runs: fingerprint, key, buffer, place in the buffer."""
        out, begin = [], 0
        for number, (rows, texts) in enumerate(self.texts):
            n = len(texts.lo)
            picked = np.flatnonzero(chosen[begin : begin + n])
            begin += n
            lengths = texts.hi[picked] - texts.lo[picked] + 1
            place = np.repeat(texts.lo[picked] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            key = np.repeat(self.keys[rows][texts.doc[picked]], lengths)
            out.append((texts.marks(place, place + texts.length), key, np.full(len(place), number), place))
        if not out:
            return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


EARLIEST, SEVERAL, HEAVY = 1, 2, 4
SENT = "chunk long, bucket long, a binary, b binary, keys binary, codes binary"


def _bucketed(chunk: int, marks: np.ndarray, buckets: int, columns: list[np.ndarray]) -> pd.DataFrame:
    """Sorted marks cut into buckets by their upper bits, a row each."""
    if not len(marks):
        return pd.DataFrame(columns=["chunk", "bucket", "a", "b", "keys", "codes"])
    number = ((marks >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    edges = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    stops = np.r_[edges[1:], len(number)]
    rows = [[x[i:j].tobytes() for i, j in zip(edges, stops, strict=True)] for x in (marks, *columns)]
    frame = pd.DataFrame({"chunk": np.full(len(edges), chunk, np.int64), "bucket": number[edges]})
    for name, values in zip(("a", "b", "keys", "codes"), rows, strict=True):
        frame[name] = values
    return frame


def _ask_runs(length: int, buckets: int):
    """A block's different runs: sample, context, first document. A sample with many
    contexts is named once, as heavy."""

    def run(docs: pd.DataFrame) -> pd.DataFrame:
        block = Block(docs, length)
        heavy = (block.contexts_of_sample > MOST_CONTEXTS)[block.sample_of_group] if len(block.first) else np.zeros(0, bool)
        kept = ~heavy
        if len(heavy):
            kept |= heavy & np.r_[True, block.sample_of_group[1:] != block.sample_of_group[:-1]]
        codes = np.where(heavy, HEAVY, 0).astype(np.uint8)
        columns = [block.group_context[kept], block.key[block.first][kept], codes[kept]]
        return _bucketed(int(docs["chunk"].iloc[0]), block.group_sample[kept], buckets, columns)

    return run


def _by_bucket(judge):
    """Rows sorted by bucket, one bucket held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            for bucket, part in pdf.groupby("bucket", sort=False):
                if held and held[0]["bucket"].iloc[0] != bucket:
                    yield from judge(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield from judge(pd.concat(held))

    return run


def _unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    a = np.frombuffer(b"".join(rows["a"]), U)
    b = np.frombuffer(b"".join(rows["b"]), U)
    keys = np.frombuffer(b"".join(rows["keys"]), np.int64)
    codes = np.frombuffer(b"".join(rows["codes"]), np.uint8)
    source = np.repeat(np.arange(len(rows)), [len(x) // 8 for x in rows["a"]])
    return a, b, keys, codes, source


def _replies(rows: pd.DataFrame, source: np.ndarray, chosen: np.ndarray, a: np.ndarray, b: np.ndarray, codes: np.ndarray) -> Iterator[pd.DataFrame]:
    picked = np.flatnonzero(chosen)
    picked = picked[np.argsort(source[picked], kind="stable")]
    edges = np.flatnonzero(np.r_[True, source[picked][1:] != source[picked][:-1]]) if len(picked) else []
    stops = np.r_[edges[1:], len(picked)] if len(picked) else []
    chunks = rows["chunk"].to_numpy()
    out = [
        (chunks[source[picked[i]]], 0, a[picked[i:j]].tobytes(), b[picked[i:j]].tobytes(), b"", codes[picked[i:j]].tobytes())
        for i, j in zip(edges, stops, strict=True)
    ]
    if out:
        yield pd.DataFrame(out, columns=["chunk", "bucket", "a", "b", "keys", "codes"])


def _judge_runs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """For every run that other blocks share, or whose sample has several contexts:
    whether it is the earliest, and whether its strings have to be told apart."""
    a, b, keys, codes, source = _unpacked(rows)
    order = np.lexsort((keys, b, a))
    sa, sb = a[order], b[order]
    new_a = np.r_[True, sa[1:] != sa[:-1]] if len(sa) else np.zeros(0, bool)
    new = new_a | np.r_[True, sb[1:] != sb[:-1]] if len(sa) else new_a
    cls = np.cumsum(new_a) - 1
    size, contexts = np.bincount(cls), np.bincount(cls, weights=new)
    heavy = np.bincount(cls, weights=codes[order] & HEAVY) > 0
    several = (contexts > 1) | heavy
    out = np.zeros(len(a), np.uint8)
    out[order] = np.where(new, EARLIEST, 0) + np.where(several[cls], SEVERAL, 0)
    out = np.where(codes & HEAVY, HEAVY, out).astype(np.uint8)
    shared = np.zeros(len(a), bool)
    shared[order] = (size[cls] > 1) | heavy[cls]
    yield from _replies(rows, source, shared, a, b, out)


def _judge_strings(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Strings that an earlier block has."""
    a, b, keys, codes, source = _unpacked(rows)
    order = np.lexsort((keys, a))
    later = np.zeros(len(a), bool)
    later[order[1:]] = a[order][1:] == a[order][:-1]
    yield from _replies(rows, source, later, a, b, codes)


def _chosen(block: Block, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Runs that an earlier document or place has, and runs to take string by string."""
    seen, apart = block.answered(answers)
    repeated = ~block.is_first | seen[block.group] if len(block.group) else np.zeros(0, bool)
    return repeated, ~repeated & apart[block.group] if len(block.group) else repeated


def _heads(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by mark, then place; and in that order the first of each mark."""
    order = np.argsort(marks, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = marks[order][1:] != marks[order][:-1]
    return order, head


def _ask_strings(length: int, buckets: int):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame(columns=["chunk", "bucket", "a", "b", "keys", "codes"])
        block = Block(docs, length)
        marks, keys, _, _ = block.strings(_chosen(block, answers)[1])
        order, head = _heads(marks)
        kept = order[head]
        empty = np.zeros(len(kept), U)
        return _bucketed(int(docs["chunk"].iloc[0]), marks[kept], buckets, [empty, keys[kept], empty.astype(np.uint8)])

    return run


def _cut(length: int):
    """Ranges to remove from each document of a block, and the bytes that stay."""

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "id", "n_bytes", "n_removed", "starts", "ends", "kept"]
        if not len(docs):
            return pd.DataFrame(columns=names)
        block = Block(docs, length)
        kinds = answers["kind"].to_numpy() if len(answers) else np.zeros(0)
        repeated, apart = _chosen(block, answers[kinds == 0])
        marks, _, buffers, places = block.strings(apart)
        order, head = _heads(marks)
        later = np.ones(len(marks), bool)
        later[order[head]] = False
        told = [np.frombuffer(x, U) for x in answers[kinds == 1]["a"]]
        if told:
            later |= np.isin(marks, np.concatenate(told))
        ids = docs["id"].tolist()
        out, begin = [], 0
        for number, (rows, texts) in enumerate(block.texts):
            n = len(texts.lo)
            gone = np.flatnonzero(repeated[begin : begin + n])
            begin += n
            single = places[later & (buffers == number)]
            depth = np.zeros(int(texts.sizes.sum()) + 1, np.int64)
            np.add.at(depth, np.r_[texts.lo[gone], single], 1)
            np.add.at(depth, np.r_[texts.hi[gone] + length, single + length], -1)
            covered = np.cumsum(depth[:-1]) > 0
            parts = block.parts[number]
            for i, row in enumerate(rows.tolist()):
                s, size = int(texts.starts[i]), int(texts.sizes[i])
                mask = covered[s : s + size]
                removed = int(mask.sum())
                raw, starts, ends = parts[i], [], []
                if removed:
                    change = np.flatnonzero(np.diff(np.r_[False, mask, False]))
                    starts, ends = change[::2], change[1::2]
                    raw = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                out.append((block.keys[row], ids[row], size, removed, starts, ends, raw))
        return pd.DataFrame(out, columns=names)

    return run


def cut_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, block_bytes: int = 4_000_000, bucket_rows: int = 250_000
) -> DataFrame:
    """Take out every byte covered by a string of ``length`` bytes that also starts
    earlier, in a smaller document or before in the same one.

    Texts are UTF-8 bytes in blocks of about ``block_bytes``. Each string of
    ``length`` bytes holds one sample of 32 bytes, chosen by content, so two
    equal strings have it at the same offset; a run is the strings around one
    sample. Blocks send the hashes of their different runs to buckets by
    sample; a bucket is sorted by hash on its own, its ties (one sample) by the
    run's whole context. A run whose context an earlier one has is repeated as a
    whole. Where a sample has several contexts, the strings of the earliest run of
    each go through buckets once more, by their own hash. Every string is so
    compared with all others, and memory is one block or bucket. A sample with more
    than 16 contexts in a block takes the second way altogether, so no bucket holds
    more than 17 rows of a sample from each block.

    Returns ``id_col n_bytes n_removed span_starts span_ends kept`` (bytes); other
    columns are left out. Strings are judged on the input. Null text is empty.
    Repeated rows are documents each, the later ones copies. Equality is that of
    64-bit hashes.
    """
    opened = Opened(docs, id_col, text_col)
    spark = docs.sparkSession
    kind = opened.df.schema[opened.id].dataType.simpleString()
    texts = opened.df.select("key", F.col(opened.id).cast("string").alias("id"), F.col(opened.text).cast("binary").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = parts_for(spark, total, block_bytes)
    buckets = max(1, int(total * 0.03) // bucket_rows + 1)
    chunked = texts.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(blocks))).repartition(blocks, "chunk")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)

    def judged(asked: DataFrame, judge) -> DataFrame:
        return asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(_by_bucket(judge), SENT)

    of_runs = judged(chunked.groupBy("chunk").applyInPandas(_ask_runs(length, buckets), SENT), _judge_runs)
    asked = chunked.groupBy("chunk").cogroup(of_runs.groupBy("chunk")).applyInPandas(_ask_strings(length, buckets), SENT)
    of_strings = judged(asked, _judge_strings)
    answers = of_runs.withColumn("kind", F.lit(0)).union(of_strings.withColumn("kind", F.lit(1)))
    fields = "key long, id string, n_bytes long, n_removed long, starts array<int>, ends array<int>, kept binary"
    cut = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_cut(length), fields)
    return cut.select(
        F.col("id").cast(kind).alias(id_col), "n_bytes", "n_removed", F.col("starts").alias("span_starts"), F.col("ends").alias("span_ends"), "kept"
    )


def op10_suffix_dedup(spark, folder: str) -> DataFrame:
    cut = cut_repeats(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
