"""Hashed maximum-entropy language model: word classes by softmax over hashed
n-gram and skip features, words within their class by smoothed counts."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Opened, numbered_words, parts_for, saved
from .jaccard import MULTIPLIER, mixed

END = b""
TOP = 15
ENDINGS = 16
CLASSES = 1 + TOP + ENDINGS
FEATURES = 4
BATCH = 8192
BLOCK = 512
RATE = 0.5
ROWS_PER_ROOT = 80
LEAST_ROWS = 32_768
TOKENS_PER_ROOT = 4096
CHUNK_BYTES = 10 << 20


class Size(NamedTuple):
    """What training takes, by the counted tokens: rows of weights (32,768 at least) and
    tokens of a task follow the cube root, so that the changes all tasks send stay the
    same share of the input; averaging rounds follow the logarithm."""

    rows: int
    rounds: int
    task_tokens: int


def size_for(tokens: int) -> Size:
    root = math.ceil(max(tokens, 1) ** (1 / 3))
    rounds = max(2, round((math.log2(max(tokens, 1)) - 20) / 4))
    return Size(max(LEAST_ROWS, ROWS_PER_ROOT * root), rounds, TOKENS_PER_ROOT * root)


class Model(NamedTuple):
    """Most frequent words by class, weights (a row per hashed feature), bias of the classes."""

    top: dict[bytes, int]
    weights: np.ndarray
    bias: np.ndarray


def words_in(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of texts, the numbers of their words one after the other (from 1
    on; 0 is left to the end of a text), and the words of each text. Null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return pa.array([], pa.large_binary()), np.empty(0, np.int32), np.empty(0, np.int64)
    _, bounds, raw = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = bytes(memoryview(raw or b"")[bounds[0] : bounds[-1]]).lower()
    return numbered_words(low, bounds - bounds[0])


def kinds_of(words: pa.Array, top: dict[bytes, int]) -> np.ndarray:
    """Classes of words: a top word has its own, others share one by their ending."""
    endings = pc.binary_slice(words, -3).dictionary_encode()
    shared = np.array([1 + TOP + zlib.crc32(e) % ENDINGS for e in endings.dictionary.to_pylist()], np.int64)
    kinds = shared[endings.indices.to_numpy()]
    for word, kind in top.items():
        at = words.index(word).as_py()
        if at >= 0:
            kinds[at] = kind
    return kinds


def runs(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of texts of about ``most`` tokens; a text is never parted."""
    first = 0
    for last in np.flatnonzero(np.diff(np.cumsum(lengths) // most, append=-1)).tolist():
        yield slice(first, last + 1)
        first = last + 1


def placed(hashes: np.ndarray, rows: int) -> np.ndarray:
    """Hashes as row numbers below ``rows``."""
    return ((hashes >> np.uint64(32)) * np.uint64(rows) >> np.uint64(32)).astype(np.int64)


class Lexicon:
    """Hashes of numbered words, their class and the feature rows that one word
    decides; the end is number 0 and class 0."""

    def __init__(self, words: pa.Array, top: dict[bytes, int], rows: int):
        k = np.uint64(MULTIPLIER)
        self.rows = rows
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, [END, *words.to_numpy(zero_copy_only=False)]), np.uint64, len(words) + 1)
        self.lead = mixed(self.hashes + k) * k
        self.kinds = np.append(0, kinds_of(words, top))
        self.alone = [placed(mixed(self.hashes * k + np.uint64(i)), rows).astype(np.int32) for i in range(3)]


def laid_out(numbers: np.ndarray, lengths: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Tokens to predict (word numbers, an end after each text) and their features (one
    row each of ``FEATURES``): the last word, the last two, the second and the third last."""
    before = np.arange(len(lengths)) * 4 + 3
    row = np.zeros(len(numbers) + 4 * len(lengths), np.int32)
    row[np.arange(len(numbers)) + np.repeat(before, lengths)] = numbers
    target = np.ones(len(row), bool)
    starts = np.cumsum(lengths + 4) - lengths - 4
    for i in range(3):
        target[starts + i] = False
    at = np.flatnonzero(target)
    one, two, three = row[at - 1], row[at - 2], row[at - 3]
    pair = placed(mixed(lexicon.lead[one] + lexicon.hashes[two]), lexicon.rows).astype(np.int32)
    return row[at], np.stack([lexicon.alone[0][one], pair, lexicon.alone[1][two], lexicon.alone[2][three]])


def centred(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Sums of the weights of each token's features, less the largest of its classes."""
    z = np.take(weights, features[0], axis=0)
    for column in features[1:]:
        z += np.take(weights, column, axis=0)
    z += bias
    half = np.maximum(z[:, : CLASSES // 2], z[:, CLASSES // 2 :])
    z -= np.ascontiguousarray(half.T).max(axis=0)[:, None]
    return z


def log_chances(weights: np.ndarray, bias: np.ndarray, features: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each token's class."""
    z = centred(weights, bias, features)
    met = z[np.arange(len(z)), classes]
    return met - np.log(np.exp(z, out=z) @ np.ones(CLASSES, np.float32))


def summed(values: np.ndarray, at: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of ``values[at]`` by segments of ``at``, longest first: place by place while
    more than 64 have another place, what is left of those by slices."""
    sums = values.take(at[starts], axis=0)
    longer = np.flatnonzero(lengths > 1)
    longer = longer[np.argsort(-lengths[longer], kind="stable")]
    begins, sizes = starts[longer], lengths[longer]
    part = sums.take(longer, axis=0)
    places = int(sizes[64]) if len(sizes) > 64 else 1
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(places), side="right")
    for place in range(1, places):
        n = active[place]
        part[:n] += values.take(at[begins[:n] + place], axis=0)
    for i in np.flatnonzero(sizes > places).tolist():
        part[i] += values.take(at[begins[i] + places : begins[i] + sizes[i]], axis=0).sum(axis=0)
    sums[longer] = part
    return sums


def ordered(rows: np.ndarray, most: int) -> np.ndarray:
    """Stable order of row numbers below ``most``, 16 bits at a time."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    for shift in range(16, (most - 1).bit_length(), 16):
        order = order[np.argsort((rows >> shift).astype(np.uint16)[order], kind="stable")]
    return order


class Learner:
    """Gradient steps from given weights; each row's rate falls with its squared
    gradients so far."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, rate: float):
        self.weights, self.bias, self.rate = weights.copy(), bias.copy(), rate
        self.squares = np.ones(len(weights), np.float32)
        self.bias_squares = np.ones_like(bias)
        self.used = np.zeros(len(weights), np.float32)
        self.seen = 0

    def step(self, classes: np.ndarray, features: np.ndarray) -> None:
        slope = centred(self.weights, self.bias, features)
        np.exp(slope, out=slope)
        slope /= (slope @ np.ones(CLASSES, np.float32))[:, None]
        slope[np.arange(len(classes)), classes] -= 1
        total = slope.sum(axis=0)
        self.bias_squares += total * total
        self.bias -= self.rate * total / np.sqrt(self.bias_squares)
        flat = features.ravel()
        order = ordered(flat, len(self.weights))
        ranked = flat[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        rows, lengths = ranked[starts], np.diff(np.r_[starts, len(flat)])
        sums = summed(slope, order % len(classes), starts, lengths)
        squares = self.squares[rows] + np.einsum("ij,ij->i", sums, sums)
        self.squares[rows] = squares
        sums *= (self.rate / np.sqrt(squares))[:, None]
        self.weights[rows] = self.weights.take(rows, axis=0) - sums
        self.used[rows] += lengths

    def learn(self, classes: np.ndarray, features: np.ndarray) -> None:
        self.seen += len(classes)
        for i in range(0, len(classes), BATCH):
            self.step(classes[i : i + BATCH], features[:, i : i + BATCH])


def _vocabulary(docs: pa.Table) -> pa.Table:
    """Different words of a chunk of documents, with their count in its training
    texts; the empty word stands for the ends of those."""
    words, numbers, lengths = words_in(docs["text"])
    train = ~docs["held"].to_numpy()
    here = np.bincount(numbers[np.repeat(train, lengths)], minlength=len(words) + 1)
    here[0] = train.sum()
    listed = pa.concat_arrays([pa.array([END], pa.binary()), words.cast(pa.binary())])
    return pa.table({"chunk": pa.repeat(docs["chunk"][0], len(here)), "word": listed, "here": here})


def _gradients(model, rate: float):
    """One pass over this task's documents; what it changed, by block of rows, with
    how often each row was met. Words are numbered anew every 10 MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, weights, bias = model.value
        learner = Learner(weights, bias, rate)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy()
            for part in runs(sizes.astype(np.int64), CHUNK_BYTES):
                found, numbers, lengths = words_in(batch["text"][part])
                lexicon, stops = Lexicon(found, top, len(weights)), np.cumsum(lengths)
                for run in runs(lengths + 1, 300_000):
                    first = stops[run.start] - lengths[run.start]
                    words, features = laid_out(numbers[first : stops[run.stop - 1]], lengths[run], lexicon)
                    learner.learn(lexicon.kinds[words], features)
        if not learner.seen:
            return
        for block, first in enumerate(range(0, len(weights), BLOCK)):
            used = learner.used[first : first + BLOCK]
            if used.any():
                change = (learner.weights[first : first + BLOCK] - weights[first : first + BLOCK]).astype(np.float16)
                yield pa.record_batch({"block": pa.array([block], pa.int32()), "change": [change.tobytes()], "used": [used.tobytes()]})
        change, used = (learner.bias - bias).astype(np.float16), np.array([learner.seen], np.float32)
        yield pa.record_batch({"block": pa.array([-1], pa.int32()), "change": [change.tobytes()], "used": [used.tobytes()]})

    return run


def _averages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Changes of each block as the mean over tasks, weighted by use; a row at a time."""
    sums: dict[int, list[np.ndarray]] = {}
    for pdf in batches:
        for block, change, used in zip(pdf["block"], pdf["change"], pdf["used"], strict=True):
            weight = np.frombuffer(used, np.float32)
            part = np.frombuffer(change, np.float16).reshape(len(weight), -1) * weight[:, None]
            if block in sums:
                sums[block][0] += part
                sums[block][1] += weight
            else:
                sums[block] = [part, weight.copy()]
    means = [(x / np.maximum(w, 1)[:, None]).astype(np.float32).tobytes() for x, w in sums.values()]
    yield pd.DataFrame({"block": list(sums), "change": means}).astype({"block": "int32"})


def trained(docs: DataFrame, top: dict[bytes, int], tokens: int, rounds: int | None, fold: Column) -> Model:
    """Model after ``rounds`` rounds (by ``size_for`` if not given), each over its own
    share of the documents; all documents are learned from once."""
    spark = docs.sparkSession
    size = size_for(tokens)
    rounds = rounds or size.rounds
    model = Model(top, np.zeros((size.rows, CLASSES), np.float32), np.zeros(CLASSES, np.float32))
    tasks = tokens // rounds // size.task_tokens + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for number in range(rounds):
        sent = spark.sparkContext.broadcast(tuple(model))
        share = docs.where(fold % rounds == number).select("text").coalesce(tasks)
        changes = share.mapInArrow(_gradients(sent, RATE / (number + 1)), "block int, change binary, used binary")
        for block, change in changes.repartition(parts, "block").mapInPandas(_averages, "block int, change binary").collect():
            part = np.frombuffer(change, np.float32).reshape(-1, CLASSES)
            if block < 0:
                model.bias[:] += part[0]
            else:
                model.weights[block * BLOCK : (block + 1) * BLOCK] += part
        sent.unpersist()
    return model


class Totals(NamedTuple):
    """Training tokens, different ones, ends; tokens and different ones of each class."""

    tokens: int
    words: int
    ends: int
    class_tokens: np.ndarray
    class_words: np.ndarray


def _scored(model, totals: Totals):
    """Base and model scores of a chunk's documents. Counts of words that occur in
    other chunks as well are given, the others are taken here."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        top, weights, bias = model.value
        found, numbers, sizes = words_in(docs["text"])
        lexicon = Lexicon(found, top, len(weights))
        train = np.repeat(~docs["held"].to_numpy(), sizes)
        count = np.bincount(numbers[train], minlength=len(found) + 1)
        elsewhere = pc.index_in(words["word"].cast(pa.large_binary()), found)
        count[elsewhere.to_numpy() + 1] = words["n"].to_numpy()
        count[0] = totals.ends
        share = np.log10(count + 0.1)
        base_floor = np.log10(totals.tokens + 0.1 * (totals.words + 1))
        class_floor = np.log10(totals.class_tokens + 0.1 * (totals.class_words + 1))
        known, base, score = [], [], []
        ends = np.cumsum(sizes)
        for part in runs(sizes + 1, 100_000):
            lengths = sizes[part]
            at, features = laid_out(numbers[ends[part.start] - lengths[0] : ends[part.stop - 1]], lengths, lexicon)
            classes = lexicon.kinds[at]
            spans = [slice(i, i + BATCH) for i in range(0, len(at), BATCH)]
            logs = np.concatenate([log_chances(weights, bias, features[:, x], classes[x]) for x in spans]) / np.log(10)
            begins = np.cumsum(lengths + 1) - lengths - 1
            known.append(np.add.reduceat((count[at] > 0).astype(np.int64), begins))
            base.append(np.add.reduceat(share[at] - base_floor, begins))
            score.append(np.add.reduceat(logs + share[at] - class_floor[classes], begins))
        columns = {"n_known": (known, np.int64), "base_score": (base, np.float64), "score": (score, np.float64)}
        joined = {name: np.concatenate([np.empty(0, kind), *parts]) for name, (parts, kind) in columns.items()}
        return pa.table({"key": docs["key"], "n_tokens": sizes + 1, **joined})

    return run


def class_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_fold: int = 0, rounds: int | None = None
) -> DataFrame:
    """Log10 probability of each text under a language model of the other documents.

    Words (A-Z in lower case, parted at ASCII white space) and an end after each
    text are tokens. Documents whose crc32 of the id as text leaves ``held_fold``
    modulo ``folds`` are held out; a null id counts as remainder 0. The rest give
    the counts of all words, and train the classes: P(class | the three words
    before) is a softmax over hashed features (last word, last two, and the second
    and third last alone), learned in ``rounds`` rounds over different documents, in
    which tasks step on their own and their changes are averaged by use. The rows of
    weights grow with the cube root of the counted tokens, the rounds (if not given)
    with their logarithm (``size_for``). P(word |
    class) is its count plus 0.1, against the class's count plus 0.1 for each of
    its words and one unknown, so probabilities of all texts add up to one.
    Classes: the end, the 15 most frequent words, and 16 of the other words by
    their last three bytes; an unknown word has a class, too.

    Adds ``held_out n_tokens n_known train_tokens base_score score``. Null text is
    empty (an end alone). Repeated rows are documents each. With no training
    document all counts are 0. Results replace input columns of the same name.

    Texts are split into words once to count them, by chunks of 10 MB; a chunk is
    answered the counts of those of its words that occur in other chunks as well, so no
    vocabulary is held whole. A text is never parted: a very long one is a chunk's work
    in one task. The weights are broadcast: 128 bytes a row and 80 rows for each unit of
    the cube root (4 MB at least), 5 MB at 10^8 tokens and 220 MB at 10^13.
    """
    opened = Opened(docs, id_col, text_col)
    spark = docs.sparkSession
    code = F.coalesce(F.crc32(F.col(opened.id).cast("string").cast("binary")), F.lit(0))
    held = (code % folds) == held_fold
    base = opened.df.select("key", F.col(opened.text).alias("text"), held.alias("held"), F.floor(code / folds).alias("fold"))
    chunks = (base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK_BYTES + 1
    placed_docs = base.select("key", "text", "held", F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("chunk"))
    chunked = placed_docs.repartition(parts_for(spark, chunks, 1), "chunk")
    vocabulary = saved(chunked.groupBy("chunk").applyInArrow(_vocabulary, "chunk long, word binary, here long"))
    listed = saved(vocabulary.groupBy("word").agg(F.sum("here").alias("n"), F.count("*").alias("chunks")))
    counts = listed.where("n > 0")
    frequent = counts.where(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(TOP).select("word").collect()
    top = {bytes(r[0]): i + 1 for i, r in enumerate(frequent)}
    names = [F.lit(w) for w in top]
    other = (F.crc32(F.substring("word", -3, 3)) % ENDINGS + 1 + TOP).cast("int")
    kind = F.when(F.length("word") == 0, 0).otherwise(F.coalesce(F.array_position(F.array(*names), F.col("word")), F.lit(0)) if names else F.lit(0))
    kind = F.when((F.length("word") > 0) & (kind == 0), other).otherwise(kind)
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for number, n, v in counts.groupBy(kind.cast("int").alias("kind")).agg(F.sum("n"), F.count("*")).collect():
        class_tokens[number], class_words[number] = n, v
    totals = Totals(int(class_tokens.sum()), int(class_words.sum()), int(class_tokens[0]), class_tokens, class_words)
    tokens = totals.tokens
    model = spark.sparkContext.broadcast(tuple(trained(base.where(~F.col("held")), top, tokens, rounds, F.col("fold"))))
    # A chunk that has all occurrences of a word needs no answer.
    answers = vocabulary.join(listed.where("chunks > 1"), "word").where("n <> here AND length(word) > 0").select("chunk", "word", "n")
    fields = "key long, n_tokens long, n_known long, base_score double, score double"
    scored = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored(model, totals), fields)
    result = opened.df.join(scored.withColumnRenamed("key", "s_key"), F.col("key") == F.col("s_key"))
    return opened.closed(
        result,
        {
            "held_out": held,
            "n_tokens": F.col("n_tokens"),
            "n_known": F.col("n_known"),
            "train_tokens": F.lit(tokens).cast("long"),
            "base_score": F.col("base_score"),
            "score": F.col("score"),
        },
    )


def op5_maxent_scores(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return class_scores(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
