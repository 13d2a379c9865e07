"""Line dedup by pairwise alignment: partners through shared line hashes, patience
diff and an exact comparison of what it leaves, and deletion of common blocks from
the later document."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, Opened, saved
from .jaccard import MULTIPLIER, mixed
from .quality import without_lines


def _unique_matches(a: Sequence, b: Sequence, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines that occur once in either range, as the longest rising chain of (a, b)."""
    once_a: dict = {}
    for i in range(a0, a1):
        once_a[a[i]] = -1 if a[i] in once_a else i
    once_b: dict = {}
    for j in range(b0, b1):
        once_b[b[j]] = -1 if b[j] in once_b else j
    pairs = [(once_a[x], j) for x, j in once_b.items() if j >= 0 and once_a.get(x, -1) >= 0]
    pairs.sort(key=lambda p: p[1])
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = [-1] * len(pairs)
    for n, (i, _) in enumerate(pairs):
        at = bisect_left(tops, i)
        back[n] = ends[at - 1] if at else -1
        if at == len(tops):
            tops.append(i)
            ends.append(n)
        else:
            tops[at], ends[at] = i, n
    chain = []
    n = ends[-1] if ends else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    return chain[::-1]


def patience(a: Sequence, b: Sequence, b_from: int = 0, b_to: int | None = None) -> list[tuple[int, int]]:
    """Aligned pairs (position in a, position in b) by patience diff, for a range of b.

    Equal ends of a range are matched first, then lines that are unique in both
    ranges; what lies between matches is aligned in the same way.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), b_from, len(b) if b_to is None else b_to)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        chain = _unique_matches(a, b, a0, a1, b0, b1)
        if not chain:
            continue
        for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
            if i2 < a1 or j2 < b1:
                found.append((i2, j2))
            if i + 1 < i2 and j + 1 < j2:
                todo.append((i + 1, i2, j + 1, j2))
    return sorted(set(found), key=lambda p: p[1])


def runs_of(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs of lines with ``least`` words or more: one
    from each line onwards and one up to each line, where there is one.

    Any run of ``least`` words or more is the union of those of them inside it.
    """
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    n = len(words)
    onward = np.searchsorted(total, total[:-1] + least)
    back = np.searchsorted(total, total[1:] - least, side="right") - 1
    starts = np.concatenate([np.arange(n)[onward <= n], back[back >= 0]])
    ends = np.concatenate([onward[onward <= n], np.arange(1, n + 1)[back >= 0]])
    found = np.unique(starts * (n + 1) + ends)
    return found // (n + 1), found % (n + 1)


def _common_lines(a: Sequence, b: Sequence, words: Sequence[int], least: int) -> np.ndarray:
    """Which lines of b are inside a run of ``least`` words or more that a has too,
    however often either side has it."""
    sizes = dict(zip(b, words, strict=True))
    # A line that b has not ends every run, which can then equal none of b.
    held = {tuple(a[s:e]) for s, e in zip(*runs_of(np.array([sizes.get(x, least) for x in a]), least), strict=True)}
    marks = np.zeros(len(b) + 1, np.int64)
    for s, e in zip(*runs_of(np.array(words), least), strict=True):
        if tuple(b[s:e]) in held:
            marks[s] += 1
            marks[e] -= 1
    return np.cumsum(marks)[:-1] > 0


def common_blocks(a: Sequence, b: Sequence, words: Sequence[int], least: int) -> list[tuple[int, int]]:
    """Blocks [start, end) of b made of runs of ``least`` words or more that a has.

    Runs aligned by patience diff come first. It leaves out moved runs and lines that
    a range repeats, so where any line of a is left, all runs are compared by their
    hashes. Of ``words``, equal lines have equal numbers.
    """
    known = set(a)
    shared = np.array([x in known for x in b], bool)
    words = np.asarray(words, np.int64)
    if words[shared].sum() < least:
        return []
    gone = np.zeros(len(b), bool)
    run, last = 0, (-2, -2)
    total = np.concatenate([[0], np.cumsum(words)])
    for i, j in [*patience(a, b), (-2, -2)]:
        if last != (i - 1, j - 1):
            if last[1] >= 0 and total[last[1] + 1] - total[run] >= least:
                gone[run : last[1] + 1] = True
            run = j
        last = (i, j)
    if (shared & ~gone).any():
        gone |= _common_lines(a, b, words.tolist(), least)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2], strict=True)]


def run_hashes(hashes: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Different hashes of the runs of ``runs_of`` that have two lines or more."""
    starts, ends = runs_of(words, least)
    starts, ends = starts[ends > starts + 1], ends[ends > starts + 1]
    power = np.full(len(hashes), MULTIPLIER, np.uint64)
    power[:1] = 1
    terms = mixed(hashes.view(np.uint64)) * np.cumprod(power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    power[1:] = pow(MULTIPLIER, -1, 1 << 64)
    return np.unique(mixed((total[ends] - total[starts]) * np.cumprod(power)[starts])).view(np.int64)


def _with_runs(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["k"] = [run_hashes(h.astype(np.int64), w, least) for h, w in zip(pdf["h"], pdf["w"], strict=True)]
            yield pdf

    return run


def _aligned(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, starts, ends = [], [], []
            for key, h, w, p, earlier in zip(pdf["key"], pdf["h"], pdf["w"], pdf["p"], pdf["earlier"], strict=True):
                for s, e in common_blocks(earlier.tolist(), h.tolist(), w.tolist(), least):
                    keys.append(key)
                    starts.append(int(p[s]))
                    ends.append(int(p[e - 1]))
            yield pd.DataFrame({"key": keys, "start": starts, "end": ends}).astype({"key": "int64", "start": "int32", "end": "int32"})

    return run


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = 20, rare_lines: int = 50
) -> DataFrame:
    """Delete from each document the blocks of lines that an earlier one has.

    Lines are compared with A-Z in lower case and white space runs as one blank;
    lines without a word are left out of the comparison. The partner of a
    document for a line is the earliest document with that line, so a line shared
    by m documents makes m - 1 partners, not m * m. Partners are aligned if they
    share a line that occurs ``rare_lines`` times or less in the corpus, or lines
    of ``block_words`` words together. The shortest runs of lines that reach
    ``block_words`` words find partners in the same way, each its earliest holder,
    so every line of a run that any earlier document has gets a partner that has it
    in a run. Runs of lines with ``block_words`` words or more that both have go
    from the later document, however often either of them repeats a run, judged on
    the input; the earliest holder of a line always keeps it.

    Documents are in the order of their ids (of ``Opened.key``). Adds ``n_lines``
    (lines with a word) ``n_removed_lines n_blocks clean_text``. Null text has no
    lines and stays null; repeated rows are documents, the later ones copies; a
    copy loses all its lines if it has ``block_words`` words. Results replace input
    columns of the same name.
    """
    opened = Opened(docs, id_col, text_col)
    text = F.col(opened.text)
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    one = F.regexp_replace(low, "[\\x20\\x09\\x0B-\\x0D]+", " ")
    lines = F.filter(
        F.transform(F.split(one, "\n"), lambda line, i: F.struct(F.trim(line).alias("t"), i.alias("p"))), lambda e: e["t"] != ""
    )
    listed = opened.df.select("key", lines.alias("l")).select(
        "key",
        F.transform("l", lambda e: F.xxhash64(e["t"])).alias("h"),
        F.transform("l", lambda e: F.size(F.split(e["t"], " "))).alias("w"),
        F.transform("l", lambda e: e["p"]).alias("p"),
    )
    seqs = saved(listed.mapInPandas(_with_runs(block_words), "key long, h array<long>, w array<int>, p array<int>, k array<long>"))
    keys = F.concat(F.arrays_zip("h", "w"), F.transform("k", lambda k: F.struct(k.alias("h"), F.lit(block_words).alias("w"))))
    seen = seqs.select("key", F.explode(keys).alias("e")).select("key", "e.h", "e.w")
    shared = seen.groupBy("h").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = (
        seen.join(shared, "h")
        .where("key <> first")
        .groupBy("key", "first")
        .agg(F.min("n").alias("n"), F.sum("w").alias("words"))
        .where((F.col("n") <= rare_lines) | (F.col("words") >= block_words))
        .select("key", "first")
    )
    earlier = seqs.select(F.col("key").alias("first"), F.col("h").alias("earlier"))
    both = pairs.join(seqs, "key").join(earlier, "first").select("key", "h", "w", "p", "earlier")
    blocks = both.mapInPandas(_aligned(block_words), "key long, start int, end int")
    raw = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"])))
    removed = (
        blocks.groupBy("key")
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"))
        .select(F.col("key").alias("r_key"), F.array_distinct(raw).alias("gone"))
    )
    spoiled = opened.df.join(removed, F.col("key") == F.col("r_key"), "left").join(
        seqs.select(F.col("key").alias("s_key"), F.col("p").alias("solid")), F.col("key") == F.col("s_key"), "left"
    )
    count = F.coalesce(F.size(F.array_intersect("gone", "solid")), F.lit(0)).cast("long")
    runs = F.aggregate(
        F.sort_array("gone"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-2).alias("last")),
        lambda a, x: F.struct((a["n"] + F.when(x == a["last"] + 1, 0).otherwise(1)).cast("long").alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    return opened.closed(
        spoiled,
        {
            "n_lines": F.size("solid").cast("long"),
            "n_removed_lines": F.when(F.col("gone").isNull(), 0).otherwise(count).cast("long"),
            "n_blocks": F.coalesce(runs, F.lit(0)).cast("long"),
            "clean_text": F.when(F.col("gone").isNull(), text).otherwise(without_lines(text, F.col("gone"))),
        },
    )


def op8_line_dedup(spark, folder: str) -> DataFrame:
    cut = dedup_lines(spark.read.parquet(f"{folder}/documents.parquet"))
    return cut.select("doc_id", "n_lines", "n_removed_lines", "n_blocks", F.sha2("clean_text", 256).alias("kept_sha256"))
