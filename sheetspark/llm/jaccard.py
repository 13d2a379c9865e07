"""N-gram Jaccard join: signatures of rare shingles alone and of frequent ones in
pairs, from prefixes extended to match, then verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Opened, saved
from .components import components

SLOT_BLOCK = 4096
#: Keys (eight bytes each) up to which a set of documents is broadcast to a scan.
BROADCAST_KEYS = 500_000
MULTIPLIER = 0x9E3779B97F4A7C15
MOST_HASHES = 1 << 15
#: Documents of one frame of sets or signatures; long texts come in smaller Arrow batches.
FRAME_ROWS = 1_000
#: Documents of one signature up to which all their pairs are looked at.
TOGETHER = 16
#: Times that larger groups are compared to a pivot before the rest is paired.
ROUNDS = 2


class WordHashes(dict):
    """64-bit hashes of words; keeps the first ones met, up to ``MOST_HASHES``."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MOST_HASHES:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, known: WordHashes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    if not len(found):
        return hashes
    size = min(words, len(found))
    rows = len(found) - size + 1
    total = np.full(rows, size, np.uint64)
    for i in range(size):
        total = total * np.uint64(MULTIPLIER) + hashes[i : i + rows]
    return np.unique(mixed(total))


def _level(size: int) -> int:
    """log2 of the number of subclasses of frequent shingles, from the smaller set's size."""
    return max(0, (size // 16).bit_length() - 1)


def _pairs(tokens: np.ndarray, owner: np.ndarray, level: int) -> np.ndarray:
    order = np.argsort(owner, kind="stable")
    tokens, owner = tokens[order], owner[order]
    at = np.arange(len(tokens))
    starts = np.searchsorted(owner, owner, side="left")
    before = at - starts
    second = np.repeat(at, before)
    first = np.arange(len(second)) - np.repeat(np.cumsum(before) - before, before) + np.repeat(starts, before)
    salt = np.uint64(2 * level + 3)
    return mixed(tokens[first] * np.uint64(MULTIPLIER) + mixed(tokens[second] + salt))


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Signatures of a set (sorted hashes) of which linked sets share at least one,
    and how many of them, at the front and in the global order, are rare tokens.

    The global order is: rare tokens by hash, then frequent ones by hash. Of n
    tokens, at most n - ceil(percent * n / 100) can be missing in a linked set.
    The prefix is extended until (rare tokens) + sum over subclasses of frequent
    tokens of (its tokens - 1) exceeds that number: then a linked set whose prefix
    ends at the same place or later shares a rare token of the prefix, or two of
    one subclass. Subclasses are of the hash; their number follows the smaller
    set's size, so a set makes its pairs for every number that a partner can have.
    """
    n = len(tokens)
    least = (percent * n + 99) // 100
    need = n - least + 1
    rare = tokens[~frequent]
    if len(rare) >= need:
        return rare[:need], need
    common = tokens[frequent]
    out = [rare]
    if n > 1:
        for level in range(_level(least), _level(n) + 1):
            owner = mixed(common) & np.uint64((1 << level) - 1)
            gain = np.ones(len(common), np.int64)
            gain[np.unique(owner, return_index=True)[1]] = 0
            end = int(np.searchsorted(np.cumsum(gain), need - len(rare))) + 1
            out.append(_pairs(common[:end], owner[:end], level))
    return np.concatenate(out), len(rare)


def parities(tokens: np.ndarray) -> np.ndarray:
    """Bits (1,024, or more for more tokens, by powers of two), each whether an odd
    number of tokens hash to it: two sets differ in at least as many tokens as
    their parities in bits. Halves laid over each other are the next smaller size."""
    size = 1024 << max(0, (len(tokens) // 512).bit_length() - 1)
    odd = np.bincount((mixed(tokens ^ np.uint64(MULTIPLIER)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(x, size):
    """Parities of twice the size laid over each other, others as they are."""
    over = F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(x) > size, over).otherwise(x)


def _hinted(df: DataFrame) -> DataFrame:
    """A saved table of keys, broadcast up to a number of rows; beyond it, both sides
    of its joins are shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _slot_counts(words: int, slots: int):
    """Counts of this task's shingles by slot of their hash, one count a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = WordHashes(), np.zeros(slots, np.uint8)
        shift = np.uint64(64 - slots.bit_length() + 1)
        for pdf in batches:
            for text in pdf["text"]:
                at, more = np.unique((shingle_set(text, known, words) >> shift).astype(np.int64), return_counts=True)
                counts[at] = np.minimum(counts[at] + more, 255)
        small = counts.reshape(-1, SLOT_BLOCK)
        used = np.flatnonzero(small.any(axis=1))
        for i in range(0, len(used), 512):
            part = used[i : i + 512]
            yield pd.DataFrame({"block": part.astype(np.int32), "counts": [small[j].tobytes() for j in part]})

    return run


def _slot_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the tasks' counts on a scale of a quarter of a power of two, a byte each."""
    sums: dict[int, np.ndarray] = {}
    for pdf in batches:
        for block, counts in zip(pdf["block"], pdf["counts"], strict=True):
            held = sums.setdefault(block, np.zeros(SLOT_BLOCK, np.int64))
            held += np.frombuffer(counts, np.uint8)
    scales = [np.minimum(np.round(4 * np.log2(1 + x)), 255).astype(np.uint8).tobytes() for x in sums.values()]
    yield pd.DataFrame({"block": list(sums), "counts": scales, "total": [int(x.sum()) for x in sums.values()]}).astype({"block": "int32", "total": "int64"})


def frequent_slots(texts: DataFrame, words: int, slots: int) -> np.ndarray:
    """Slots of shingle hashes whose count, over all documents, is far above the mean."""
    blocks = texts.mapInPandas(_slot_counts(words, slots), "block int, counts binary")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.repartition(parts, "block").mapInPandas(_slot_sums, "block int, counts binary, total long").collect()
    scale = np.zeros((slots // SLOT_BLOCK, SLOT_BLOCK), np.uint8)
    for block, counts, _ in rows:
        scale[block] = np.frombuffer(counts, np.uint8)
    mean = sum(total for _, _, total in rows) / slots
    return scale.reshape(-1) >= 4 * np.log2(1 + 4 * mean + 16)


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in smaller frames, so that results of few documents are held."""
    for pdf in batches:
        for i in range(0, len(pdf), FRAME_ROWS):
            yield pdf.iloc[i : i + FRAME_ROWS]
        del pdf


def _shingled(words: int, percent: int, frequent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        flags = np.frombuffer(frequent.value, np.uint8)
        shift = np.uint64(64 - (8 * len(flags)).bit_length() + 1)
        for pdf in _frames(batches):
            n, d1, d2, sigs, alone, odd, small = [], [], [], [], [], [], []
            for text in pdf["text"]:
                tokens = shingle_set(text, known, words)
                n.append(len(tokens))
                d1.append(int(tokens.sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(mixed(tokens + np.uint64(MULTIPLIER)).sum(dtype=np.uint64).view(np.int64)))
                slot = (tokens >> shift).astype(np.int64)
                is_frequent = (flags[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
                made, rare = signatures(tokens, is_frequent, percent)
                sigs.append(made.view(np.int64))
                alone.append(rare)
                odd.append(parities(tokens))
                small.append(np.bitwise_xor.reduce(odd[-1].reshape(-1, 4), axis=0))
            yield pd.DataFrame(
                {"key": pdf["key"], "n": np.array(n, np.int64), "d1": d1, "d2": d2, "alone": np.array(alone, np.int32), "sigs": sigs, "odd": odd, "small": small}
            )

    return run


def _sets(words: int):
    """Sets as the upper six bytes of each sorted hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in _frames(batches):
            packed = [shingle_set(t, known, words).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "tokens": packed})

    return run


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(np.uint64)


def _linked(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                a, b = sorted((_unpacked(x), _unpacked(y)), key=len)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _with_sets(pairs: DataFrame, facts: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``a b x y``: pairs that may be alike by so many percent, with both sets. Sizes
    and parities drop most others first; sets are made for documents in the pairs
    left. Their keys are broadcast to the scan of the texts up to a number of them,
    else texts and keys are shuffled."""
    a = facts.select(F.col("key").alias("a"), "n", F.col("odd").alias("x"))
    b = facts.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("odd").alias("y"))
    size = F.least(F.size("x"), F.size("y"))
    differing = F.zip_with(_folded(F.col("x"), size), _folded(F.col("y"), size), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(differing, F.lit(0), lambda t, v: t + v)
    near = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (apart <= F.col("n") + F.col("m") - 2 * _least(percent))
    pairs = saved(pairs.join(a, "a").join(b, "b").where(near).select("a", "b"))
    wanted = saved(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    sets = saved(texts.join(_hinted(wanted), "key", "left_semi").mapInPandas(_sets(words), "key long, tokens binary"))
    one = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")


def _verified(pairs: DataFrame, facts: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose whole sets link."""
    both = _with_sets(pairs, facts, texts, words, percent)
    return saved(both.mapInPandas(_linked(percent), "a long, b long"))


def _least(percent: int):
    """Tokens that linked sets of n and m tokens share at least."""
    return F.ceil(F.lit(percent) * (F.col("n") + F.col("m")) / F.lit(100 + percent))


def _alike(percent: int):
    """Whether sizes and folded parities allow a link."""
    apart = sum((F.bit_count(F.col(f"odd{i}").bitwiseXOR(F.col(f"even{i}"))) for i in range(4)), F.lit(0))
    sizes = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    return sizes & (apart <= F.col("n") + F.col("m") - 2 * _least(percent))


def _plausible(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs that can still link, from one row for each signature they share.

    Rare tokens are met in the global order, so up to the last shared one the
    shared ones are counted exactly; beyond it, no more than the rest of the
    smaller rest can be shared.
    """
    most = F.col("c") + F.least(F.col("n") - 1 - F.col("pa"), F.col("m") - 1 - F.col("pb"))
    return (
        shared.groupBy("a", "b")
        .agg(F.min("n").alias("n"), F.min("m").alias("m"), F.count_if(F.col("pa") >= 0).alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
        .where((F.col("c") == 0) | (most >= _least(percent)))
        .select("a", "b")
    )


def _differences(percent: int, inner: int, outer: int):
    """Tokens in one of a pivot's set and a document's, where the two are alike by
    ``outer`` percent. ``slack`` and ``own`` are the document's and the pivot's
    (100 - percent) * size - (100 + percent) * tokens apart from the pivot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _frames(batches):
            rows = []
            for pivot, key, x, y in zip(pdf["a"], pdf["b"], pdf["x"], pdf["y"], strict=True):
                a, b = _unpacked(x), _unpacked(y)
                apart = np.setxor1d(a, b, assume_unique=True)
                union = (len(a) + len(b) + len(apart)) // 2
                both = 100 * (union - len(apart))
                if both >= outer * union:
                    slack = (100 - percent) * len(b) - (100 + percent) * len(apart)
                    rows.append((pivot, key, both >= inner * union, slack, (100 - percent) * len(a), apart.view(np.int64)))
            if rows:
                yield pd.DataFrame(rows, columns=["pivot", "key", "inner", "slack", "own", "tokens"])

    return run


def _links_around(around: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Links between documents compared to one pivot, from what sets them apart from it.

    Two sets are apart by the tokens that set either, but not both, apart from the
    pivot. So they link when their slacks and twice (100 + percent) times the
    number of such tokens they share come to 0 or more. Without shared ones this
    holds for a pair only if it holds for both with the document of most slack, so
    links to that one connect all these. The others share at least a known number
    of such tokens: they meet on one at the front, those of few documents first.
    """
    unit = 2 * (100 + percent)
    members = around.select("pivot", "key", "slack").union(around.select("pivot", F.col("pivot").alias("key"), F.col("own").alias("slack")).distinct())
    most = members.groupBy("pivot").agg(F.max(F.struct("slack", "key")).alias("most"))
    most = saved(most.select("pivot", F.col("most.slack").alias("top"), F.col("most.key").alias("centre")))
    sure = members.join(_hinted(most), "pivot").where("slack + top >= 0 AND key <> centre").select(F.col("centre").alias("a"), F.col("key").alias("b"))
    known = around.join(_hinted(most), "pivot").join(_hinted(marks), "key", "left")
    known = saved(known.select("pivot", "key", F.coalesce("mark", "key").alias("mark"), (-F.col("slack")).alias("lack"), "top", "tokens"))
    each = known.select("pivot", "key", "mark", "lack", "top", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    holders = each.groupBy("pivot", "token").agg(F.count("*").alias("holders"))
    place = F.row_number().over(Window.partitionBy("pivot", "key").orderBy("holders", "token"))
    placed = each.join(holders, ["pivot", "token"]).withColumn("place", place).where("holders > 1")
    # A pair's first document is that of less lack; the second is not linked to the centre.
    least = f"(lack + greatest(top + 1, lack) + {unit - 1}) div {unit}"
    least_second = f"(lack - top + {unit - 1}) div {unit}"
    placed = placed.withColumn("first", F.expr(f"place <= size - {least} + 1"))
    placed = saved(placed.withColumn("second", F.expr(f"lack > top AND place <= size - {least_second} + 1")).where("first OR second"))
    a = placed.where("first").select("pivot", "token", *[F.col(c).alias(f"{c}_a") for c in ("key", "mark", "lack", "size", "place")])
    b = placed.where("second").select("pivot", "token", *[F.col(c).alias(f"{c}_b") for c in ("key", "mark", "lack", "size", "place")])
    shared = f"((lack_a + lack_b + {unit - 1}) div {unit})"
    may = f"mark_a <> mark_b AND (lack_a < lack_b OR lack_a = lack_b AND key_a < key_b) AND place_a <= size_a - {shared} + 1 AND place_b <= size_b - {shared} + 1"
    pairs = a.join(b, ["pivot", "token"]).where(may).select("pivot", F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()
    one = known.select("pivot", F.col("key").alias("a"), F.col("lack").alias("p"), F.col("tokens").alias("x"))
    two = known.select("pivot", F.col("key").alias("b"), F.col("lack").alias("q"), F.col("tokens").alias("y"))
    linked = unit * F.size(F.array_intersect("x", "y")) >= F.col("p") + F.col("q")
    return saved(sure.union(pairs.join(one, ["pivot", "a"]).join(two, ["pivot", "b"]).where(linked).select("a", "b")).distinct())


def _around_pivots(rows: DataFrame, marks: DataFrame, facts: DataFrame, texts: DataFrame, words: int, percent: int) -> tuple[list[DataFrame], DataFrame]:
    """Links found around pivots, and the rows whose pairs are still to be looked at.

    Documents of a signature that more than ``TOGETHER`` have are compared to the
    smallest one, their pivot. A document alike to it by ``inner`` percent links
    only with documents alike to it by ``percent + inner - 100`` percent, since 1
    minus the likeness keeps the triangle inequality: links among these are found
    from their differences, and the inner ones leave the group. What stays gets
    a new pivot, some times over.
    """
    inner = max(percent - 10, 1)
    outer = max(percent + inner - 100, 0)
    links, rest = [], []
    for _ in range(ROUNDS):
        groups = rows.groupBy("sig").agg(F.min("key").alias("pivot"), F.count("*").alias("size")).where(F.col("size") > TOGETHER)
        groups = saved(groups.select("sig", "pivot"))
        if groups.isEmpty():
            break
        rest.append(rows.join(_hinted(groups), "sig", "left_anti"))
        large = saved(rows.join(_hinted(groups), "sig"))
        facts = saved(facts.join(_hinted(saved(large.select("key").distinct())), "key", "left_semi"))
        pairs = large.where("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
        kind = "pivot long, key long, inner boolean, slack long, own long, tokens array<long>"
        around = saved(_with_sets(pairs, facts, texts, words, outer).mapInPandas(_differences(percent, inner, outer), kind))
        links.append(_links_around(around, marks, percent))
        gone = around.where("inner").select("pivot", "key")
        rows = saved(large.join(gone, ["pivot", "key"], "left_anti").where("key <> pivot").select(*rows.columns))
    for part in rest:
        rows = rows.unionByName(part)
    return links, rows


def _linked_components(hits: DataFrame, facts: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``node root`` of the links between documents that share a signature.

    First the documents of each signature are compared to its smallest one (m - 1
    pairs for m documents), and linked ones take the least such document as their
    mark. Documents with one mark are connected. Then all pairs of different marks
    that share a signature are looked at, so no link between components is lost:
    in large groups around pivots, else one by one.
    """
    pivots = hits.groupBy("sig").agg(F.min("key").alias("pivot"))
    star = hits.join(pivots, "sig").where("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    stars = _verified(star, facts, texts, words, percent)
    marks = stars.groupBy("b").agg(F.min("a").alias("mark"))
    above = marks.select(F.col("b").alias("mark"), F.col("mark").alias("above"))
    marks = saved(marks.join(above, "mark", "left").select(F.col("b").alias("key"), F.coalesce("above", "mark").alias("mark")))
    marked = hits.join(_hinted(marks), "key", "left").withColumn("mark", F.coalesce("mark", "key"))
    several = marked.groupBy("sig").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low <> high").select("sig")
    links, marked = _around_pivots(saved(marked.join(several, "sig", "left_semi")), marks, facts, texts, words, percent)
    a = marked.select("sig", F.col("key").alias("a"), "n", F.col("pos").alias("pa"), F.col("mark").alias("mark_a"), *[f"odd{i}" for i in range(4)])
    b = marked.select(
        F.col("sig").alias("sig_b"), F.col("key").alias("b"), F.col("n").alias("m"), F.col("pos").alias("pb"), F.col("mark").alias("mark_b"),
        *[F.col(f"odd{i}").alias(f"even{i}") for i in range(4)],
    )
    apart = (F.col("a") < F.col("b")) & (F.col("mark_a") != F.col("mark_b"))
    shared = a.join(b, (F.col("sig") == F.col("sig_b")) & apart & _alike(percent))
    more = _verified(_plausible(shared, percent), facts, texts, words, percent)
    for found in links:
        more = more.union(found)
    return components(stars.union(more))


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    slots: int = 1 << 24,
) -> DataFrame:
    """Components of documents linked by Jaccard similarity of their word shingles.

    Words are runs of other than ASCII white space with A-Z in lower case; sets
    hold the distinct shingles of ``words`` words (a shorter text is one). Sets
    link when 100 * intersection >= percent * union, compared in whole numbers over
    48 bits of each shingle's hash. Equal sets (by size and 128 bits) are one set;
    its smallest key stands for it.

    Frequent shingles are found by counting every document's shingles in ``slots``
    hash slots (one byte each per task, then one bit each in the broadcast, so
    both have a fixed size); a shingle in a wrong class costs time, never a link.

    Adds ``n_shingles component_id is_first``. ``component_id`` is the smallest key
    that links reach; the id itself where ids are integers, present and different,
    else a row number. ``is_first`` is true for one row of each component, that of
    the smallest key, whatever the ids. Null, empty and blank texts have no
    shingles and are their own component. Repeated rows have equal sets and are
    linked. Results replace input columns of the same name.
    """
    opened = Opened(docs, id_col, text_col)
    spark = docs.sparkSession
    texts = opened.df.select("key", F.col(opened.text).alias("text"))
    flags = np.packbits(frequent_slots(texts.select("text"), words, slots)).tobytes()
    sent = spark.sparkContext.broadcast(flags)
    shingled = saved(texts.mapInPandas(_shingled(words, percent, sent), "key long, n long, d1 long, d2 long, alone int, sigs array<long>, odd array<long>, small array<long>"))
    equal = shingled.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("key").alias("rep"))
    reps = saved(shingled.select("key", "n", "d1", "d2").join(equal, ["n", "d1", "d2"], "left").select("key", "n", F.coalesce("rep", "key").alias("rep")))
    chosen = saved(reps.where("key = rep AND n > 0").select("key"))
    each = shingled.join(_hinted(chosen), "key", "left_semi").select("key", "n", "alone", F.posexplode("sigs").alias("pos", "sig"))
    rows = each.select("sig", "key", "n", F.when(F.col("pos") < F.col("alone"), F.col("pos")).otherwise(-1).alias("pos"))
    twice = rows.groupBy("sig").count().where("count > 1").select("sig")
    facts = shingled.select("key", "n", "odd")
    hits = saved(rows.join(twice, "sig").join(shingled.select("key", *[F.get("small", F.lit(i)).alias(f"odd{i}") for i in range(4)]), "key"))
    found = _linked_components(hits, facts, texts, words, percent)
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("key").alias("r_key"), "n", F.coalesce("root", "rep").alias("root")
    )
    result = opened.df.join(named, F.col("key") == F.col("r_key"))
    return opened.closed(result, {"n_shingles": F.col("n"), "component_id": F.col("root"), "is_first": F.col("key") == F.col("root")})


def op2_jaccard_join(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, words=4, percent=85).select("doc_id", "n_shingles", "component_id")
