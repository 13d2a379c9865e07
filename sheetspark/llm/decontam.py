"""Benchmark decontamination: one Aho-Corasick automaton over the normalised
benchmark, one scan of each document, offsets mapped to the original text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

WINDOW = 10
#: Bytes that end a word, A-Z in lower case, everything else as it is.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
WORD = re.compile(rb"[^ ]+")


def fold_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class Matcher:
    """Automaton over the windows of a block of benchmark items, by word numbers."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in fold_words(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                held = owners.setdefault(tuple(words[i : i + window]), [])
                if not held or held[-1] != item:
                    held.append(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, held in owners.items():
            self.automaton.add_word(key, (len(key), held))
        self.empty = not owners
        self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit ranges [start, end) in words, and the items found."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.empty or not words:
            return spans, items
        numbers = self.numbers.get
        for end, (length, held) in self.automaton.iter(tuple([numbers(w, 0) for w in words])):
            items.update(held)
            spans.append((end + 1 - length, end + 1))
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def original_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges of the text for ranges of its words."""
    raw = text.encode("utf-8", "replace")
    places = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    out, at, chars = [], 0, 0
    for s, e in spans:
        start, end = places[s][0], places[e - 1][1]
        chars += len(raw[at:start].decode())
        first = chars
        chars += len(raw[start:end].decode())
        at = end
        out.append((first, chars))
    return out


def _with(batch: pa.RecordBatch, made: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with some columns made anew; the others are passed on as they are."""
    names = [*[n for n in batch.schema.names if n not in made], *made]
    return pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)


def _scan(block, window: int):
    """Scan with one block of items, adding to what earlier blocks found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value, window)
        for batch in batches:
            counts, starts, ends, found = [], [], [], []
            for text, old_from, old_to, old_items in zip(*[batch.column(c).to_pylist() for c in ("t", "hit_from", "hit_to", "items")], strict=True):
                words = fold_words(text)
                spans, items = matcher.find(words)
                if old_from:
                    spans = merged([*spans, *zip(old_from, old_to, strict=True)])
                counts.append(len(words))
                starts.append([s for s, _ in spans])
                ends.append([e for _, e in spans])
                found.append(sorted(items.union(old_items)))
            ranges = pa.list_(pa.int32())
            yield _with(
                batch,
                {
                    "n_words": pa.array(counts, pa.int64()),
                    "hit_from": pa.array(starts, ranges),
                    "hit_to": pa.array(ends, ranges),
                    "items": pa.array(found, pa.list_(pa.string())),
                },
            )

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of at most ``most`` characters (a longer item is a block)."""
    items = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator()
    block, size = [], 0
    for item, text in items:
        n = len(text or "")
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append(("" if item is None else item, text))
        size += n
    yield block


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [
            original_offsets(t, list(zip(a, b, strict=True))) if a else []
            for t, a, b in zip(*[batch.column(c).to_pylist() for c in ("t", "hit_from", "hit_to")], strict=True)
        ]
        ranges = pa.list_(pa.int32())
        places = {"char_from": [[s for s, _ in x] for x in spans], "char_to": [[e for _, e in x] for x in spans]}
        yield _with(batch, {name: pa.array(x, ranges) for name, x in places.items()})


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_chars: int = 8_000_000,
    offsets: bool = True,
) -> DataFrame:
    """Words of documents that lie inside an occurrence of a benchmark window.

    Texts are folded (A-Z to lower case; words of digits, letters and non-ASCII
    characters). Each ``window`` consecutive words of an item are a window; a
    shorter item with a word is one window. All windows of a block of items form
    one automaton, sent to the tasks; blocks hold ``block_chars`` characters at
    most, which bounds the driver, the broadcast and the automaton. A larger
    benchmark takes one pass for each block, over a table written between passes,
    and every pass adds to the same hits. Documents are never shuffled.

    Adds ``n_words n_hit n_items items contaminated`` and, with ``offsets``, the
    character ranges ``char_from char_to`` of the hits in the original text. Null
    text has no words; items without words match nothing; a null item id is shown
    as an empty string; repeated rows are judged each; rows of one item id with
    different texts are one item; very long texts are scanned whole, a row at a time;
    an empty table gives no rows. Other columns, of any type, come back as they were,
    but that results replace input columns of the same name.
    """
    names = docs.columns
    plain = docs.toDF(*[f"in_{i}" for i in range(len(names))])
    text = f"in_{names.index(text_col)}"
    state = plain.withColumns(
        {"t": F.col(text).cast("string"), "n_words": F.lit(0).cast("long"), "hit_from": F.expr("cast(array() as array<int>)"),
         "hit_to": F.expr("cast(array() as array<int>)"), "items": F.expr("cast(array() as array<string>)")}
    )
    spark = docs.sparkSession
    for n, block in enumerate(_blocks(benchmark, item_col, item_text_col, block_chars)):
        if n:
            state = saved(state)
        sent = spark.sparkContext.broadcast(block)
        state = state.mapInArrow(_scan(sent, window), state.schema)
    results = {
        "n_words": F.col("n_words"),
        "n_hit": F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x),
        "n_items": F.size("items").cast("long"),
        "items": F.col("items"),
        "contaminated": F.size("items") > 0,
    }
    if offsets:
        ranges = [T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("char_from", "char_to")]
        state = state.mapInArrow(_report, T.StructType([*state.schema.fields, *ranges]))
        results |= {"char_from": F.col("char_from"), "char_to": F.col("char_to")}
    kept = [F.col(f"in_{i}").alias(name) for i, name in enumerate(names) if name not in results]
    return state.select(*kept, *[c.alias(n) for n, c in results.items()])


def op3_decontamination(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated", "char_from", "char_to")
