"""Undo and redo replayed as an associative scan over stack effects.

What some versions of a sheet do to the stack of parents is an effect: how many
entries below its beginning it takes away, and what it leaves on top. Effects of
neighbouring stretches combine into one, so each task replays its own stretch of the
sorted versions without knowing the stack it starts from, and only the few versions
that look below their stretch are filled in afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import saved

VERSION, TAIL, EFFECT = 0, 1, 2
BATCH = 10_000


class Popped(NamedTuple):
    """The entry popped last: from ``low`` to ``high`` places below the start as far as
    the stack goes, else ``known``, else (``carried``) what it was before the start."""

    low: int | None
    high: int | None
    known: str | None
    carried: bool

    @property
    def settled(self) -> bool:
        return self.low is None and not self.carried


class Stretch:
    """The effect of some consecutive versions of one sheet."""

    def __init__(self, sheet: Any, begins: bool):
        self.sheet = sheet
        #: Nothing below the start can be reached any more.
        self.cut = begins
        self.below = 0
        self.pushed: list[str] = []
        self.popped = Popped(None, None, None, not begins)

    def step(self, operation: str, name: str) -> tuple[str | None, int | None, Popped | None]:
        """Parent of a version, as (known parent, or place below the start; entry
        popped last where a redo has to ask for it)."""
        if operation == "uploaded":
            self.cut, self.pushed = True, [name]
            return None, None, None
        if operation == "undo":
            if self.pushed:
                self.popped = Popped(None, None, self.pushed.pop(), False)
            elif not self.cut:
                low = self.below if self.popped.low is None else self.popped.low
                self.popped = self.popped._replace(low=low, high=self.below)
                self.below += 1
            return None, None, None
        top = self.pushed[-1] if self.pushed else None
        place = None if self.pushed or self.cut else self.below
        asked = None
        if operation == "redo":
            if not self.popped.settled:
                asked = self.popped
            elif self.popped.known is not None:
                top, place = self.popped.known, None
        self.pushed.append(name)
        return top, place, asked


def _schema(versions: DataFrame) -> T.StructType:
    kept = [versions.schema[c] for c in ("sheet", "ordinal")]
    more = "hash string, operation string, parent string, place long, low long, high long, known string, carried boolean, kind int, part int, cut boolean, at long"
    return T.StructType([*kept, *T.StructType.fromDDL(more).fields])


def _replay(names: list[str], types: pa.Schema):
    def effect(s: Stretch, part: int) -> tuple:
        return (s.sheet, None, None, None, None, s.below, *s.popped, EFFECT, part, s.cut, len(s.pushed))

    def rows(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[tuple]:
        stretch, first = None, True
        for batch in batches:
            for sheet, ordinal, name, operation in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if stretch is None or sheet != stretch.sheet:
                    if stretch is not None and first:
                        yield effect(stretch, part)
                        first = False
                    stretch = Stretch(sheet, begins=stretch is not None)
                parent, place, asked = stretch.step(operation, name)
                low, high, known, carried = asked or (None, None, None, False)
                yield (sheet, ordinal, name, operation, parent, place, low, high, known, carried, VERSION, part, None, None)
        if stretch is not None:
            yield effect(stretch, part)
            for at, name in enumerate(stretch.pushed):
                yield (stretch.sheet, None, name, None, None, None, None, None, None, None, TAIL, part, None, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows(batches, TaskContext.get().partitionId()):
            held.append(row)
            if len(held) == BATCH:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, types.field(n).type) for n, c in zip(names, zip(*held, strict=True), strict=True)], names=names)

    return run


class _Stack:
    """The stack at the border of two tasks, as runs of the tails of earlier tasks."""

    def __init__(self) -> None:
        self.runs: list[list[int]] = []  # [task, entries], the top one last
        self.depth = 0
        self.popped: tuple | None = None

    def span(self, below: int) -> Iterator[tuple[int, int, int, int]]:
        """(first place, last place, task, place + index) of the entries down to
        ``below`` places under the top."""
        place = 0
        for task, entries in reversed(self.runs):
            yield place, place + entries - 1, task, place + entries - 1
            place += entries
            if place > below:
                return

    def entry(self, below: int) -> tuple[int, int]:
        return next((task, total - below) for first, last, task, total in self.span(below) if first <= below <= last)

    def resolved(self, e: Any) -> tuple | None:
        if e.low is not None and self.depth > e.low:
            return self.entry(min(e.high, self.depth - 1))
        if e.known is not None:
            return (e.known,)
        return self.popped if e.carried else None

    def then(self, e: Any) -> None:
        """The stack after a task's effect."""
        popped = self.resolved(e)
        left = self.depth if e.cut else min(e.place, self.depth)
        self.depth -= left
        while left:
            gone = min(left, self.runs[-1][1])
            self.runs[-1][1] -= gone
            left -= gone
            if not self.runs[-1][1]:
                self.runs.pop()
        if e.at:
            self.runs.append([e.part, e.at])
            self.depth += e.at
        self.popped = popped


def _borders(effects: list) -> tuple[list[tuple], list[tuple]]:
    """Per task the stack that comes in: (task, depth, popped last as (task, index) or
    text), and where the places its versions may ask for are. Each run of entries is
    passed once by the task that pops it, so the lists follow the number of tasks."""
    carried, places = [], []
    stack, sheet, started = _Stack(), None, False
    for part, group in groupby(sorted(effects, key=lambda e: e.part), key=lambda e: e.part):
        own = list(group)
        first = next(e for e in own if len(own) == 1 or e.first)
        if not started or first.sheet != sheet:
            stack = _Stack()
        carried.append((part, stack.depth, *((*stack.popped, None) if stack.popped and len(stack.popped) == 2 else (None, None, stack.popped and stack.popped[0]))))
        places += [(part, *span) for span in stack.span(first.place)]
        if len(own) > 1:
            stack, first = _Stack(), next(e for e in own if not e.first)
        stack.then(first)
        sheet, started = first.sheet, True
    return carried, places


def replayed(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """``sheet ordinal hash operation parent`` of versions ``sheet ordinal hash operation``.

    One range sort. Each task replays its part, and writes its versions with what it
    knows of their parents, the entries it leaves, and the effects of its first and
    last sheet. The driver combines two effects of each task; the places that versions
    ask for below their task are joined to the entries left by the tasks before.
    """
    spark = rows.sparkSession
    plain = rows.select("sheet", "ordinal", F.col("hash").cast("string").alias("hash"), "operation")
    spread = plain.repartitionByRange(partitions, "sheet", "ordinal") if partitions else plain.repartitionByRange("sheet", "ordinal")
    schema = _schema(plain)
    from pyspark.sql.pandas.types import to_arrow_schema

    found = saved(spread.sortWithinPartitions("sheet", "ordinal").mapInArrow(_replay(schema.names, to_arrow_schema(schema)), schema))
    # The first effect of a task is that of its first sheet; rows keep their order in
    # a file, but not between reads, so the first sheet is told by its order.
    effects = found.where(F.col("kind") == EFFECT)
    order = F.struct(F.col("sheet").isNotNull(), F.col("sheet"))
    least = effects.groupBy("part").agg(F.min(order).alias("least"))
    told = effects.join(least, "part").select(effects["*"], (order == F.col("least")).alias("first"))
    carried, places = _borders(told.collect())
    if not carried:
        return found.select("sheet", "ordinal", "hash", "operation", "parent")
    # Rows of these tables: one a task, and one a run of entries a task asks for.
    stacks = spark.createDataFrame(carried, "part int, depth long, p_task int, p_index long, p_known string")
    spans = F.broadcast(spark.createDataFrame(places, "part int, from_place long, to_place long, task int, total long"))
    tails = found.where(F.col("kind") == TAIL).select(F.col("part").alias("task"), F.col("at").alias("index"), F.col("hash").alias("entry"))

    own = found.where(F.col("kind") == VERSION)
    asks = F.col("place").isNotNull() | F.col("low").isNotNull() | F.col("carried")
    closed = own.where(~asks).select("sheet", "ordinal", "hash", "operation", "parent")
    pointed = stacks.where("p_task is not null").join(
        tails.select(F.col("task").alias("p_task"), F.col("index").alias("p_index"), F.col("entry").alias("p_entry")), ["p_task", "p_index"]
    )
    before = stacks.join(pointed.select("part", "p_entry"), "part", "left").select(
        "part", "depth", F.coalesce("p_known", "p_entry").alias("popped_before")
    )
    asking = own.where(asks).join(F.broadcast(before), "part").withColumns(
        {
            "top_place": F.when(F.col("place") < F.col("depth"), F.col("place")),
            "popped_place": F.when(F.col("low") < F.col("depth"), F.least("high", F.col("depth") - 1)),
        }
    )
    wanted = asking.select("part", F.explode(F.array_compact(F.array("top_place", "popped_place"))).alias("asked")).distinct()
    owned = wanted.join(spans, "part").where("asked between from_place and to_place")
    entries = saved(
        owned.select("part", "asked", "task", (F.col("total") - F.col("asked")).alias("index")).join(tails, ["task", "index"]).select("part", "asked", "entry")
    )
    top = entries.select("part", F.col("asked").alias("top_place"), F.col("entry").alias("top_entry"))
    popped = entries.select("part", F.col("asked").alias("popped_place"), F.col("entry").alias("popped_entry"))
    filled = asking.join(top, ["part", "top_place"], "left").join(popped, ["part", "popped_place"], "left")
    parent = F.coalesce("popped_entry", "known", F.when(F.col("carried"), F.col("popped_before")), "parent", "top_entry")
    return closed.unionByName(filled.select("sheet", "ordinal", "hash", "operation", parent.alias("parent")))
