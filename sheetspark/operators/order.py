"""Row order: dense index, previous-row difference, running values.

A sheet's rows have an order, a DataFrame's rows do not, so every operator
here takes ``order_by``. Nothing runs in one task: rows are range-sorted into
partitions, each partition computes its own part, and one summary row per
partition carries values over the borders. A key that holds any share of the
rows is therefore spread over as many partitions as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ident
from ..session import saved

PART, POS = "__part", "__pos"
_LOW_BITS = (1 << 33) - 1


def range_ordered(df: DataFrame, order_by: Sequence[str | Column], partitions: int | None = None) -> DataFrame:
    """Rows range-sorted by ``order_by`` with their partition and place in it.

    Saved, because a second evaluation could sample other range borders.
    """
    keys = [ident(k) if isinstance(k, str) else k for k in order_by]
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    tagged = (
        spread.sortWithinPartitions(*keys)
        .withColumn(POS, F.monotonically_increasing_id())
        .withColumn(PART, F.shiftright(POS, 33).cast("int"))
        .withColumn(POS, F.col(POS).bitwiseAND(F.lit(_LOW_BITS)))
    )
    return saved(tagged)


def _side_table(df: DataFrame, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """One row per partition of ``df``: bounded by the partition count, so broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def row_index(
    df: DataFrame,
    order_by: Sequence[str | Column],
    name: str = "row_index",
    partitions: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """Dense 0-based row number in ``order_by`` order.

    ``unique`` promises that the named key columns are unique and not null: then
    only the keys are sorted and saved, and wide rows take the number by
    a join.
    """
    if unique:
        keys = [str(k) for k in order_by]
        return df.join(row_index(df.select(*map(ident, keys)), keys, name, partitions), keys)
    ordered = range_ordered(df, order_by, partitions)
    sizes = sorted(ordered.groupBy(PART).count().collect())
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    schema = T.StructType([T.StructField(PART, T.IntegerType()), T.StructField("__start", T.LongType())])
    offsets = _side_table(df, starts, schema)
    return (
        ordered.join(offsets, PART)
        .withColumn(name, F.col("__start") + F.col(POS))
        .drop(PART, POS, "__start")
    )


_AGGREGATE = {
    "sum": F.sum,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}
_MERGE = {
    "sum": lambda carry, local: F.coalesce(carry + local, local, carry),
    "count": lambda carry, local: F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)),
    "min": F.least,
    "max": F.greatest,
    "last": lambda carry, local: F.coalesce(local, carry),
}


def _merge_value(kind: str, carry: Any, local: Any) -> Any:
    if carry is None or local is None:
        return local if carry is None else carry
    return {"min": min, "max": max, "last": lambda _, b: b}.get(kind, lambda a, b: a + b)(carry, local)


def _edge_keys(ordered: DataFrame, keys: list[str], sizes: dict[int, int]) -> tuple[dict, dict]:
    """Key of the first and of the last row of each partition."""
    schema = T.StructType([T.StructField(PART, T.IntegerType()), T.StructField("__end", T.LongType())])
    ends = _side_table(ordered, [(part, size - 1) for part, size in sizes.items()], schema)
    edges = ordered.join(ends, PART).where((F.col(POS) == 0) | (F.col(POS) == F.col("__end")))
    first, last = {}, {}
    for part, pos, *key in edges.select(PART, POS, *map(ident, keys)).collect():
        if pos == 0:
            first[part] = tuple(key)
        if pos == sizes[part] - 1:
            last[part] = tuple(key)
    return first, last


def _tail_values(ordered: DataFrame, keys: list[str], last: dict, specs: list) -> dict[int, tuple]:
    """Values of the last key of each partition over that key's rows in it.

    Scans without a sort: each task sends one row per partition it saw.
    """
    rows = ordered
    if keys:
        fields = [T.StructField(f"__k{i}", ordered.schema[k].dataType) for i, k in enumerate(keys)]
        schema = T.StructType([T.StructField(PART, T.IntegerType()), *fields])
        rows = ordered.join(_side_table(ordered, [(part, *key) for part, key in last.items()], schema), PART)
        for i, k in enumerate(keys):
            rows = rows.where(ident(k).eqNullSafe(F.col(f"__k{i}")))
    aggregates = [
        (F.max(F.when(c.isNotNull(), F.col(POS))) if kind == "last" else _AGGREGATE[kind](c)).alias(f"__w{i}")
        for i, (_, kind, c) in enumerate(specs)
    ]
    found = {row[PART]: list(row)[1:] for row in rows.groupBy(PART).agg(*aggregates).collect()}
    for i, (_, kind, c) in enumerate(specs):
        if kind == "last":
            places = [(part, values[i]) for part, values in found.items() if values[i] is not None]
            schema = T.StructType([T.StructField(PART, T.IntegerType()), T.StructField("__at", T.LongType())])
            at = ordered.join(_side_table(ordered, places, schema), PART).where(F.col(POS) == F.col("__at"))
            for part, value in at.select(PART, c).collect():
                found[part][i] = value
    return {part: tuple(values) for part, values in found.items()}


def running(
    ordered: DataFrame,
    keys: Sequence[str],
    values: dict[str, tuple[str, str | Column]],
    before: bool = False,
) -> DataFrame:
    """Running sum, count, min, max or last non-null value inside each key.

    ``ordered`` comes from :func:`range_ordered` sorted by ``keys`` first (or by
    columns in whose order equal keys are neighbours). ``before`` leaves the
    current row out.
    """
    keys = list(keys)
    key_cols = [ident(k) for k in keys]
    specs = [(out, kind, ident(c) if isinstance(c, str) else c) for out, (kind, c) in values.items()]
    sizes = dict(sorted((row[PART], row["count"]) for row in ordered.groupBy(PART).count().collect()))

    frame = Window.partitionBy(PART, *key_cols).orderBy(POS).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    # One sorted partition per task again; hashing would put several into one.
    spread = ordered.repartitionByRange(len(sizes), PART) if len(sizes) > 1 else ordered
    local = spread.select("*", *[_AGGREGATE[kind](c).over(frame).alias(out) for out, kind, c in specs])
    if len(sizes) < 2:
        return local

    first, last = _edge_keys(ordered, keys, sizes) if keys else ({p: () for p in sizes}, {p: () for p in sizes})
    tails = _tail_values(ordered, keys, last, specs)
    carries, carry = [], None
    for part in sizes:
        own = tails[part]
        if carry is not None and carry[0] == first[part]:
            carries.append((part, *first[part], *carry[1]))
            if last[part] == first[part]:
                own = tuple(_merge_value(specs[i][1], carry[1][i], v) for i, v in enumerate(own))
        carry = (last[part], own)
    if not carries:
        return local

    schema = T.StructType(
        [
            T.StructField(PART, T.IntegerType()),
            *[T.StructField(f"__k{i}", ordered.schema[k].dataType) for i, k in enumerate(keys)],
            *[T.StructField(f"__c{i}", local.schema[out].dataType) for i, (out, _, _) in enumerate(specs)],
        ]
    )
    joined = local.join(_side_table(ordered, carries, schema), PART, "left")
    same = F.lit(True)
    for i, key in enumerate(key_cols):
        same = same & key.eqNullSafe(F.col(f"__k{i}"))
    merged = {
        out: F.when(same, _MERGE[kind](F.col(f"__c{i}"), ident(out))).otherwise(ident(out))
        for i, (out, kind, _) in enumerate(specs)
    }
    return joined.select(*[merged[c].alias(c) if c in merged else ident(c) for c in local.columns])


def previous_value(
    df: DataFrame,
    column: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    name: str = "previous",
    partitions: int | None = None,
) -> DataFrame:
    """Value of the row before, null on the first row (of each key)."""
    ordered = range_ordered(df, [*partition_by, *order_by], partitions)
    # A struct is never null, so a null value of the row before is kept.
    boxed = running(ordered, partition_by, {name: ("last", F.struct(ident(column).alias("v")))}, before=True)
    return boxed.withColumn(name, ident(name).getField("v")).drop(PART, POS)


def consecutive_diff(
    df: DataFrame,
    column: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    name: str = "diff",
    partitions: int | None = None,
) -> DataFrame:
    """Value minus the value of the row before."""
    with_previous = previous_value(df, column, order_by, partition_by, "__previous", partitions)
    return with_previous.withColumn(name, ident(column) - F.col("__previous")).drop("__previous")


def source_order(df: DataFrame) -> DataFrame:
    """Add the order of rows in the files just scanned, as one sortable struct.

    Only directly on a file scan: a partition may pack splits of many files in
    any order, but inside one split the generated id rises with the row.
    """
    return df.withColumn(
        "__source_order",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )
