"""Keyed tables: newest row, upsert, delete, retention, pages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ident
from .order import row_index

# A sorted top-n this small is merged on the driver.
SHALLOW_ROWS = 10_000
# Rows of a sample that brackets a deeper page.
SAMPLE_ROWS = 20_000


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order_by`` of each key.

    An aggregate, not a window: each task sends one row per key to the shuffle.
    """
    row = F.struct(*map(ident, df.columns))
    newest = df.groupBy(*map(ident, keys)).agg(F.max_by(row, F.struct(*map(ident, order_by))).alias("__row"))
    return newest.select("__row.*")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """Table after insert-or-replace, with flag ``created`` on the new rows.

    ``created`` is true for inserted, false for replaced and null for untouched
    rows. The table only meets the keys of ``rows``, so a small batch never
    shuffles a large table.
    """
    incoming = latest_per_key(rows, keys, order_by) if order_by else rows
    touched = incoming.select(*map(ident, keys)).distinct()
    untouched = table.join(touched, list(keys), "left_anti").select(*map(ident, table.columns))
    known = (
        table.select(*map(ident, keys))
        .join(touched, list(keys), "left_semi")
        .distinct()
        .withColumn("__known", F.lit(True))
    )
    flagged = incoming.join(known, list(keys), "left").select(
        *map(ident, table.columns), F.col("__known").isNull().alias("created")
    )
    return untouched.withColumn("created", F.lit(None).cast("boolean")).unionByName(flagged)


def delete_by_key(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    doomed = gone.select(*map(ident, keys)).distinct()
    return table.join(doomed, list(keys), "left_anti").select(*map(ident, table.columns))


def deactivate(df: DataFrame, condition: Column | str, now: datetime | Column, flag: str = "is_active", stamp: str = "updated_at") -> DataFrame:
    """Soft delete: clear the flag and stamp the time of the matching rows."""
    hit = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False)) & ident(flag)
    when = now if isinstance(now, Column) else F.lit(now)
    stamped = F.when(hit, when.cast(df.schema[stamp].dataType)).otherwise(ident(stamp))
    cleared = F.when(hit, F.lit(False)).otherwise(ident(flag))
    changes = {flag: cleared, stamp: stamped}
    return df.select(*[changes[c].alias(c) if c in changes else ident(c) for c in df.columns])


def retain(df: DataFrame, column: str, cutoff: datetime | date | Column | None) -> DataFrame:
    """Rows at or after the cutoff; without a cutoff nothing is kept."""
    if cutoff is None:
        return df.limit(0)
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return df.where(ident(column) >= limit)


def retention_report(df: DataFrame, column: str, cutoff: datetime | date | Column | None) -> DataFrame:
    """(kept, deleted) counts of :func:`retain`."""
    if cutoff is None:
        return df.agg(F.lit(0).cast("long").alias("kept"), F.count("*").alias("deleted"))
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return df.agg(
        F.count_if(ident(column) >= limit).alias("kept"),
        F.count_if(~F.coalesce(ident(column) >= limit, F.lit(False))).alias("deleted"),
    )


def recent_first(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*[ident(c).desc() for c in columns])


def head(df: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    """First n rows of the order: a top-n per task, then a merge of those."""
    keys = [ident(c) if isinstance(c, str) else c for c in order_by]
    return df.orderBy(*keys).limit(n)


def _bracket(df: DataFrame, order_by: Sequence[str | Column], start: int, size: int, total: int) -> tuple[DataFrame, int] | None:
    """At most ``SHALLOW_ROWS`` rows that hold the page, and how many come before them."""
    plain = (T.StringType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    if size > SHALLOW_ROWS or not all(isinstance(k, str) and isinstance(df.schema[k].dataType, plain) for k in order_by):
        return None
    key = F.struct(*[ident(k).alias(f"k{i}") for i, k in enumerate(order_by)])
    keyed, before, inside = df, 0, total
    while inside > SHALLOW_ROWS:
        sample = keyed.select(key.alias("key")).sample(min(1.0, SAMPLE_ROWS / inside), seed=7).orderBy("key").collect()
        n = len(sample)
        # Four deviations of a sampled rank on either side of the page.
        slack = int(2 * n**0.5) + 2
        low = n * (start - before) // inside - slack
        high = n * (start - before + size) // inside + slack
        edges = [sample[i]["key"] if 0 <= i < n else None for i in (low, high)]
        if edges == [None, None]:
            return None
        cuts = [None if e is None else F.struct(*[F.lit(v).cast(df.schema[k].dataType) for k, v in zip(order_by, e, strict=True)]) for e in edges]
        after_low = F.lit(True) if cuts[0] is None else key >= cuts[0]
        until_high = F.lit(True) if cuts[1] is None else key <= cuts[1]
        skipped, within = keyed.agg(F.count_if(~after_low), F.count_if(after_low & until_high)).first()
        if not before + skipped <= start or before + skipped + within < min(start + size, total) or within >= inside:
            return None
        keyed, before, inside = keyed.where(after_low & until_high), before + skipped, within
    return keyed, before


def page(
    df: DataFrame,
    order_by: Sequence[str | Column],
    page: int = 1,
    size: int = 50,
    past_end: str = "empty",
) -> DataFrame:
    """Rows of one page with ``total_count``, ``total_pages`` and neighbour flags.

    ``past_end`` is ``empty`` or ``last``. Early pages are a distributed top-n. For
    deeper ones, by columns in ascending order, samples of the keys bracket the page
    and passes that only count find how many rows come before the bracket, until it is
    small enough for a top-n of its own: nothing is sorted or written as a whole. Other
    orders, and pages among more equal keys than that, take a range of the row index.
    """
    total = df.count()
    pages = max(1, -(-total // size))
    number = min(max(page, 1), pages) if past_end == "last" else max(page, 1)
    start = (number - 1) * size
    keys = [ident(c) if isinstance(c, str) else c for c in order_by]
    if start + size <= SHALLOW_ROWS or start >= total:
        rows = df.orderBy(*keys).offset(start).limit(size) if start < total else df.limit(0)
    elif (held := _bracket(df, order_by, start, size, total)) is not None:
        rows = held[0].orderBy(*keys).offset(start - held[1]).limit(size)
    else:
        rows = row_index(df, keys, "__index").where(F.col("__index").between(start, start + size - 1)).drop("__index")
    return rows.select(
        "*",
        F.lit(number).alias("page"),
        F.lit(total).cast("long").alias("total_count"),
        F.lit(pages).alias("total_pages"),
        F.lit(number < pages).alias("has_next"),
        F.lit(number > 1).alias("has_previous"),
    )
