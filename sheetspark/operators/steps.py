"""User steps on a sheet, and recipes of steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from inspect import signature
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ident
from . import chart, clean, dates, filters, joins, reshape, tables, types, unions

#: State rows that a task holds before it merges them.
MERGED_ROWS = 100_000


def run_step(df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a user function; it must return a table."""
    result = step(df)
    if not isinstance(result, DataFrame):
        raise TypeError("a step must return a DataFrame")
    return result


def run_sql_step(df: DataFrame, sql: str) -> DataFrame:
    """Run a query over the sheet under the name ``{df}``."""
    return df.sparkSession.sql(sql, df=df)


def run_pandas_step(
    df: DataFrame,
    step: Callable,
    schema: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Run pandas code on batches of rows, or on the groups of ``by``.

    Without ``by`` the step takes a frame and returns one. With ``by``, a step of two
    parameters takes the key as a tuple and an iterator of frames, the rows of one group
    some at a time, and yields frames: a group of any size passes through one task in
    bounded memory. A step of one parameter takes the whole group as one frame, for
    code that needs it; such a group must fit a task. Where partial results can be
    merged, :func:`run_pandas_aggregate` also spreads the work of a large group.
    """
    if not by:

        def over_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield step(batch)

        return df.mapInPandas(over_batches, schema)
    grouped = _spread(df, by).groupBy(*[ident(c) for c in by])
    if len(signature(step).parameters) == 1:
        return grouped.applyInPandas(step, schema)

    def over_group(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from step(key, batches)

    return grouped.applyInPandas(_hinted(over_group), schema)


def _hinted(step: Callable) -> Callable:
    """The step with the types by which Spark tells the iterator form."""
    step.__annotations__ = {"key": tuple[Any, ...], "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return step


def _spread(df: DataFrame, by: Sequence[str]) -> DataFrame:
    # Python is the cost here: a fixed number of tasks keeps small tables from
    # being merged into one.
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *[ident(c) for c in by])


def run_pandas_aggregate(
    df: DataFrame,
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    state: str,
    by: Sequence[str],
    finish: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    schema: str | None = None,
) -> DataFrame:
    """Group results by pandas code that can merge its own partial results.

    ``partial`` turns rows into state rows of any number of groups, where the rows are;
    ``merge`` turns state rows of many groups into one state row a group, in the same
    columns. Tasks merge their batches before the shuffle, so a group with any share of
    the rows reaches it as one row from each task. ``finish`` turns state
    rows into result rows of ``schema``.
    """

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, least = [], 0, MERGED_ROWS
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= least:
                held = [merge(pd.concat(held, ignore_index=True))]
                rows = len(held[0])
                # Groups that do not shrink any more go on, so memory is bounded.
                if 2 * rows >= least:
                    yield held[0]
                    held, rows = [], 0
        if held:
            yield merge(pd.concat(held, ignore_index=True))

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from merged(partial(batch) for batch in batches)

    def last(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = None
        for batch in batches:
            found = merge(batch if found is None else pd.concat([found, batch], ignore_index=True))
        yield found if finish is None else finish(found)

    states = df.mapInPandas(partials, state)
    return _spread(states, by).groupBy(*[ident(c) for c in by]).applyInPandas(_hinted(last), schema or state)


def check_result_size(df: DataFrame, limit: int) -> DataFrame:
    """The table itself, or an error when it has more than ``limit`` rows."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"resulting table is too large (limit {limit} rows)")
    return df


STEPS: dict[str, Callable[..., DataFrame]] = {
    "lowercase": clean.lowercase,
    "remove_spaces": clean.remove_spaces,
    "remove_chars": clean.remove_chars,
    "clean": clean.clean,
    "collapse_ws": clean.collapse_ws,
    "fill_missing": clean.fill_missing,
    "null_infinite": clean.null_infinite,
    "round_numeric": clean.round_numeric,
    "stringify_keys": clean.stringify_keys,
    "trim_names": clean.trim_names,
    "sanitize_names": clean.sanitize_names,
    "select_in_order": clean.select_in_order,
    "add_constant": clean.add_constant,
    "export_text": clean.export_text,
    "coerce_numeric": types.coerce_numeric,
    "filter_equal": filters.filter_equal,
    "filter_time": filters.filter_time,
    "filter_expr": filters.filter_expr,
    "exclude_any": filters.exclude_any,
    "in_list": filters.in_list,
    "map_columns": joins.map_columns,
    "merge_sheets": joins.merge_sheets,
    "melt": reshape.melt,
    "pivot": reshape.pivot,
    "stacked": reshape.stacked,
    "stacked100": reshape.stacked100,
    "dedupe": unions.dedupe,
    "add_date_columns": dates.add_date_columns,
    "chart_aggregate": chart.chart_aggregate,
    "group_mean": chart.group_mean,
    "latest_per_key": tables.latest_per_key,
    "sql": run_sql_step,
}


def recipe(df: DataFrame, steps: Sequence[tuple[str, dict[str, Any]]]) -> DataFrame:
    """Replay named steps with their options, in order, on any sheet."""
    unknown = [name for name, _ in steps if name not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps: {unknown}")
    for name, options in steps:
        df = run_step(df, lambda sheet, name=name, options=options: STEPS[name](sheet, **options))
    return df
