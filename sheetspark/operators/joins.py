"""Joins of sheets.

No join carries a broadcast hint: Spark broadcasts a side when its measured
size is below the session threshold and shuffles otherwise. Hot keys are left
to the adaptive skew split, so the plans use join types that split allows
(left and left anti, not full outer), and a side is de-duplicated before the
shuffle wherever the result does not depend on its repeats.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_text, ident
from .clean import stringify_keys, trim_names


def merge_sheets(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join on text keys ('' for null), without duplicate rows.

    Right columns whose name the left has are dropped. Both sides are distinct
    before the join, which makes the result distinct as well. The full join is
    written as left join plus right-only rows: those two split hot keys.
    """
    left, right = trim_names(left), trim_names(right)
    on = [c.strip() for c in on]
    for side, df in (("left", left), ("right", right)):
        missing = [c for c in on if c not in df.columns]
        if missing:
            raise ValueError(f"columns not found in {side} sheet: {missing}")
    left_only = [c for c in left.columns if c not in on]
    right_only = [c for c in right.columns if c not in on and c not in left_only]
    lefts = stringify_keys(left, on).select(*map(ident, [*on, *left_only])).distinct()
    rights = stringify_keys(right, on).select(*map(ident, [*on, *right_only])).distinct()
    matched = lefts.join(rights, on, "left")
    right_rest = rights.join(lefts.select(*map(ident, on)).distinct(), on, "left_anti")
    order = [*on, *left_only, *right_only]
    return matched.unionByName(right_rest, allowMissingColumns=True).select(*map(ident, order))


def mapped_columns(mapping: DataFrame, key: str) -> list[str]:
    """Columns right of the key, up to the first blank or ``Unnamed`` header."""
    run = []
    for column in mapping.columns[mapping.columns.index(key) + 1 :]:
        if not column or column.startswith("Unnamed"):
            break
        run.append(column)
    return run


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur on more than one row, with their count."""
    return df.groupBy(ident(key)).agg(F.count("*").alias("rows")).where("rows > 1")


def _free_name(name: str, taken: Sequence[str]) -> str:
    while name in taken:
        name += "_map"
    return name


def map_columns(
    df: DataFrame,
    mapping: DataFrame,
    pairs: Mapping[str, str],
    fill: str | None = "NA",
    require_unique: bool = False,
) -> DataFrame:
    """Look up columns of ``mapping`` for each (column, mapping key) pair in turn.

    Null matches null. Rows without a match show ``fill`` (with ``fill`` the
    looked-up columns become text; ``None`` keeps types and nulls). Repeated
    keys multiply rows unless ``require_unique`` forbids them. A looked-up
    column whose name is taken gets the suffix ``_map``.
    """
    for column, key in pairs.items():
        if column not in df.columns or key not in mapping.columns:
            continue
        looked_up = mapped_columns(mapping, key)
        if not looked_up:
            continue
        if require_unique and repeated_keys(mapping, key).limit(1).count():
            raise ValueError(f"mapping key {key!r} is not unique")
        names: list[str] = []
        for name in looked_up:
            names.append(_free_name(name, [*df.columns, *names]))
        left_type, right_type = df.schema[column].dataType, mapping.schema[key].dataType
        as_is = left_type == right_type
        left_key = ident(column) if as_is else as_text(ident(column), left_type)
        right_key = ident(key) if as_is else as_text(ident(key), right_type)
        side = mapping.select(
            right_key.alias("__key"),
            *[
                (as_text(ident(c), mapping.schema[c].dataType) if fill is not None else ident(c)).alias(n)
                for c, n in zip(looked_up, names)
            ],
        )
        joined = df.withColumn("__left", left_key).join(side, F.col("__left").eqNullSafe(F.col("__key")), "left")
        shown = [F.coalesce(ident(n), F.lit(fill)).alias(n) if fill is not None else ident(n) for n in names]
        df = joined.select(*map(ident, df.columns), *shown)
    return df


def reconcile(registered: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Registered against found files: flags ``exists_in_db``, ``exists_in_fs``.

    Two existence flags need no join: one partial aggregate over both lists.
    """
    names = [ident(c) for c in keys]
    both = registered.select(*names, F.lit(True).alias("db"), F.lit(False).alias("fs")).unionByName(
        found.select(*names, F.lit(False).alias("db"), F.lit(True).alias("fs"))
    )
    return both.groupBy(*names).agg(F.bool_or("db").alias("exists_in_db"), F.bool_or("fs").alias("exists_in_fs"))


def unregistered(registered: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files found but not registered."""
    return reconcile(registered, found, keys).where("exists_in_fs and not exists_in_db").select(*map(ident, keys))
