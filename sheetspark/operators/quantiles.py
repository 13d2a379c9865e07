"""Exact quantiles of whole columns without gathering a column in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ident
from .order import range_ordered, running

ACCURACY = 10_000
# Up to this many values the built-in exact percentile fits one task's buffer.
BUFFERED_VALUES = 4_000_000


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    buffered_values: int = BUFFERED_VALUES,
    partitions: int | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each column, nulls and NaN left out.

    Large inputs: a sketch brackets each quantile, one pass counts what lies
    below every bracket, and only the values inside the brackets are counted by
    value and range-sorted. The sketch only narrows the search; a bracket that
    misses its rank is widened to the whole column.
    """
    columns, probs = list(columns), [float(p) for p in probabilities]
    if not columns:
        return {}
    numbers = df.select(*[F.nullif(ident(c).cast("double"), F.lit(float("nan"))).alias(f"v{i}") for i, c in enumerate(columns)])
    if numbers.count() * len(columns) <= buffered_values:
        row = numbers.agg(*[F.percentile(f"v{i}", probs).alias(f"q{i}") for i in range(len(columns))]).first()
        return {c: list(row[f"q{i}"] or [None] * len(probs)) for i, c in enumerate(columns)}

    margin = 2.0 / ACCURACY
    lows, highs = [max(0.0, p - margin) for p in probs], [min(1.0, p + margin) for p in probs]
    sketch = numbers.agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))],
        *[F.min(f"v{i}").alias(f"min{i}") for i in range(len(columns))],
        *[F.max(f"v{i}").alias(f"max{i}") for i in range(len(columns))],
        *[F.percentile_approx(f"v{i}", lows + highs, ACCURACY).alias(f"q{i}") for i in range(len(columns))],
    ).first()
    brackets, ranks = {}, {}
    for i in range(len(columns)):
        count = sketch[f"n{i}"]
        for j, p in enumerate(probs):
            if count:
                place = (count - 1) * p
                ranks[i, j] = (floor(place), ceil(place), place - floor(place))
                found = sketch[f"q{i}"]
                brackets[i, j] = (found[j], found[len(probs) + j])
    if not ranks:
        return {c: [None] * len(probs) for c in columns}
    counts = numbers.agg(
        *[F.count_if(F.col(f"v{i}") < lo).alias(f"below_{i}_{j}") for (i, j), (lo, _) in brackets.items()],
        *[F.count_if(F.col(f"v{i}") <= hi).alias(f"upto_{i}_{j}") for (i, j), (_, hi) in brackets.items()],
    ).first()
    below = {}
    for i, j in brackets:
        below[i, j] = counts[f"below_{i}_{j}"]
        if ranks[i, j][0] < below[i, j] or ranks[i, j][1] >= counts[f"upto_{i}_{j}"]:
            brackets[i, j], below[i, j] = (sketch[f"min{i}"], sketch[f"max{i}"]), 0

    inside = [
        F.when(
            F.col(f"v{i}").between(*brackets[i, j]),
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{i}").alias("v")),
        )
        for i, j in brackets
    ]
    near = reduce(lambda a, b: a | b, [F.col(f"v{i}").between(lo, hi) for (i, _), (lo, hi) in brackets.items()])
    by_value = (
        numbers.where(near)
        .select(F.explode(F.array_compact(F.array(*inside))).alias("e"))
        .select("e.*")
        .groupBy("i", "j", "v")
        .agg(F.count("*").alias("n"))
    )
    ranked = running(range_ordered(by_value, ["i", "j", "v"], partitions), ["i", "j"], {"upto": ("sum", "n")})
    # A row covers the ranks [upto - n, upto) counted from the bracket's start.
    wanted = None
    for (i, j), (first, second, _) in ranks.items():
        for rank in {first - below[i, j], second - below[i, j]}:
            hit = (F.col("i") == i) & (F.col("j") == j) & (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
            wanted = hit if wanted is None else wanted | hit
    picked: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for row in ranked.where(wanted).collect():
        picked.setdefault((row["i"], row["j"]), []).append((row["upto"] - row["n"], row["upto"], row["v"]))
    result = {}
    for i, name in enumerate(columns):
        values: list[float | None] = []
        for j in range(len(probs)):
            if (i, j) not in ranks:
                values.append(None)
                continue
            first, second, share = ranks[i, j]
            lo, hi = (
                next(v for start, end, v in picked[i, j] if start <= rank - below[i, j] < end)
                for rank in (first, second)
            )
            values.append((1 - share) * lo + share * hi if share and hi != lo else lo)
        result[name] = values
    return result
