"""Correlations of all column pairs from tiled matrix products.

Columns are cut into blocks and the pairs of two blocks are a tile. A task keeps
one array of moments per tile and sends it as one row; rows of a tile are merged
by the pairwise formula for moments, so no pair of columns is ever a row before
the result, and no statistic has to be known beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..functions.text import ident, is_numeric

#: Columns of a block; a tile of moments is 10 * BLOCK * BLOCK doubles (1.3 MB).
BLOCK = 128
#: Tiles that a task holds at once; further ones take another pass over their columns.
TILES_A_PASS = 128
#: Spreads below this share of the squares they come from are rounding.
TINY = 1e-13

Moments = np.ndarray  # (10, columns, columns), in the order of _moments


def _moments(x, seen_x, shift_x, y, seen_y, shift_y) -> Moments:
    """Rows, shifts, means less shifts, sums about the means and plain squares, over
    complete pairs of shifted columns in which gaps are zero."""
    n = seen_x.T @ seen_y
    d = np.maximum(n, 1)
    mean_x, mean_y = (x.T @ seen_y) / d, (seen_x.T @ y) / d
    squares_x, squares_y = (x * x).T @ seen_y, seen_x.T @ (y * y)
    return np.stack(
        [
            n,
            np.broadcast_to(shift_x[:, None], n.shape),
            np.broadcast_to(shift_y[None, :], n.shape),
            mean_x,
            mean_y,
            squares_x - n * mean_x**2,
            squares_y - n * mean_y**2,
            x.T @ y - n * mean_x * mean_y,
            squares_x,
            squares_y,
        ]
    )


def _merged(one: Moments | None, two: Moments) -> Moments:
    """Moments of the rows of both. Means stay apart from the shifts, so that a large
    level costs them no digits."""
    if one is None:
        return two
    n = one[0] + two[0]
    part = two[0] / np.maximum(n, 1)
    weight = one[0] * part
    out = one + two
    apart = []
    for shift, mean in ((1, 3), (2, 4)):
        d = np.where(weight > 0, (two[shift] - one[shift]) + (two[mean] - one[mean]), 0.0)
        out[shift] = np.where(one[0] > 0, one[shift], two[shift])
        out[mean] = np.where(one[0] > 0, one[mean] + part * d, two[mean])
        apart.append(d)
    dx, dy = apart
    for i, product in ((5, dx * dx), (6, dy * dy), (7, dx * dy), (8, dx * dx), (9, dy * dy)):
        out[i] += weight * product
    return out


def _blocks(width: int) -> list[tuple[int, int]]:
    return [(i, min(i + BLOCK, width)) for i in range(0, width, BLOCK)]


def _tile_sums(tiles: list[tuple[int, int]], places: dict[int, slice]):
    """Per task: one row of moments for each tile (a pair of block numbers)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], Moments] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = batch.to_numpy(dtype=float)
            seen = np.isfinite(x)
            # Any shift is right; one near the values keeps their digits.
            shift = np.array([np.median(column[at]) if at.any() else 0.0 for column, at in zip(x.T, seen.T, strict=True)])
            x = np.where(seen, x - shift, 0.0)
            seen = seen.astype(float)
            with np.errstate(over="ignore", invalid="ignore"):
                for tile in tiles:
                    i, j = (places[b] for b in tile)
                    held[tile] = _merged(held.get(tile), _moments(x[:, i], seen[:, i], shift[i], x[:, j], seen[:, j], shift[j]))
        for (i, j), moments in held.items():
            yield pd.DataFrame({"i": [i], "j": [j], "moments": [moments.tobytes()]}).astype({"i": "int32", "j": "int32"})

    return run


def _coefficients(moments: Moments) -> np.ndarray:
    xx, yy, xy, squares_x, squares_y = moments[5:]
    with np.errstate(all="ignore"):
        r = np.where((xx > TINY * squares_x) & (yy > TINY * squares_y), xy / (np.sqrt(xx) * np.sqrt(yy)), 0.0)
    return np.clip(np.where(np.isfinite(r), r, 0.0), -1.0, 1.0)


def _tile_pairs(columns: list[str]):
    """Both orders of every pair of a tile, from the tasks' moments in bounded memory."""
    names, blocks = np.array(columns, dtype=object), _blocks(len(columns))

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (a, a_end), (b, b_end) = blocks[key[0]], blocks[key[1]]
        total = None
        for batch in batches:
            for raw in batch["moments"]:
                total = _merged(total, np.frombuffer(raw).reshape(10, a_end - a, b_end - b))
        r = _coefficients(total)
        left, right = np.triu_indices(a_end - a, 1) if a == b else (x.ravel() for x in np.indices(r.shape))
        for one, two in ((a + left, b + right), (b + right, a + left)):
            yield pd.DataFrame({"column_a": names[one], "column_b": names[two], "correlation": r[left, right]})

    return run


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_a, column_b, correlation) for every ordered pair off the diagonal.

    Pearson over the rows where both are finite, within [-1, 1]; undefined counts
    as 0, and a table without rows has no pairs. Values are taken from near their
    column's median in each batch, so neither a large level nor a few far values
    cost digits. One pass serves about 2,000 columns; wider tables take a pass for
    each further group of tiles, so the memory of a task does not grow with them.
    """
    columns = list(columns or [f.name for f in df.schema.fields if is_numeric(f.dataType)])
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")
    blocks = _blocks(len(columns))
    tiles = [(i, j) for i in range(len(blocks)) for j in range(i, len(blocks))]
    passes = []
    for at in range(0, len(tiles), TILES_A_PASS):
        group = tiles[at : at + TILES_A_PASS]
        wanted, places, cells = sorted({b for tile in group for b in tile}), {}, []
        for b in wanted:
            first, end = blocks[b]
            places[b] = slice(len(cells), len(cells) + end - first)
            cells += [finite(ident(columns[c]).cast("double")).alias(f"v{c}") for c in range(first, end)]
        passes.append(df.select(*cells).mapInPandas(_tile_sums(group, places), "i int, j int, moments binary"))
    sums = reduce(DataFrame.union, passes)
    return sums.groupBy("i", "j").applyInPandas(_tile_pairs(columns), "column_a string, column_b string, correlation double")
