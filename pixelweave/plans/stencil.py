"""Moving 2-D neighbourhoods as equi-joins and as tiles with a halo; windows are clipped at the edges of the grid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def offsets(ny: int, nx: int, half: bool = True) -> list[tuple[int, int]]:
    """Offsets (dy, dx) of a window without its centre; with half, one of each opposite pair."""
    every = [(dy, dx) for dy in range(-ny, ny + 1) for dx in range(-nx, nx + 1) if (dy, dx) != (0, 0)]
    return [o for o in every if o > (0, 0)] if half else every


def offset_column(pairs: list[tuple[int, int]]) -> Column:
    """The offsets as an array literal, to be exploded."""
    return F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in pairs])


def neighbour_pairs(pixels: DataFrame, ny: int, nx: int, half: bool = True) -> DataFrame:
    """Each pixel (y, x and more) with the pixels of its window: y, x, dy, dx, `a` and `b`, structs of the other columns.

    A shifted key makes this an equi-join; a condition on distances would plan as a nested loop.
    """
    rest = [c for c in pixels.columns if c not in ("y", "x")]
    left = pixels.select("y", "x", F.struct(*rest).alias("a") if rest else F.lit(0).alias("a"), F.explode(offset_column(offsets(ny, nx, half))).alias("o"))
    left = left.select("y", "x", "a", "o.dy", "o.dx", (F.col("y") + F.col("o.dy")).alias("qy"), (F.col("x") + F.col("o.dx")).alias("qx"))
    right = pixels.select(F.col("y").alias("qy"), F.col("x").alias("qx"), F.struct(*rest).alias("b") if rest else F.lit(0).alias("b"))
    return left.join(right, ["qy", "qx"]).select("y", "x", "dy", "dx", "a", "b")


def tiles(pixels: DataFrame, size: int, ny: int, nx: int) -> DataFrame:
    """Pixels dealt into square tiles (ty, tx) with copies in the tiles whose halo they are in; `own` marks the tile's own.

    A pixel is copied only into tiles that its window reaches, so interior pixels are not replicated.
    """
    if size < max(ny, nx):
        raise ValueError("a tile must be as large as its halo")
    lo, hi = lambda c, n: F.floor((F.col(c) - n) / size), lambda c, n: F.floor((F.col(c) + n) / size)
    out = pixels.withColumn("ty", F.explode(F.sequence(lo("y", ny), hi("y", ny)))).withColumn("tx", F.explode(F.sequence(lo("x", nx), hi("x", nx))))
    return out.withColumn("own", (F.col("ty") == F.floor(F.col("y") / size)) & (F.col("tx") == F.floor(F.col("x") / size)))


def tile_grid(y: np.ndarray, x: np.ndarray, ny: int, nx: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of a tile's pixels on a grid with a margin of the window, -1 for no pixel, and the pixels' places on it."""
    gy, gx = y - y.min() + ny, x - x.min() + nx
    grid = np.full((gy.max() + ny + 1, gx.max() + nx + 1), -1)
    grid[gy, gx] = np.arange(len(y))
    return grid, gy, gx


def window_rows(grid: np.ndarray, gy: np.ndarray, gx: np.ndarray, masks: np.ndarray, ny: int, nx: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (pixels x window) of the neighbours that a bit mask has, and which there are."""
    flat = np.arange((2 * ny + 1) * (2 * nx + 1))
    bit = (masks[:, flat // 32] >> (flat % 32)) & 1
    rows = grid[gy[:, None] + flat // (2 * nx + 1) - ny, gx[:, None] + flat % (2 * nx + 1) - nx]
    return np.maximum(rows, 0), (bit == 1) & (rows >= 0)
