"""Aggregation over self-similar neighbourhoods: amplitudes, interferograms, coherence and coherence matrices.

Edges become bit masks by one partial aggregation. Pixels are dealt into tiles with a halo, each with its mask, so that
samples are copied only into the tiles that their window reaches and no window is joined; a task holds one tile.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stencil import tile_grid, tiles, window_rows
from .neighbours import bit_masks


def _within(edges: DataFrame, ny: int, nx: int) -> DataFrame:
    """Edges with an error for those beyond the window, which no mask could hold."""
    fits = (F.abs("dy") <= ny) & (F.abs("dx") <= nx)
    return edges.select("y", "x", F.when(fits, F.col("dy")).otherwise(F.raise_error(F.lit("an edge is longer than the window")).cast("int")).alias("dy"), "dx")


def over_windows(edges: DataFrame, values: DataFrame, work: Callable[[np.ndarray, np.ndarray], dict], schema: str, ny: int, nx: int, tile: int, batch: int = 64, centred: bool = True) -> DataFrame:
    """work(z, member) for the pixels of values (y, x, re, im: arrays of equal lengths) that have edges, some at a time: z
    is pixels x window x bands, complex, member tells which neighbours an edge leads to. It returns columns with an entry
    (or an array of them) for each pixel. centred: only pixels whose own bit is set."""
    words = -(-(2 * ny + 1) * (2 * nx + 1) // 32)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(pdf.re.to_numpy()).astype(float) + 1j * np.stack(pdf.im.to_numpy()).astype(float)
        y, x = pdf.y.to_numpy(), pdf.x.to_numpy()
        grid, gy, gx = tile_grid(y, x, ny, nx)
        own = np.flatnonzero(pdf.own.to_numpy() & pdf["mask"].notna().to_numpy())
        out = []
        for at in range(0, len(own), batch):
            some = own[at : at + batch]
            masks = np.stack(pdf["mask"].to_numpy()[some]).astype(np.int64).reshape(len(some), words)
            rows, member = window_rows(grid, gy[some], gx[some], masks, ny, nx)
            ok = member[:, member.shape[1] // 2] if centred else member.any(axis=1)
            some, rows, member = some[ok], rows[ok], member[ok]
            if len(some):
                found = work(z[rows], member)
                times = len(next(iter(found.values()))) // len(some)
                out.append(pd.DataFrame({"y": np.repeat(y[some], times), "x": np.repeat(x[some], times)} | found))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in f"y int, x int, {schema}".split(", ")})

    pixels = values.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "re", "im")
    masks = bit_masks(_within(edges, ny, nx), ny, nx).select("y", "x", "mask")
    return tiles(pixels.join(masks, ["y", "x"], "left"), max(tile, ny, nx), ny, nx).groupBy("ty", "tx").applyInPandas(kernel, f"y int, x int, {schema}")


def _bands(*bands: DataFrame) -> DataFrame:
    """Bands (y, x, re, im) of the same pixels as arrays."""
    out = bands[0].select("y", "x", F.array("re").alias("re"), F.array("im").alias("im"))
    for b in bands[1:]:
        out = out.join(b.select("y", "x", F.col("re").alias("r"), F.col("im").alias("i")), ["y", "x"])
        out = out.select("y", "x", F.concat("re", F.array("r")).alias("re"), F.concat("im", F.array("i")).alias("im"))
    return out


def mean_amplitude(edges: DataFrame, band: DataFrame, ny: int = 5, nx: int = 5, tile: int = 32) -> DataFrame:
    """y, x, amp: the mean amplitude over a pixel's neighbours; band has y, x, re, im. Only pixels whose own bit is set
    have a result here and below."""
    work = lambda z, m: {"amp": np.where(m, np.abs(z[:, :, 0]), 0).sum(axis=1) / m.sum(axis=1)}
    return over_windows(edges, _bands(band), work, "amp double", ny, nx, tile)


def _products(z: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Sums over the neighbours of z_i conj(z_j): pixels x bands x bands."""
    z = np.where(member[:, :, None], z, 0)
    return np.einsum("pwi,pwj->pij", z, z.conj(), optimize=True)


def _normalised(c: np.ndarray) -> np.ndarray:
    """Divided by the root of both powers; 0 where either has none."""
    power = np.sqrt(np.einsum("pii->pi", c).real)
    norm = power[:, :, None] * power[:, None, :]
    return np.divide(c, norm, out=np.zeros_like(c), where=norm > 0)


def interferogram(edges: DataFrame, a: DataFrame, b: DataFrame, ny: int = 5, nx: int = 5, tile: int = 32) -> DataFrame:
    """y, x, re, im: the mean of a times the conjugate of b over a pixel's neighbours."""

    def work(z: np.ndarray, member: np.ndarray) -> dict:
        mean = _products(z, member)[:, 0, 1] / member.sum(axis=1)
        return {"re": mean.real, "im": mean.imag}

    return over_windows(edges, _bands(a, b), work, "re double, im double", ny, nx, tile)


def coherence(edges: DataFrame, a: DataFrame, b: DataFrame, ny: int = 5, nx: int = 5, tile: int = 32) -> DataFrame:
    """y, x, re, im: the normalised complex correlation over a pixel's neighbours; 0 where either has no power."""

    def work(z: np.ndarray, member: np.ndarray) -> dict:
        c = _normalised(_products(z, member))[:, 0, 1]
        return {"re": c.real, "im": c.imag}

    return over_windows(edges, _bands(a, b), work, "re double, im double", ny, nx, tile)


def coherence_matrix(edges: DataFrame, wide: DataFrame, ny: int = 5, nx: int = 5, tile: int = 32) -> DataFrame:
    """y, x, n, ti, tj, re, im for ti < tj: the sample coherence matrix in long form (1 on its diagonal) of every pixel that
    has an edge. wide has one row per pixel."""

    def work(z: np.ndarray, member: np.ndarray) -> dict:
        i, j = np.triu_indices(z.shape[2], 1)
        c = _normalised(_products(z, member))[:, i, j]
        return {"n": np.repeat(member.sum(axis=1), len(i)), "ti": np.tile(i, len(c)), "tj": np.tile(j, len(c)), "re": c.real.ravel(), "im": c.imag.ravel()}

    return over_windows(edges, wide, work, "n long, ti int, tj int, re double, im double", ny, nx, tile, centred=False)


def pixel_matrix(edges: DataFrame, wide: DataFrame, y: int, x: int, ny: int = 5, nx: int = 5) -> DataFrame:
    """The coherence matrix of one pixel; filters on it and its window go to the edges and the scan."""
    near = wide.where(F.col("y").between(y - ny, y + ny) & F.col("x").between(x - nx, x + nx))
    return coherence_matrix(edges.where((F.col("y") == y) & (F.col("x") == x)), near, ny, nx)
