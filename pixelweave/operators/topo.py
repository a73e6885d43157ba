"""Grid searches: height from baselines, and height with rate."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def height_factor(wavelength: float, slant: Column, incidence_deg: Column) -> Column:
    """K = 4 pi / (wavelength slant sin(incidence)): radians per metre of height and metre of baseline."""
    return 4 * pi / (wavelength * slant * F.sin(F.radians(incidence_deg)))


def _best(z: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For z (pixels x acquisitions) turned by angle (pixels x candidates x acquisitions): the first candidate with the
    greatest coherence |sum| / sum of amplitudes, that coherence and the phase of its sum."""
    total = np.einsum("pn,pcn->pc", z, np.exp(1j * angle))
    amp = np.abs(z).sum(axis=1)
    coh = np.divide(np.abs(total), amp[:, None], out=np.zeros(total.shape), where=amp[:, None] > 0)
    k, rows = np.round(coh, 12).argmax(axis=1), np.arange(len(z))
    return k, coh[rows, k], np.angle(total[rows, k])


COARSE, FINE = np.arange(401) * 0.1 - 20.0, (np.arange(21) - 10) * 0.01


#: Pixels whose candidates are scored at once.
BATCH = 256


def _search(pixels: DataFrame, z: str, fields: tuple, extra: dict, search, new: str) -> DataFrame:
    """pixels with the results of search(z, values by field, values by extra column), an Arrow kernel over batches of rows."""

    given = list(extra)  # the kernel takes names along, not columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                values = [pa.array(c) for c in batch.columns]
                column = lambda f: np.stack([np.asarray(v, float) for v in batch.column(f"__{f}").to_pylist()])  # noqa: E731, B023
                found = search(column("re") + 1j * column("im"), {f: column(f) for f in fields}, {n: np.asarray(batch.column(n)) for n in given})
                keep = [(n, v) for n, v in zip(batch.schema.names, values) if not n.startswith("__")]
                yield pa.RecordBatch.from_arrays([v for _, v in keep] + [pa.array(v) for v in found.values()], [n for n, _ in keep] + list(found))

    def part(f: str) -> Column:
        return F.transform(z, lambda v: v[f].cast("double")).alias(f"__{f}")

    parts = [part(f) for f in ("re", "im", *fields)]
    columns = [c for c in pixels.columns if c != z]
    rows = pixels.select(*columns, *parts, *[v.cast("double").alias(n) for n, v in extra.items()])
    kinds = [f"`{c}` {pixels.schema[c].dataType.simpleString()}" for c in columns] + [f"{n} double" for n in extra if not n.startswith("__")]
    return rows.mapInArrow(run, ", ".join(kinds + [new]))


def topofit(pixels: DataFrame, k: Column, z: str = "z") -> DataFrame:
    """pixels, z left out, with h, k_h, coh, phase: the height in [-20, 20] of the most coherent sum of z exp(j K h B).

    z: array<struct<re, im, bperp>>, as many in each row. 401 heights, then 21 around the best one. The first of equally
    good heights is taken, so results do not depend on partitions.
    """

    def search(v: np.ndarray, at: dict, more: dict) -> dict:
        kb = more["__k"][:, None] * at["bperp"]
        i, _, _ = _best(v, COARSE[None, :, None] * kb[:, None, :])
        heights = COARSE[i][:, None] + FINE[None, :]
        j, coh, phase = _best(v, heights[:, :, None] * kb[:, None, :])
        h = heights[np.arange(len(v)), j]
        return {"h": h, "k_h": more["__k"] * h, "coh": coh, "phase": phase}

    return _search(pixels, z, ("bperp",), {"__k": k}, search, "h double, k_h double, coh double, phase double")


def topo_residual(pixels: DataFrame, wavelength: float, slant: Column, incidence_deg: Column, z: str = "z", sign: int = 1) -> DataFrame:
    """pixels with dz, the height by topofit, and coh. sign -1 gives the height of the conjugate phases."""
    conj = pixels.withColumn(z, F.transform(z, lambda v: F.struct(v["re"].alias("re"), (v["im"] * sign).alias("im"), v["bperp"].alias("bperp"))))
    out = topofit(conj, height_factor(wavelength, slant, incidence_deg), z)
    back = wavelength * slant * F.sin(F.radians(incidence_deg)) / (4 * pi)
    return out.withColumn("dz", F.col("k_h") * back).drop("h", "k_h", "phase")


def topofit_linear(phase: np.ndarray, bperp: np.ndarray, wraps: float = 4.0, steps: int = 8) -> tuple[float, float]:
    """K h and coherence of one pixel by a coarse grid over wraps and one weighted least-squares step: a cross-check."""
    span = bperp.max() - bperp.min()
    grid = np.arange(-int(steps * wraps), int(steps * wraps) + 1) * 2 * pi / steps / span
    z = np.exp(1j * phase)
    fit = np.abs((z[None, :] * np.exp(-1j * grid[:, None] * bperp)).sum(axis=1)) / len(z)
    k = grid[fit.argmax()]
    rest = z * np.exp(-1j * k * bperp)
    offset = np.angle(rest.sum())
    k += float(np.linalg.lstsq(np.stack([bperp], 1), np.angle(rest * np.exp(-1j * offset)), rcond=None)[0][0])
    return k, float(np.abs((z * np.exp(-1j * k * bperp)).sum()) / len(z))


def grid_search_2d(arcs: DataFrame, height: tuple[float, float] = (-40.0, 40.0), rate: tuple[float, float] = (-0.05, 0.05), n: int = 21, zooms: int = 3, z: str = "z") -> DataFrame:
    """arcs, z left out, with dz, rate, coh: the height and rate of the most coherent residual, on grids that zoom in by 5.

    z: array<struct<re, im, kb, kt>>, kb and kt being radians per metre and per metre a year of each acquisition.
    """
    a, b = (g.ravel() for g in np.meshgrid(np.linspace(-1, 1, n), np.linspace(-1, 1, n), indexing="ij"))

    def search(v: np.ndarray, at: dict, more: dict) -> dict:
        dz, speed = np.full(len(v), sum(height) / 2), np.full(len(v), sum(rate) / 2)
        half = [(height[1] - height[0]) / 2, (rate[1] - rate[0]) / 2]
        for _ in range(zooms):
            h, s = dz[:, None] + a * half[0], speed[:, None] + b * half[1]
            k, coh, _ = _best(v, -(h[:, :, None] * at["kb"][:, None, :] + s[:, :, None] * at["kt"][:, None, :]))
            rows = np.arange(len(v))
            dz, speed = h[rows, k], s[rows, k]
            half = [x / 5 for x in half]
        return {"dz": dz, "rate": speed, "coh": coh}

    return _search(arcs, z, ("kb", "kt"), {}, search, "dz double, rate double, coh double")
