"""Phase linking from sample coherence matrices: EVD, banded (STBAS), MLE, robust MLE and iterative MLE.

The estimators are a numpy kernel over batches of pixels. Pixels are dealt into tiles with a halo as wide as the window,
each with its bit mask; a tile's task forms the coherence matrices of its own pixels, so windows are not joined.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import RasterError
from ..plans.stencil import tile_grid, tiles, window_rows

EPS = 1e-6
METHODS = ("EVD", "STBAS", "MLE", "phase_link", "iterative")


def coherence_matrices(z: np.ndarray, member: np.ndarray) -> np.ndarray:
    """z: pixels x window x bands (complex), member: pixels x window. C_ij = sum z_i conj(z_j) / sqrt(powers), 1 on the diagonal."""
    z = np.where(member[:, :, None], z, 0)
    c = np.einsum("pwi,pwj->pij", z, z.conj(), optimize=True)
    power = np.sqrt(np.einsum("pii->pi", c).real)
    norm = power[:, :, None] * power[:, None, :]
    c = np.divide(c, norm, out=np.zeros_like(c), where=norm > 0)
    i = np.arange(c.shape[1])
    c[:, i, i] = 1
    return c


def _eigen(m: np.ndarray, largest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One eigenvalue and vector of each Hermitian matrix, and which have none."""
    bad = ~np.isfinite(m).all(axis=(1, 2))
    values, vectors = np.linalg.eigh(np.where(bad[:, None, None], np.eye(m.shape[1]), m))
    k = -1 if largest else 0
    return values[:, k], vectors[:, :, k], bad


def _evd(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value, v, bad = _eigen(c, True)
    return v, np.where(bad, -6, np.where(value < EPS, -7, 0))


def _banded(c: np.ndarray, bw: int) -> np.ndarray:
    i = np.arange(c.shape[1])
    return np.where(np.abs(i[:, None] - i[None, :]) <= bw, c, 0)


def _inverse(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses by Cholesky factors; where there is none the identity, and a mark."""
    out, bad = np.tile(np.eye(g.shape[1]), (len(g), 1, 1)), np.zeros(len(g), bool)
    with contextlib.suppress(np.linalg.LinAlgError):  # one that has none fails them all
        low = np.linalg.inv(np.linalg.cholesky(g))
        return low.transpose(0, 2, 1) @ low, bad
    for k in range(len(g)):
        try:
            low = np.linalg.inv(np.linalg.cholesky(g[k]))
            out[k] = low.T @ low
        except np.linalg.LinAlgError:
            bad[k] = True
    return out, bad


def _mle(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest eigenvector of inverse(|C|) o C; the status names the first step that fails."""
    g = np.abs(c)
    low_c, _, bad_c = _eigen(c, False)
    low_g, _, bad_g = _eigen(g.astype(complex), False)
    status = np.select([bad_c, low_c < EPS, bad_g, low_g < EPS], [-1, -2, -3, -4], 0)
    inverse, singular = _inverse(np.where((status == 0)[:, None, None], g, np.eye(g.shape[1])))
    status = np.where((status == 0) & singular, -5, status)
    value, v, bad = _eigen(inverse * c, False)
    return v, np.where(status != 0, status, np.where(bad, -6, np.where(value < EPS, -7, 0)))


def _robust(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MLE, and EVD where |C| is not positive definite or its eigenvector fails."""
    inverse, singular = _inverse(np.abs(c))
    _, v, bad = _eigen(inverse * c, False)
    other, status = _evd(c)
    use = singular | bad
    return np.where(use[:, None], other, v), np.where(use, status, 0)


def _iterate(c: np.ndarray, sweeps: int = 25, stop_deg: float = 0.0, clip: float = EPS) -> tuple[np.ndarray, np.ndarray]:
    """MLE refined one phase at a time until none moves more than stop_deg; |C| has its eigenvalues clipped first."""
    values, vectors = np.linalg.eigh(np.abs(c))
    g = np.einsum("pij,pj,pkj->pik", vectors, np.maximum(values, clip), vectors)
    weighted = np.linalg.inv(g) * c
    v, status = _evd(c)
    phi = np.angle(v)
    n = c.shape[1]
    for _ in range(sweeps):
        before = phi.copy()
        for i in range(n):
            others = weighted[:, i, :] * np.exp(1j * phi)
            others[:, i] = 0
            phi[:, i] = np.angle(-others.sum(axis=1))
        if np.abs(np.angle(np.exp(1j * (phi - before)))).max(initial=0) <= np.radians(stop_deg):
            break
    return np.exp(1j * phi), status


def temporal_coherence(c: np.ndarray, linked: np.ndarray, bw: int | None = None) -> np.ndarray:
    """|mean over i < j of exp j(angle C_ij - angle z_i + angle z_j)|; with bw only pairs up to bw apart."""
    n = c.shape[1]
    i, j = np.triu_indices(n, 1)
    if bw:
        near = j - i <= bw
        i, j = i[near], j[near]
    phi = np.angle(linked)
    return np.abs(np.exp(1j * (np.angle(c[:, i, j]) - phi[:, i] + phi[:, j])).mean(axis=1))


def link(c: np.ndarray, method: str = "MLE", bandwidth: int = -1, mini_stack_count: int = 1, **options) -> tuple[np.ndarray, np.ndarray]:
    """Unit phasors relative to band mini_stack_count - 1, which is exactly 1, and temporal coherence, or a status below 0."""
    n = c.shape[1]
    if method == "STBAS" and not 0 < bandwidth < n - 1:
        raise RasterError(101, "STBAS needs a bandwidth above 0 and below the number of bands less 1")
    v, status = {"EVD": _evd, "MLE": _mle, "phase_link": _robust, "iterative": lambda m: _iterate(m, **options), "STBAS": lambda m: _evd(_banded(m, bandwidth))}[method](c)
    phi = np.angle(v)
    z = np.exp(1j * (phi - phi[:, mini_stack_count - 1 : mini_stack_count]))
    z[:, mini_stack_count - 1] = 1
    good = status == 0
    return np.where(good[:, None], z, 0), np.where(good, temporal_coherence(c, z, bandwidth if method == "STBAS" else None), status)


def compressed(z: np.ndarray, linked: np.ndarray, mini_stack_count: int = 1) -> np.ndarray:
    """The mean of the real acquisitions, the linked phase taken off: sum over i >= k - 1 of z_i conj(linked_i) / (N - k + 1)."""
    k = mini_stack_count - 1
    return (z[:, k:] * linked[:, k:].conj()).sum(axis=1) / (z.shape[1] - k)


def phase_link(wide: DataFrame, masks: DataFrame, ny: int = 5, nx: int = 5, method: str = "MLE", bandwidth: int = -1, mini_stack_count: int = 1, min_neighbors: int | None = None, tile: int = 32, batch: int = 64, diagnostics: bool = False, **options) -> DataFrame:
    """y, x, tcorr, re, im (linked phasors by band), comp_re, comp_im (the compressed acquisition) for every pixel.

    wide: y, x, re, im; masks: y, x, mask of the same window. tcorr below 0 is the status of an estimator that failed.
    Pixels whose own bit is not set, or with less than min_neighbors (2, or 5 for phase_link), are 0 throughout.
    With diagnostics: y, x and the least and largest eigenvalue of C, |C| and inverse(|C|) o C, and how many reach 1e-6.
    """
    if method not in METHODS:
        raise RasterError(102, f"unknown method {method!r}")
    least = min_neighbors if min_neighbors is not None else 5 if method == "phase_link" else 2

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(pdf.re.to_numpy()) + 1j * np.stack(pdf.im.to_numpy())
        y, x = pdf.y.to_numpy(), pdf.x.to_numpy()
        grid, gy, gx = tile_grid(y, x, ny, nx)
        own = np.flatnonzero(pdf.own.to_numpy())
        masks_ = np.stack([np.asarray(m if m is not None else [0] * words, np.int64) for m in pdf["mask"].to_numpy()[own]]) if len(own) else np.zeros((0, words), np.int64)
        n = z.shape[1]
        linked, tcorr, comp = np.zeros((len(own), n), complex), np.zeros(len(own)), np.zeros(len(own), complex)
        stats = np.zeros((len(own), 9))
        for at in range(0, len(own), batch):
            part = slice(at, at + batch)
            rows, member = window_rows(grid, gy[own[part]], gx[own[part]], masks_[part], ny, nx)
            centre = member[:, member.shape[1] // 2]
            ok = np.flatnonzero(centre & (member.sum(axis=1) >= least))
            if not len(ok):
                continue
            c = coherence_matrices(z[rows[ok]], member[ok])
            if diagnostics:
                inverse, _ = _inverse(np.abs(c))
                for k, m in enumerate((c, np.abs(c), inverse * c)):
                    e = np.linalg.eigvalsh(m)
                    stats[at + ok, 3 * k : 3 * k + 3] = np.stack([e[:, 0], e[:, -1], (e >= EPS).sum(axis=1)], 1)
                continue
            a, t = link(c, method, bandwidth, mini_stack_count, **options)
            linked[at + ok], tcorr[at + ok] = a, t
            comp[at + ok] = compressed(z[own[part][ok]], a, mini_stack_count)
        keys = {"y": y[own], "x": x[own]}
        if diagnostics:
            return pd.DataFrame(keys | {name: stats[:, i] for i, name in enumerate(_STATS)})
        return pd.DataFrame(keys | {"tcorr": tcorr, "re": pd.Series(list(linked.real), dtype=object), "im": pd.Series(list(linked.imag), dtype=object), "comp_re": comp.real, "comp_im": comp.imag})

    words = -(-(2 * ny + 1) * (2 * nx + 1) // 32)
    rows = wide.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "re", "im").join(masks.select("y", "x", "mask"), ["y", "x"], "left")
    schema = "y int, x int, " + (", ".join(f"{s} double" for s in _STATS) if diagnostics else "tcorr double, re array<double>, im array<double>, comp_re double, comp_im double")
    return tiles(rows, max(tile, ny, nx), ny, nx).groupBy("ty", "tx").applyInPandas(kernel, schema)


_STATS = tuple(f"{m}_{s}" for m in ("c", "gamma", "product") for s in ("least", "most", "positive"))
