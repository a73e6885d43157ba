"""Small-baseline network inversion: epochs from pairs, velocity and height error."""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import YEAR_DAYS
from ..model import RasterError
from ..plans.linalg import apply_matrix, dot, rank


def epochs(pairs: list[tuple]) -> list:
    """The dates of pairs (master, slave) in order."""
    return sorted({d for p in pairs for d in p})


def incidence(pairs: list[tuple], reference, sign: int = 1) -> tuple[np.ndarray, list]:
    """J (pairs x other epochs): sign at the master, -sign at the slave, the reference epoch's column dropped.

    Design matrices of time series have the opposite sign: pass -1 and (reference, follower) pairs.
    """
    dates = epochs(pairs)
    if reference not in dates:
        raise RasterError(110, f"the reference date {reference} is in no pair")
    at = {d: i for i, d in enumerate(dates)}
    j = np.zeros((len(pairs), len(dates)))
    for k, (master, slave) in enumerate(pairs):
        j[k, at[master]], j[k, at[slave]] = sign, -sign
    keep = [i for i, d in enumerate(dates) if d != reference]
    return j[:, keep], [dates[i] for i in keep]


def require_scenes(pairs: list[tuple], scenes: list) -> None:
    """Every date of a pair must be a scene."""
    if missing := sorted(set(epochs(pairs)) - set(scenes)):
        raise RasterError(111, f"no baseline for {missing}")


def reference_offsets(obs: DataFrame, box: tuple[int, int, int, int] | None, threshold: float = 0.2) -> DataFrame:
    """pair, offset: the mean phase over coherent pixels (coh > threshold) of a box (y0, x0, rows, columns); it may touch
    the grid's edges. Without a box, or one without pixels by its size, phases are referenced already: 0."""
    if box is None or box[2] <= 0 or box[3] <= 0:
        return obs.select("pair").distinct().withColumn("offset", F.lit(0.0))
    y0, x0, ny, nx = box
    inside = F.col("y").between(y0, y0 + ny - 1) & F.col("x").between(x0, x0 + nx - 1) & (F.col("coh") > threshold)
    return obs.groupBy("pair").agg(F.avg(F.when(inside, F.col("phase"))).alias("offset"))


def referenced(obs: DataFrame, offsets: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """obs with phases less their pair's offset, then times its scale (1 where there is none)."""
    if not offsets.where(F.col("offset").isNull()).isEmpty():
        raise RasterError(112, "a pair has no coherent pixel in the reference box")
    out = obs.join(F.broadcast(offsets), "pair")
    if scales is not None:
        out = out.join(F.broadcast(scales.select("pair", "scale")), "pair", "left")
    scale = F.coalesce(F.col("scale"), F.lit(1.0)) if scales is not None else F.lit(1.0)
    return out.withColumn("phase", (F.col("phase") - F.col("offset")) * scale).drop("offset", "scale")


def pair_arrays(obs: DataFrame, n_pairs: int) -> DataFrame:
    """y, x, phi: phases ordered by pair, of the pixels that have all pairs."""
    rows = obs.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("pair", "phase"))).alias("v"))
    return rows.where(F.size("v") == n_pairs).select("y", "x", F.transform("v", lambda v: v["phase"]).alias("phi"))


def network_coherence(phi: Column, ts: Column, j: np.ndarray) -> Column:
    """|mean over pairs of exp j(phi - J ts)|."""
    rest = F.zip_with(phi, apply_matrix(j, ts), lambda a, b: a - b)
    total = lambda f: F.aggregate(rest, F.lit(0.0), lambda acc, r: acc + f(r))
    return F.sqrt(F.pow(total(F.cos), 2) + F.pow(total(F.sin), 2)) / float(len(j))


def years(dates: list, reference) -> np.ndarray:
    return np.array([(d - reference).days / YEAR_DAYS for d in dates])


def trend_matrix(dates: list, reference) -> np.ndarray:
    """Columns 1, t, t^2 in years, a row per epoch other than the reference."""
    t = years(dates, reference)
    return np.stack([np.ones_like(t), t, t * t], axis=1)


def invert(arrays: DataFrame, pairs: list[tuple], reference, dates_at: list | None = None) -> DataFrame:
    """y, x, ts, tcorr, velocity: the least-squares epochs of each pixel's pairs, without the reference epoch, which is 0.

    The pseudo-inverses are the driver's; a pixel's part is array arithmetic in the JVM, without a shuffle.
    """
    j, dates = incidence(pairs, reference)
    if rank(j) != len(dates):
        raise RasterError(113, "the network of pairs is not connected")
    out = arrays.withColumn("ts", apply_matrix(np.linalg.pinv(j), F.col("phi")))
    out = out.withColumn("tcorr", network_coherence(F.col("phi"), F.col("ts"), j))
    g = np.linalg.pinv(trend_matrix(dates, reference))
    return out.withColumn("velocity", dot(g[1], F.col("ts"))).drop("phi")


def with_reference_epoch(inverted: DataFrame, pairs: list[tuple], reference) -> DataFrame:
    """y, x, date, value in long form, the reference epoch among them as 0."""
    dates = epochs(pairs)
    at = dates.index(reference)
    full = F.concat(F.slice("ts", 1, at), F.array(F.lit(0.0)), F.slice("ts", at + 1, len(dates)))
    rows = inverted.select("y", "x", F.posexplode(full).alias("k", "value"))
    return rows.select("y", "x", F.array(*[F.lit(d) for d in dates])[F.col("k")].alias("date"), "value")


def height_error(inverted: DataFrame, baselines: list[float], dates: list, reference, wavelength: float, slant: Column, incidence_deg: Column, compat: bool = False) -> DataFrame:
    """inverted with zerr, and ts and velocity corrected for it.

    baselines: those of `dates` relative to the reference scene. b = B 4 pi / (wavelength slant sin(incidence)). The height
    is the weight of what b has outside the trend; compat projects on the trend instead, which biases it.
    """
    g = trend_matrix(dates, reference)
    inv = np.linalg.pinv(g)
    p = g @ inv if compat else np.eye(len(g)) - g @ inv
    unit = np.array(baselines, float)
    c = p @ unit  # b is unit times a pixel's factor, so the projection is the driver's
    factor = 4 * pi / (wavelength * slant * F.sin(F.radians(incidence_deg)))
    size = float(c @ unit)
    z = (dot(c, F.col("ts")) / size / factor) if abs(size) > 1e-12 else F.lit(0.0)
    out = inverted.withColumn("zerr", z).withColumn("factor", factor)
    b = F.array(*[F.lit(float(u)) for u in unit])
    out = out.withColumn("ts", F.zip_with("ts", b, lambda t, u: t - u * F.col("factor") * F.col("zerr")))
    return out.withColumn("velocity", dot(inv[1], F.col("ts"))).drop("factor")
