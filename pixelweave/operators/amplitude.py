"""Amplitude calibration, dispersion and selection of persistent scatterers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.complexcol import amplitude
from ..model import with_mask


def calibrate(long: DataFrame, mask: DataFrame | None = None, default: float = 1.0, apply_sqrt: bool = False) -> DataFrame:
    """band, amp_const, n, coverage: the mean amplitude of each band over valid pixels, and the share of them in percent,
    cut to two digits. A band without valid pixels has the default."""
    a = amplitude(F.col("re"), F.col("im"))
    amp = F.when((a != 0) & ~F.isnan(a) & (F.col("mask") > 0), F.sqrt(a) if apply_sqrt else a)
    sums = with_mask(long, mask).groupBy("band").agg(F.avg(amp).alias("m"), F.count(amp).alias("n"), F.count(F.lit(1)).alias("all"))
    return sums.select("band", F.coalesce("m", F.lit(default)).alias("amp_const"), "n", (F.floor(10000.0 * F.col("n") / F.col("all")) / 100.0).alias("coverage"))


def normalised(long: DataFrame, bands: DataFrame | None, reference: int = 0) -> DataFrame:
    """long with amp, divided by the band's constant over that of the reference band; constants that are missing or not
    above 0 count as 1. bands has one row per epoch and is broadcast."""
    amp = amplitude(F.col("re"), F.col("im"))
    if bands is None:
        return long.withColumn("amp", amp)
    const = F.when(F.col("amp_const") > 0, F.col("amp_const")).otherwise(1.0)
    ref = bands.where(F.col("band") == reference).select(const.alias("ref_const"))
    ratio = bands.select("band", const.alias("own")).crossJoin(F.broadcast(ref)).select("band", (F.col("own") / F.col("ref_const")).alias("alpha"))
    return long.join(F.broadcast(ratio), "band", "left").withColumn("amp", amp / F.coalesce("alpha", F.lit(1.0))).drop("alpha")


def dispersion(long: DataFrame, bands: DataFrame | None = None, reference: int = 0) -> DataFrame:
    """y, x, n, mean_amp, da over the bands whose amplitude is not 0: da = population deviation / mean.

    With one band or none: mean 0, da -1. A deviation that is 0 or NaN: da -1; a NaN amplitude makes the mean NaN.
    """
    v = F.when(F.col("amp") != 0, F.col("amp"))
    sums = normalised(long, bands, reference).groupBy("y", "x").agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.avg(v * v).alias("m2"))
    sigma = F.sqrt(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(0.0)))
    da = F.when((F.col("n") > 1) & ~F.isnan("m") & (sigma > 0), sigma / F.col("m")).otherwise(-1.0)
    return sums.select("y", "x", "n", F.when(F.col("n") > 1, F.col("m")).otherwise(0.0).alias("mean_amp"), da.alias("da"))


def persistent(da: Column, below: float = 0.4) -> Column:
    """Persistent scatterers: a dispersion below the threshold that is no failure sentinel."""
    return (da >= 0) & (da < below)


def all_valid(long: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """y, x, valid: mask is not 0 and no band is 0 or NaN."""
    a = amplitude(F.col("re"), F.col("im"))
    return with_mask(long, mask).groupBy("y", "x").agg(F.bool_and((a != 0) & ~F.isnan(a) & (F.col("mask") != 0)).alias("valid"))
