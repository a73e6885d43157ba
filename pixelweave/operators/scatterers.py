"""Combination of persistent and distributed scatterers, and commands for external unwrapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.complexcol import phase, phasor, times_conj, wrap


def interferograms(stack: DataFrame, reference: int = 0, unit: bool = False) -> DataFrame:
    """y, x, band, re, im: each band times the conjugate of the reference band; unit drops the amplitudes."""
    ref = stack.where(F.col("band") == reference).select("y", "x", F.col("re").alias("rre"), F.col("im").alias("rim"))
    re, im = times_conj((F.col("re"), F.col("im")), (F.col("rre"), F.col("rim")))
    out = stack.where(F.col("band") != reference).join(ref, ["y", "x"]).select("y", "x", "band", re.alias("re"), im.alias("im"))
    if unit:
        a, b = phasor(phase(F.col("re"), F.col("im")))
        out = out.select("y", "x", "band", a.alias("re"), b.alias("im"))
    return out


def integrate(ds: DataFrame, ps: DataFrame, is_ps: DataFrame) -> DataFrame:
    """Distributed scatterers' interferograms, and those of full resolution where a pixel is a persistent scatterer."""
    own = is_ps.where("is_ps").select("y", "x")
    full = ps.join(own, ["y", "x"], "left_semi").select("y", "x", "band", F.col("re").alias("pre"), F.col("im").alias("pim"))
    both = ds.join(full, ["y", "x", "band"], "left")
    return both.select("y", "x", "band", F.coalesce("pre", "re").alias("re"), F.coalesce("pim", "im").alias("im"))


def override_coherence(tcorr: DataFrame, is_ps: DataFrame, value: float = 0.95) -> DataFrame:
    """tcorr, with the value at persistent scatterers."""
    own = is_ps.where("is_ps").select("y", "x", F.lit(True).alias("ps"))
    return tcorr.join(own, ["y", "x"], "left").withColumn("tcorr", F.when(F.col("ps"), value).otherwise(F.col("tcorr"))).drop("ps")


def unwrap_commands(epochs: DataFrame, program: str = "unwrap", method: str = "snaphu") -> DataFrame:
    """date, command: one command of an external unwrapping program for each epoch."""
    d = F.date_format("date", "yyyyMMdd")
    return epochs.select("date", F.format_string(f"{program} -m {method} -i %s.int -c tcorr.bin -o %s.unw", d, d).alias("command"))


def unwrap_in_time(phases: DataFrame) -> DataFrame:
    """Phases (y, x, band, phase) unwrapped along time, steps wrapped to half a cycle. No stand-in for 2-D unwrapping."""
    w = Window.partitionBy("y", "x").orderBy("band")
    step = phases.withColumn("step", wrap(F.col("phase") - F.lag("phase").over(w)))
    return step.withColumn("phase", F.first("phase").over(w) + F.sum(F.coalesce("step", F.lit(0.0))).over(w)).drop("step")
