"""The sequential estimator: phase linking of mini stacks with the compressed acquisitions of earlier ones, and their datum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.complexcol import times
from ..plans.checkpoints import checkpoint
from .phaselink import phase_link


def assign_mini_stacks(bands: DataFrame, size: int) -> DataFrame:
    """bands (band from 0, date) with ministack (from 0) and its label, the first and last date."""
    groups = bands.withColumn("ministack", F.floor(F.col("band") / size).cast("int"))
    ends = groups.groupBy("ministack").agg(F.concat_ws("_", F.date_format(F.min("date"), "yyyyMMdd"), F.date_format(F.max("date"), "yyyyMMdd")).alias("label"))
    return groups.join(F.broadcast(ends), "ministack")


def mini_stack(wide: DataFrame, earlier: DataFrame | None, start: int, stop: int) -> DataFrame:
    """Bands start..stop-1 behind the compressed acquisitions (y, x, cre, cim: arrays) of earlier mini stacks."""
    part = lambda c: F.slice(c, start + 1, stop - start)
    if earlier is None:
        return wide.select("y", "x", part("re").alias("re"), part("im").alias("im"))
    return wide.join(earlier, ["y", "x"]).select("y", "x", F.concat("cre", part("re")).alias("re"), F.concat("cim", part("im")).alias("im"))


def sequential(wide: DataFrame, masks: DataFrame, n_bands: int, size: int = 10, ny: int = 9, nx: int = 29, method: str = "MLE", **options) -> tuple[DataFrame, DataFrame]:
    """Links mini stacks of `size` bands; the last one may be shorter.

    First: y, x, ministack, tcorr, re, im, the linked phasors of a mini stack's own bands. Second: y, x, tcorr, re, im,
    the datum, one phasor per mini stack. Each step is checkpointed, so plans stay short and a lost executor costs one.
    Only compressed acquisitions of earlier mini stacks are used, in order.
    """
    earlier, out = None, None
    for k, start in enumerate(range(0, n_bands, size)):
        stop = min(start + size, n_bands)
        stack = mini_stack(wide, earlier, start, stop)
        linked = checkpoint(phase_link(stack, masks, ny, nx, method, mini_stack_count=k + 1, **options))
        own = linked.select("y", "x", F.lit(k).alias("ministack"), "tcorr", F.slice("re", k + 1, stop - start).alias("re"), F.slice("im", k + 1, stop - start).alias("im"))
        out = own if out is None else out.unionByName(own)
        comp = linked.select("y", "x", F.array("comp_re").alias("cre"), F.array("comp_im").alias("cim"))
        if earlier is not None:
            comp = earlier.join(comp.withColumnsRenamed({"cre": "nre", "cim": "nim"}), ["y", "x"]).select("y", "x", F.concat("cre", "nre").alias("cre"), F.concat("cim", "nim").alias("cim"))
        earlier = checkpoint(comp)
    datum = phase_link(earlier.select("y", "x", F.col("cre").alias("re"), F.col("cim").alias("im")), masks, ny, nx, method, mini_stack_count=1, **options)
    return out, datum.select("y", "x", "tcorr", "re", "im")


def sequential_overlap(wide: DataFrame, masks: DataFrame, n_bands: int, size: int = 10, ny: int = 9, nx: int = 29, method: str = "MLE", **options) -> DataFrame:
    """y, x, tcorr (of the last mini stack), re, im of all bands: mini stacks share one band with the one before and are
    chained at it, without compressed acquisitions."""
    out = checkpoint(phase_link(mini_stack(wide, None, 0, min(size, n_bands)), masks, ny, nx, method, **options).select("y", "x", "tcorr", "re", "im"))
    for start in range(size, n_bands, size):
        stop = min(start + size, n_bands)
        part = phase_link(mini_stack(wide, None, start - 1, stop), masks, ny, nx, method, **options).select("y", "x", F.col("tcorr").alias("t"), F.slice("re", 2, stop - start).alias("r"), F.slice("im", 2, stop - start).alias("i"))
        last = F.struct(F.element_at("re", -1).alias("re"), F.element_at("im", -1).alias("im"))
        both = out.join(part, ["y", "x"]).withColumn("last", last)
        re = F.zip_with("r", "i", lambda a, b: a * F.col("last.re") - b * F.col("last.im"))
        im = F.zip_with("r", "i", lambda a, b: a * F.col("last.im") + b * F.col("last.re"))
        out = checkpoint(both.select("y", "x", F.col("t").alias("tcorr"), F.concat("re", re).alias("re"), F.concat("im", im).alias("im")))
    return out


def adjust_wrapped(linked: DataFrame, datum: DataFrame) -> DataFrame:
    """Each mini stack's phasors (y, x, ministack, re, im) times the datum of the mini stack: y, x, ministack, k, re, im."""
    d = datum.select("y", "x", F.posexplode(F.arrays_zip("re", "im")).alias("ministack", "d"))
    one = linked.select("y", "x", "ministack", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    re, im = times((F.col("z.re"), F.col("z.im")), (F.col("d.re"), F.col("d.im")))
    return one.join(d, ["y", "x", "ministack"]).select("y", "x", "ministack", "k", re.alias("re"), im.alias("im"))


def relative_to(values: DataFrame, value: str, y: int, x: int, by: list[str]) -> DataFrame:
    """Values less the one at the reference pixel, for each band or group in `by`; the reference rows are one per group."""
    ref = values.where((F.col("y") == y) & (F.col("x") == x)).select(*by, F.col(value).alias("ref_value"))
    return values.join(F.broadcast(ref), by).withColumn(value, F.col(value) - F.col("ref_value")).drop("ref_value")


def adjust_unwrapped(phases: DataFrame, datum: DataFrame, y: int, x: int) -> DataFrame:
    """Unwrapped phases (y, x, ministack, band, phase) plus the datum's (y, x, ministack, phase), relative to a pixel."""
    both = phases.join(datum.withColumnRenamed("phase", "datum_phase"), ["y", "x", "ministack"])
    total = both.select("y", "x", "ministack", "band", (F.col("phase") + F.col("datum_phase")).alias("phase"))
    return relative_to(total, "phase", y, x, ["ministack", "band"])


def datum_difference(mini: tuple[Column, Column], datum: tuple[Column, Column]) -> Column:
    """The angle of a mini stack's value times the conjugate of the datum."""
    return F.atan2(mini[1] * datum[0] - mini[0] * datum[1], mini[0] * datum[0] + mini[1] * datum[1])
