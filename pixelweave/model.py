"""The data model: pixels (y, x) by epochs (band), long or wide, with small dimension tables.

long   y int, x int, band int, re double, im double
wide   y int, x int, re array<double>, im array<double>, ordered by band
bands  band int, date date, decimal_year double, wavelength double, amp_const double
mask   y int, x int, mask int; pixels that it lacks count as 1
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = "y int, x int, band int, re double, im double"


class RasterError(ValueError):
    """An input that an operator can't work on; the codes name what is wrong."""

    def __init__(self, code: int, what: str):
        super().__init__(f"{code}: {what}")
        self.code = code


def to_wide(long: DataFrame) -> DataFrame:
    """One row per pixel; values in the order of their bands."""
    rows = long.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("band", "re", "im"))).alias("v"))
    return rows.select("y", "x", F.transform("v", lambda v: v["re"]).alias("re"), F.transform("v", lambda v: v["im"]).alias("im"))


def to_long(wide: DataFrame) -> DataFrame:
    rest = [c for c in wide.columns if c not in ("re", "im")]
    return wide.select(*rest, F.posexplode(F.arrays_zip("re", "im")).alias("band", "z")).select(*rest, "band", "z.re", "z.im")


def with_mask(pixels: DataFrame, mask: DataFrame | None) -> DataFrame:
    """Pixels with `mask`, 1 where there is none."""
    if mask is None:
        return pixels.withColumn("mask", F.lit(1))
    return pixels.join(mask.select("y", "x", "mask"), ["y", "x"], "left").fillna(1, ["mask"])


def require_equal_extent(a: DataFrame, b: DataFrame, what: str) -> None:
    """Rasters that are combined by position must cover the same pixels."""
    missing = a.select("y", "x").join(b.select("y", "x"), ["y", "x"], "left_anti")
    if not missing.isEmpty():
        raise RasterError(105, f"{what} has not all pixels of the stack")
