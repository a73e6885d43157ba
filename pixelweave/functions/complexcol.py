"""Complex numbers as pairs of columns; Spark has no complex type, so re/im stay together here."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

Complex = tuple[Column, Column]


def amplitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def phasor(phi: Column) -> Complex:
    return F.cos(phi), F.sin(phi)


def times(a: Complex, b: Complex) -> Complex:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def times_conj(a: Complex, b: Complex) -> Complex:
    """a times the conjugate of b: an interferogram."""
    return a[0] * b[0] + a[1] * b[1], a[1] * b[0] - a[0] * b[1]


def wrap(phi: Column) -> Column:
    """To [-pi, pi], halves to even."""
    return phi - 2 * pi * F.rint(phi / (2 * pi))


def valid(re: Column, im: Column) -> Column:
    """Neither zero nor NaN."""
    return ~((re == 0) & (im == 0)) & ~F.isnan(re) & ~F.isnan(im)


def displacement(phi: Column, wavelength: float = 0.05546576) -> Column:
    """Radians of two-way phase to metres."""
    return phi * (wavelength / (4 * pi))
