"""The adaptive spectral filter of interferograms, by tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The smoothing window of the spectrum, symmetric about its middle.
SMOOTH = (0.04393693, 0.24935221, 0.70664828, 1.0, 0.70664828, 0.24935221, 0.04393693)


def low_pass(n: int, period: float) -> np.ndarray:
    """A Butterworth response of order 5 in both directions, at periods (in pixels) above `period`; 0 for none."""
    if period <= 0:
        return np.zeros((n, n))
    h = 1 / (1 + np.power(np.fft.fftfreq(n) * period, 10))
    return np.outer(h, h)


def smoothed(amplitude: np.ndarray) -> np.ndarray:
    """The amplitude spectrum, centred, convolved with the window in both directions."""
    kernel = np.array(SMOOTH)
    centred = np.fft.fftshift(amplitude)
    for axis in (0, 1):
        centred = np.apply_along_axis(lambda v: np.convolve(v, kernel, mode="same"), axis, centred)
    return np.fft.ifftshift(centred)


def filter_chip(chip: np.ndarray, alpha: float = 0.2, beta: float = 0.5, period: float = 30.0, npad: int = 8) -> np.ndarray:
    """One chip: its spectrum times beta max((S / median S)^alpha - 1, 0) plus the low pass, S being smoothed. 0 stays 0."""
    n = chip.shape[0] + npad
    padded = np.zeros((n, n), complex)
    padded[: chip.shape[0], : chip.shape[1]] = chip
    if not padded.any():
        return chip * 0
    spectrum = np.fft.fft2(padded)
    gain = np.zeros((n, n))
    if beta > 0:
        s = smoothed(np.abs(spectrum))
        median = np.median(s)
        gain = beta * np.maximum(np.power(s / median if median != 0 else s, alpha) - 1, 0)
    return np.fft.ifft2(spectrum * (gain + low_pass(n, period)))[: chip.shape[0], : chip.shape[1]]


def adaptive_filter(pixels: DataFrame, nwin: int = 24, npad: int = 8, alpha: float = 0.2, beta: float = 0.5, period: float = 30.0) -> DataFrame:
    """y, x, re, im filtered in chips of nwin pixels; missing pixels count as 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chip = np.zeros((nwin, nwin), complex)
        i, j = pdf.y.to_numpy() % nwin, pdf.x.to_numpy() % nwin
        chip[i, j] = np.nan_to_num(pdf.re.to_numpy()) + 1j * np.nan_to_num(pdf.im.to_numpy())
        out = filter_chip(chip, alpha, beta, period, npad)[i, j]
        return pd.DataFrame({"y": pdf.y, "x": pdf.x, "re": out.real, "im": out.imag})

    keyed = pixels.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "re", "im")
    return keyed.groupBy(F.floor(F.col("y") / nwin), F.floor(F.col("x") / nwin)).applyInPandas(run, "y int, x int, re double, im double")
