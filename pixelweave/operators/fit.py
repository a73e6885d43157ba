"""Regression of time series on time functions, with pixel-wise results as array arithmetic."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import Collection
from ..plans.linalg import apply_matrix

MODELS = ("linear", "linear_seasonal", "linear_coseismic", "linear_coseismic_postseismic")


def heaviside(t: np.ndarray, event: float) -> np.ndarray:
    """Strictly after the event."""
    return (t > event).astype(float)


def post_seismic(t: np.ndarray, event: float, tau: float) -> np.ndarray:
    with np.errstate(all="ignore"):
        x = np.log10(1 + (t - event) / tau)
    return np.where(np.isfinite(x), x, 1e-6) * heaviside(t, event)


def model_matrix(model: str, t: np.ndarray, event: float | None = None, tau: float | None = None) -> np.ndarray:
    """The design matrix of a named model; t in years."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    cols = [np.ones_like(t), t]
    if model == "linear_seasonal":
        cols += [f(2 * pi * k * t) for k in (1, 2) for f in (np.sin, np.cos)]
    if model.startswith("linear_coseismic"):
        if event is None:
            raise ValueError(f"{model} needs the time of the event")
        cols.append(heaviside(t, event))
    if model == "linear_coseismic_postseismic":
        if tau is None:
            raise ValueError(f"{model} needs tau")
        cols.append(post_seismic(t, event, tau))
    return np.stack(cols, axis=1)


def fit(series: DataFrame, g: np.ndarray | Collection, times: list | None = None, values: str = "ts") -> DataFrame:
    """series with model (an array of parameters) and rmse: least squares of an array column on G, a matrix or functions."""
    g = g.matrix(times) if isinstance(g, Collection) else np.asarray(g, float)
    out = series.withColumn("model", apply_matrix(np.linalg.pinv(g), F.col(values)))
    return out.withColumn("rmse", rmse(F.col(values), apply_matrix(g, F.col("model"))))


def rmse(values: Column, predicted: Column) -> Column:
    n = F.size(values)
    return F.sqrt(F.aggregate(F.zip_with(values, predicted, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v) / n)


def mean_rmse(fitted: DataFrame, threshold: float) -> DataFrame:
    """One row: the mean rmse of pixels whose tcorr is above the threshold; 1e6 if there is none."""
    return fitted.agg(F.coalesce(F.avg(F.when(F.col("tcorr") > threshold, F.col("rmse"))), F.lit(1e6)).alias("mean_rmse"))


TAUS = tuple(0.03 + 0.05 * i for i in range(5))


def search_tau(series: DataFrame, t: np.ndarray, event: float, threshold: float, taus: tuple = TAUS, values: str = "ts") -> DataFrame:
    """tau, mean_rmse of each candidate, best first (ties to the smaller): all candidates in one pass over the series."""
    each = []
    for tau in taus:
        g = model_matrix("linear_coseismic_postseismic", t, event, tau)
        predicted = apply_matrix(g, apply_matrix(np.linalg.pinv(g), F.col(values)))
        each.append(F.struct(F.lit(tau).alias("tau"), rmse(F.col(values), predicted).alias("rmse")))
    rows = series.select("tcorr", F.explode(F.array(*each)).alias("c")).groupBy("c.tau").agg(F.coalesce(F.avg(F.when(F.col("tcorr") > threshold, F.col("c.rmse"))), F.lit(1e6)).alias("mean_rmse"))
    return rows.orderBy("mean_rmse", "tau")


LOG_TAU = (-10.0, 1.0)


def fit_nonlinear(series: DataFrame, t: np.ndarray, event: float, values: str = "ts", keys: tuple = ("y", "x"), steps: int = 45, zooms: int = 6) -> DataFrame:
    """Keys with offset, rate, step, decay, log_tau and rmse of offset + rate t + H(t - event)(step + decay log10(1 + (t - event) / tau)).

    Variable projection: for each ln tau in [-10, 1] the rest is linear; a grid that zooms in finds the best one. What is
    no finite number is 0.
    """
    after = t > event

    def solve(d: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals (pixels x grid) with ln tau from each pixel's own grid."""
        res, par = np.empty(grid.shape), np.empty((*grid.shape, 4))
        for i in range(grid.shape[1]):
            decay = np.log10(1 + np.where(after, t - event, 0)[None, :] / np.exp(grid[:, i])[:, None]) * after
            g = np.stack([np.broadcast_to(c, decay.shape) for c in (np.ones_like(t), t, after.astype(float))] + [decay], axis=2)
            m = np.einsum("pkn,pn->pk", np.linalg.pinv(g), d)
            par[:, i] = m
            res[:, i] = ((d - np.einsum("pnk,pk->pn", g, m)) ** 2).mean(axis=1)
        return res, par

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            d = np.nan_to_num(np.stack(pdf[values].to_numpy()).astype(float), nan=0.0, posinf=0.0, neginf=0.0)
            grid = np.broadcast_to(np.linspace(*LOG_TAU, steps), (len(d), steps)).copy()
            for z in range(zooms):
                res, par = solve(d, grid)
                k, rows = res.argmin(axis=1), np.arange(len(d))
                best, m, err = grid[rows, k], par[rows, k], res[rows, k]
                half = (grid[:, 1] - grid[:, 0]) * 1.5
                grid = np.clip(np.linspace(best - half, best + half, 9, axis=1), *LOG_TAU)
            out = {c: pdf[c] for c in keys} | dict(zip(("offset", "rate", "step", "decay"), m.T)) | {"log_tau": best, "rmse": np.sqrt(err)}
            yield pd.DataFrame(out)

    kinds = ", ".join(f"{c} {series.schema[c].dataType.simpleString()}" for c in keys)
    return series.select(*keys, values).mapInPandas(run, f"{kinds}, offset double, rate double, step double, decay double, log_tau double, rmse double")


