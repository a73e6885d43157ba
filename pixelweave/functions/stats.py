"""Two-sample tests: statistics in numpy over batches of pairs, p-values as columns or in numpy."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the Kolmogorov distribution's series.
W = 2.50662827
C = (-1.2337005501361697, -11.103304951225528, -30.842513753404244)
FJ = (-2.0, -8.0, -18.0, -32.0)

# P-value bins of the two-sample Anderson-Darling test and the statistics at them.
AD_PROB = (
    0.00001, 0.00005, 0.0001, 0.0005, 0.001, 0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9,
    0.925, 0.95, 0.975, 0.99, 0.9925, 0.995, 0.9975, 0.999, 0.99925, 0.9995, 0.99975, 0.9999, 0.999925, 0.99995, 0.999975, 0.99999,
)
AD_STAT = (
    -1.1954, -1.1786, -1.166, -1.1407, -1.1253, -1.0777, -1.0489, -0.9978, -0.9417, -0.8981, -0.8598, -0.7258, -0.5966, -0.4572, -0.2966,
    -0.1009, 0.1571, 0.5357, 1.2255, 1.5262, 1.9633, 2.7314, 3.7825, 4.1241, 4.6044, 5.409, 6.4954, 6.8279, 7.2755, 8.1885, 9.3061, 9.6132,
    10.0989, 10.8825, 11.8537,
)


def kolmogorov_column(u: Column) -> Column:
    """The probability that a Kolmogorov variable exceeds u."""
    small = 1 - W * (F.exp(C[0] / (u * u)) + F.exp(C[1] / (u * u)) + F.exp(C[2] / (u * u))) / u
    terms = F.round(3.0 / u)  # halves away from zero
    term = lambda j: F.when(terms > j, F.exp(FJ[j] * u * u)).otherwise(0.0) if j else F.exp(FJ[0] * u * u)
    large = 2 * (term(0) - term(1) + term(2) - term(3))
    return F.when(u < 0.2, 1.0).when(u < 0.755, small).when(u < 6.8116, large).otherwise(0.0)


def kolmogorov(u: np.ndarray) -> np.ndarray:
    u = np.asarray(u, float)
    with np.errstate(all="ignore"):
        small = 1 - W * sum(np.exp(c / (u * u)) for c in C) / u
        terms = np.maximum(1, np.floor(3 / u + 0.5))
        large = 2 * sum((-1) ** j * np.where(terms > j, np.exp(f * u * u), 0) for j, f in enumerate(FJ))
    return np.where(u < 0.2, 1.0, np.where(u < 0.755, small, np.where(u < 6.8116, large, 0.0)))


def ks_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest distance between the two empirical distributions of each row pair; equal values are taken together."""
    n = a.shape[1]
    both = np.concatenate([a, b], axis=1)
    order = np.argsort(both, axis=1, kind="stable")
    value = np.take_along_axis(both, order, axis=1)
    step = np.where(order < n, 1, -1).cumsum(axis=1)
    last = np.concatenate([value[:, 1:] != value[:, :-1], np.ones((len(a), 1), bool)], axis=1)
    return np.where(last, np.abs(step), 0).max(axis=1) / n


def ks_probability(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a.shape[1]
    return kolmogorov(ks_distance(a, b) * math.sqrt(n * n / (2 * n)))


def ks_asymptotic(a: np.ndarray, b: np.ndarray, tails: int = 2) -> np.ndarray:
    """The other p-value: an effective-size correction and a long series; with one tail, exp(-2 lambda^2)."""
    n = a.shape[1] / 2
    lam = np.maximum((math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * ks_distance(a, b), 0)
    if tails == 1:
        return np.exp(-2 * lam * lam)
    j = np.arange(1, 102)
    return np.clip(2 * ((-1.0) ** (j - 1) * np.exp(-2 * lam[:, None] ** 2 * j * j)).sum(axis=1), 0, 1)


@lru_cache(maxsize=64)
def ad_sigma(n: int) -> float:
    """The standard deviation of the two-sample statistic with n values in each."""
    total, share = 2 * n, 2.0 / n
    if total < 2000:
        inv = 1.0 / np.arange(1, total)
        h = inv.sum()
        # pairs i < j of 1 / ((total - i) j)
        after = np.concatenate([np.cumsum(inv[::-1])[::-1][1:], [0.0]])
        g = float(sum(inv[total - i - 1] * after[i - 1] for i in range(1, total - 1)))
    else:
        h, g = math.log(total - 1) + 0.5772156649015329, math.pi**2 / 6
    a = (4 * g - 6) + (10 - 6 * g) * share
    b = (2 * g - 4) * 4 + 16 * h + (2 * g - 14 * h - 4) * share - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * 4 + (4 * h - 4 * g + 6) * 2 + (2 * h - 6) * share + 4 * h
    d = (2 * h + 6) * 4 - 8 * h
    return math.sqrt((a * total**3 + b * total**2 + c * total + d) / ((total - 1.0) * (total - 2) * (total - 3)))


def ad_statistic(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The standardised Anderson-Darling statistic of each row pair; of equal values that of b comes first."""
    n = a.shape[1]
    total = 2 * n
    order = np.argsort(np.concatenate([b, a], axis=1), axis=1, kind="stable")
    from_a = (order >= n).cumsum(axis=1)[:, :-1]
    j = np.arange(1, total)
    weight = 1.0 / (j * (total - j))
    inner = (((total * from_a - n * j) ** 2) * weight).sum(axis=1) + (((total * (j - from_a) - n * j) ** 2) * weight).sum(axis=1)
    return (inner / n / total - 1) / ad_sigma(n)


def ad_probability(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By log odds between the tabulated statistics, and straight on beyond them."""
    x, stat = ad_statistic(a, b), np.array(AD_STAT)
    odds = np.log((1 - np.array(AD_PROB)) / np.array(AD_PROB))
    i = np.clip(np.searchsorted(stat, x, side="left") - 1, 0, len(stat) - 2)
    lp = (odds[i] - odds[i + 1]) * (x - stat[i + 1]) / (stat[i] - stat[i + 1]) + odds[i + 1]
    return 1 / (1 + np.exp(-lp))


TESTS = {"KS2": ks_probability, "AD2": ad_probability, "asymptotic": ks_asymptotic}
