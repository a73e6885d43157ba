"""Small dense matrices of the driver as weight tables, so that applying them is an array expression or a join and a sum."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row_literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(weights, values: Column) -> Column:
    """A row of weights times an array column, summed from left to right."""
    return _dot(row_literal(weights), values)


def _dot(weights: Column, values: Column) -> Column:
    return F.aggregate(F.zip_with(weights, values, lambda w, v: w * v), F.lit(0.0), lambda acc, v: acc + v)


def apply_matrix(m: np.ndarray, values: Column) -> Column:
    """A matrix times an array column: an array with one entry per row of the matrix. The matrix is one literal and the
    column is bound once, so that products of products evaluate the inner one once a row."""
    times = lambda v: F.transform(F.lit(np.asarray(m, float).tolist()), lambda row: _dot(row, v))
    return F.transform(F.array(values), times)[0]


def weight_table(spark: SparkSession, m: np.ndarray, row: str, col: str) -> DataFrame:
    """The entries of a matrix that are not zero: (row, col, w). Its size is that of the model, not of the data."""
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j)], f"{row} int, {col} int, w double")


def weighted_sums(long: DataFrame, weights: DataFrame, row: str, col: str, keys: list[str], value: str, out: str) -> DataFrame:
    """Sums of w * value by keys and row, from a long table: the matrix product without gathering a pixel's values."""
    return long.join(F.broadcast(weights), col).groupBy(*keys, row).agg(F.sum(F.col("w") * F.col(value)).alias(out))


def rank(m: np.ndarray) -> int:
    return int(np.linalg.matrix_rank(m)) if m.size else 0
