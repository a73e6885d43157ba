"""Statistically self-similar neighbourhoods: pairwise tests in a moving window, bit masks and counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..plans.stencil import offsets, tile_grid, tiles

WORD_BITS = 32


def sorted_amplitudes(long_amp: DataFrame) -> DataFrame:
    """y, x, amps: the sorted amplitudes of valid pixels, those without a band that is 0 or NaN."""
    rows = long_amp.groupBy("y", "x").agg(F.array_sort(F.collect_list("amp")).alias("amps"), F.bool_and((F.col("amp") != 0) & ~F.isnan("amp")).alias("ok"))
    return rows.where("ok").select("y", "x", "amps")


def probabilities(pairs: DataFrame, method: str = "KS2") -> DataFrame:
    """pairs (y, x, dy, dx, a.amps, b.amps) as y, x, dy, dx, p, by an Arrow kernel over batches of pairs."""
    test = stats.TESTS[method]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.asarray(batch.column(i).flatten()).reshape(batch.num_rows, -1) for i in (4, 5))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(test(a, b))], ["y", "x", "dy", "dx", "p"])

    rows = pairs.select(*[F.col(c).cast("int").alias(c) for c in ("y", "x", "dy", "dx")], F.col("a.amps").alias("a"), F.col("b.amps").alias("b"))
    return rows.mapInArrow(run, "y int, x int, dy int, dx int, p double")


def neighbours(amps: DataFrame, ny: int = 5, nx: int = 5, prob: float = 0.05, method: str = "KS2", tile: int = 32) -> DataFrame:
    """Edges y, x, dy, dx, p of pixels whose samples pass the test, both ways and with each pixel's own (0, 0).

    Pixels are dealt into tiles with a halo, so that samples are copied only into the tiles that their window reaches.
    Each pair is tested once, in the tile that owns its first pixel, which emits both of its edges. Masked pixels are not
    among amps, so have no edges.
    """
    test = stats.TESTS[method]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x, samples = pdf.y.to_numpy(), pdf.x.to_numpy(), np.stack(pdf.amps.to_numpy()).astype(float)
        grid, gy, gx = tile_grid(y, x, ny, nx)
        own = np.flatnonzero(pdf.own.to_numpy())
        zero = np.zeros(len(own), int)
        out = [(y[own], x[own], zero, zero, zero + 1.0)]
        for dy, dx in offsets(ny, nx):
            other = grid[gy[own] + dy, gx[own] + dx]
            a, b = own[other >= 0], other[other >= 0]
            if len(a):
                p = test(samples[a], samples[b])
                a, b, p = a[p >= prob], b[p >= prob], p[p >= prob]
                step = np.ones(len(a), int)
                out += [(y[a], x[a], step * dy, step * dx, p), (y[b], x[b], step * -dy, step * -dx, p)]
        return pd.DataFrame(dict(zip(("y", "x", "dy", "dx", "p"), map(np.concatenate, zip(*out)))))

    rows = amps.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "amps")
    return tiles(rows, max(tile, ny, nx), ny, nx).groupBy("ty", "tx").applyInPandas(kernel, "y int, x int, dy int, dx int, p double")


def bit_of(dy: Column, dx: Column, ny: int, nx: int) -> Column:
    return (dy + ny) * (2 * nx + 1) + dx + nx


def bit_masks(edges: DataFrame, ny: int, nx: int) -> DataFrame:
    """y, x, n_neighbors, mask: the window as bits, low first, in 32-bit words held as longs."""
    words = -(-(2 * ny + 1) * (2 * nx + 1) // WORD_BITS)
    flat = bit_of(F.col("dy"), F.col("dx"), ny, nx)
    word = lambda k: F.coalesce(F.bit_or(F.when(F.floor(flat / WORD_BITS) == k, F.call_function("shiftleft", F.lit(1).cast("long"), flat % WORD_BITS))), F.lit(0).cast("long"))
    return edges.groupBy("y", "x").agg(F.count(F.lit(1)).cast("int").alias("n_neighbors"), F.array(*[word(k) for k in range(words)]).alias("mask"))


def decode_masks(masks: DataFrame, ny: int, nx: int) -> DataFrame:
    """Edges y, x, dy, dx of the bits that are set."""
    n = (2 * ny + 1) * (2 * nx + 1)
    bit = lambda f: F.call_function("bit_get", F.element_at("mask", (F.floor(f / WORD_BITS) + 1).cast("int")), (f % WORD_BITS).cast("int"))
    flat = masks.select("y", "x", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: bit(f) == 1)).alias("f"))
    return flat.select("y", "x", (F.floor(F.col("f") / (2 * nx + 1)) - ny).cast("int").alias("dy"), (F.col("f") % (2 * nx + 1) - nx).cast("int").alias("dx"))


def popcount(mask: Column) -> Column:
    """Bits that are set in all words."""
    return F.aggregate(F.transform(mask, F.bit_count), F.lit(0), lambda a, b: a + b)
