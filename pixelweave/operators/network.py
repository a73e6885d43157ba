"""Networks of interferogram pairs from dates and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def single_master(scenes: DataFrame) -> DataFrame:
    """ref, follower: the first date with every other one."""
    first = scenes.agg(F.min("date").alias("ref"))
    return scenes.crossJoin(F.broadcast(first)).where(F.col("date") != F.col("ref")).select("ref", F.col("date").alias("follower"))


def geometrical_coherence(scenes: DataFrame, wavelength: float, slant: float, range_resolution: float, incidence_deg: float, floor: float = 0.001) -> DataFrame:
    """ref, follower, coh of all pairs of scenes (date, bperp): 1 - 2 |dB| rs cos^2(incidence) / wavelength / slant, floored.

    A scene list is a dimension table of the driver's size, so the pairs are a self-join on order.
    """
    a, b = scenes.select(F.col("date").alias("ref"), F.col("bperp").alias("b1")), scenes.select(F.col("date").alias("follower"), F.col("bperp").alias("b2"))
    pairs = a.join(F.broadcast(b), F.col("ref") < F.col("follower"))
    coh = 1 - 2 * F.abs(F.col("b1") - F.col("b2")) * range_resolution * F.pow(F.cos(F.radians(F.lit(incidence_deg))), 2) / wavelength / slant
    return pairs.select("ref", "follower", F.greatest(coh, F.lit(floor)).alias("coh"))


def small_baseline(scenes: DataFrame, max_days: int, max_baseline: float) -> DataFrame:
    """ref, follower of scenes that are near in time and baseline."""
    a, b = scenes.select(F.col("date").alias("ref"), F.col("bperp").alias("b1")), scenes.select(F.col("date").alias("follower"), F.col("bperp").alias("b2"))
    near = (F.col("ref") < F.col("follower")) & (F.datediff("follower", "ref") <= max_days) & (F.abs(F.col("b1") - F.col("b2")) <= max_baseline)
    return a.join(F.broadcast(b), near).select("ref", "follower")


def nearest_neighbours(scenes: DataFrame, n: int) -> DataFrame:
    """ref, follower: each date with the next n."""
    w = Window.orderBy("date")
    return scenes.select(F.col("date").alias("ref"), F.explode(F.array(*[F.lead("date", k).over(w) for k in range(1, n + 1)])).alias("follower")).where(F.col("follower").isNotNull())


def spanning_trees(spark: SparkSession, pairs: list[tuple], n: int = 1, used: float = 0.001) -> DataFrame:
    """tree, ref, follower of n minimum spanning trees on 1 / coherence; a tree's pairs count as `used` for the next.

    pairs: (ref, follower, coh) of a scene network, which has a few thousand entries at most.
    """
    coh = {(a, b): c for a, b, c in pairs}
    out = []
    for tree in range(n):
        parent = {d: d for p in coh for d in p}

        def find(d, parent=parent):
            while parent[d] != d:
                parent[d] = parent[parent[d]]
                d = parent[d]
            return d

        for a, b in sorted(coh, key=lambda p: (1 / coh[p], p)):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[ra] = rb
                out.append((tree, a, b))
                coh[a, b] = used
    return spark.createDataFrame(out, "tree int, ref date, follower date")
