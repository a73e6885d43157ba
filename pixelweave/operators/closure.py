"""Design matrices of pair networks, closure phases, integer ambiguities and connected regions."""

from __future__ import annotations

from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import checkpoint
from ..plans.components import components
from ..plans.linalg import weight_table


def split_pairs(names: list[str], delimiter: str = "_") -> list[tuple[str, str]]:
    """Pairs out of texts such as t1_t2."""
    return [tuple(n.split(delimiter, 1)) for n in names]


def epochs_table(pairs: DataFrame) -> DataFrame:
    """epoch, k (from 0) of the epochs of pairs (ref, follower), in order of their value."""
    each = pairs.select(F.explode(F.array("ref", "follower")).alias("epoch")).distinct()
    return each.select("epoch", (F.dense_rank().over(Window.orderBy("epoch")) - 1).alias("k"))


def time_series_matrix(pairs: DataFrame) -> DataFrame:
    """pair, epoch, w: -1 at the reference and 1 at the follower, the first epoch dropped."""
    first = pairs.agg(F.min(F.least("ref", "follower")).alias("first"))
    w = F.explode(F.array(F.struct(F.col("ref").alias("epoch"), F.lit(-1).alias("w")), F.struct(F.col("follower").alias("epoch"), F.lit(1).alias("w"))))
    return pairs.select("pair", w.alias("e")).select("pair", "e.*").join(F.broadcast(first), F.col("epoch") != F.col("first")).drop("first")


def differential_matrix(pairs: DataFrame) -> DataFrame:
    """pair, k, w: 1 for each interval between epochs k and k + 1 from the reference to the follower."""
    k = epochs_table(pairs)
    both = pairs.join(F.broadcast(k.select(F.col("epoch").alias("ref"), F.col("k").alias("i"))), "ref").join(F.broadcast(k.select(F.col("epoch").alias("follower"), F.col("k").alias("j"))), "follower")
    return both.select("pair", F.explode(F.sequence(F.col("i"), F.col("j") - 1)).alias("k"), F.lit(1).alias("w"))


def triplets(pairs: DataFrame) -> DataFrame:
    """p12, p13, p23: pairs (t1,t2), (t1,t3), (t2,t3) that close a loop; the closure is phi12 - phi13 + phi23."""
    e = lambda a, b, p: pairs.select(F.col("ref").alias(a), F.col("follower").alias(b), F.col("pair").alias(p))
    return e("t1", "t2", "p12").join(e("t1", "t3", "p13"), "t1").join(e("t2", "t3", "p23"), ["t2", "t3"]).select("p12", "p13", "p23").distinct()


def triplet_matrix(pairs: list[tuple]) -> np.ndarray:
    """The closures of a network as a matrix (triplets x pairs), in order of the first pair, then the second."""
    at = {p: i for i, p in enumerate(pairs)}
    rows = []
    for (a, b), i in sorted(at.items(), key=lambda kv: kv[1]):
        for (c, d), j in sorted(at.items(), key=lambda kv: kv[1]):
            if c == a and d != b and (b, d) in at:
                row = np.zeros(len(pairs))
                row[i], row[j], row[at[b, d]] = 1, -1, 1
                rows.append(row)
    return np.array(rows).reshape(-1, len(pairs))


def closure_phases(obs: DataFrame, loops: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """y, x, loop columns and closure, from long phases (y, x, pair, phase) less their pair's offset.

    Each loop asks for three pairs; the loop table is small, so phases are joined to it and summed, not to themselves.
    """
    if offsets is not None:
        obs = obs.join(F.broadcast(offsets), "pair").withColumn("phase", F.col("phase") - F.col("offset"))
    part = F.explode(F.array(*[F.struct(F.col(p).alias("pair"), F.lit(w).alias("w")) for p, w in (("p12", 1.0), ("p13", -1.0), ("p23", 1.0))]))
    need = loops.select("p12", "p13", "p23", part.alias("n")).select("p12", "p13", "p23", "n.*")
    return obs.join(F.broadcast(need), "pair").groupBy("y", "x", "p12", "p13", "p23").agg(F.sum(F.col("w") * F.col("phase")).alias("closure"), F.count(F.lit(1)).alias("n")).where("n = 3").drop("n")


def common_mask(labels: DataFrame) -> DataFrame:
    """y, x, mask: 1 where no pair's label (y, x, pair, label) is 0."""
    return labels.groupBy("y", "x").agg(F.min(F.when(F.col("label") != 0, 1).otherwise(0)).alias("mask"))


def label_regions(mask: DataFrame, width: int, connectivity: int = 8, tile: int = 128) -> DataFrame:
    """y, x, region of the pixels whose mask is not 0: connected pixels share the least y * width + x among them.

    Pixels are labelled inside square tiles, a task each of at most tile * tile pixels; only links over the borders of
    tiles, one for each two parts that touch, go into connected components.
    """
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    at = lambda c: F.floor(F.col(c) / tile)
    on = mask.where(F.col("mask") != 0).select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf.y.to_numpy(), pdf.x.to_numpy()
        node = y * width + x
        gy, gx = y - y.min() + 1, x - x.min() + 1
        label = np.full((gy.max() + 2, gx.max() + 2), np.iinfo(np.int64).max)
        label[gy, gx] = node
        before = None
        while before is None or (label[gy, gx] != before).any():
            before = label[gy, gx]
            label[gy, gx] = np.minimum.reduce([before] + [label[gy + s * dy, gx + s * dx] for dy, dx in steps for s in (1, -1)])
        return pd.DataFrame({"y": y, "x": x, "part": label[gy, gx]})

    parts = checkpoint(on.groupBy(at("y").alias("ty"), at("x").alias("tx")).applyInPandas(kernel, "y long, x long, part long"))
    edge = parts.where(F.pmod("y", F.lit(tile)).isin(0, tile - 1) | F.pmod("x", F.lit(tile)).isin(0, tile - 1))
    near = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("qy"), (F.col("x") + dx).alias("qx")) for dy, dx in steps]))
    over = edge.select(F.col("part").alias("a"), at("y").alias("ty"), at("x").alias("tx"), near.alias("q")).select("a", "ty", "tx", "q.*")
    over = over.where((at("qy") != F.col("ty")) | (at("qx") != F.col("tx")))
    links = over.join(edge.select(F.col("y").alias("qy"), F.col("x").alias("qx"), F.col("part").alias("b")), ["qy", "qx"]).select("a", "b").distinct()
    out = parts.join(components(links), F.col("part") == F.col("node"), "left")
    kinds = {c: mask.schema[c].dataType for c in ("y", "x")}
    return out.select(*[F.col(c).cast(kinds[c]).alias(c) for c in kinds], F.coalesce("root", "part").alias("region"))


def region_overlap(labels: DataFrame, regions: DataFrame) -> DataFrame:
    """pair, label, region that share a pixel."""
    return labels.where("label != 0").join(regions, ["y", "x"]).select("pair", "label", "region").distinct()


def ambiguities(spark: SparkSession, closures: DataFrame, regions: DataFrame, g: np.ndarray, samples: int = 20) -> DataFrame:
    """region, pair, u: whole cycles of each pair, from the closures (y, x, loop, closure) of a region's first pixels.

    The system of equal blocks -2 pi G u = closure is solved by its pseudo-inverse times the mean, rounded to even.
    """
    w = Window.partitionBy("region").orderBy("y", "x")
    first = regions.withColumn("k", F.row_number().over(w)).where(F.col("k") <= samples).drop("k")
    mean = closures.join(first, ["y", "x"]).groupBy("region", "loop").agg(F.avg("closure").alias("closure"))
    weights = weight_table(spark, np.linalg.pinv(-2 * pi * g), "pair", "loop")
    return mean.join(F.broadcast(weights), "loop").groupBy("region", "pair").agg(F.rint(F.round(F.sum(F.col("w") * F.col("closure")), 9)).cast("int").alias("u"))


def assign_ambiguities(labels: DataFrame, regions: DataFrame, u: DataFrame) -> DataFrame:
    """y, x, pair, u: each labelled area gets the rounded median of the regions that it overlaps; 0 where it has none."""
    overlap = region_overlap(labels, regions).join(u, ["region", "pair"])
    own = overlap.groupBy("pair", "label").agg(F.rint(F.percentile("u", F.lit(0.5))).cast("int").alias("u"))
    return labels.join(F.broadcast(own), ["pair", "label"], "left").select("y", "x", "pair", F.coalesce("u", F.lit(0)).alias("u"))


def corrected(obs: DataFrame, u: DataFrame) -> DataFrame:
    """obs (y, x, pair, phase) plus 2 pi u."""
    return obs.join(u, ["y", "x", "pair"], "left").withColumn("phase", F.col("phase") + 2 * pi * F.coalesce("u", F.lit(0))).drop("u")
