"""The driver's tables read as rasters: valid numbers on a grid, without physical meaning.

embeddings   pixel (y, x) = (vec_id div 25, vec_id mod 25); 32 complex epochs or 64 real numbers
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, BANDS, FIRST, STEP = 25, 32, date(2022, 1, 1), 12

DATES = [FIRST + timedelta(STEP * k) for k in range(BANDS)]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, vec_id, label, e."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select(F.floor(F.col("vec_id") / WIDTH).cast("int").alias("y"), (F.col("vec_id") % WIDTH).cast("int").alias("x"), "vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("e"))


def wide(spark: SparkSession, sf_dir: str, bands: int = BANDS) -> DataFrame:
    part = lambda k: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.col("e")[2 * i + k])
    return pixels(spark, sf_dir).select("y", "x", part(0).alias("re"), part(1).alias("im"))


def stack(spark: SparkSession, sf_dir: str, bands: int = BANDS) -> DataFrame:
    z = F.posexplode(F.arrays_zip("re", "im")).alias("band", "z")
    return wide(spark, sf_dir, bands).select("y", "x", z).select("y", "x", "band", "z.re", "z.im")


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, d) for k, d in enumerate(DATES)], "band int, date date")


def edges(spark: SparkSession, sf_dir: str, ny: int = 2, nx: int = 2) -> DataFrame:
    """Neighbours with the same label, and each pixel itself."""
    from .plans.stencil import neighbour_pairs

    px = pixels(spark, sf_dir).select("y", "x", "label")
    near = neighbour_pairs(px, ny, nx, half=False).where(F.col("a.label") == F.col("b.label")).select("y", "x", "dy", "dx")
    return near.unionByName(px.select("y", "x", F.lit(0).alias("dy"), F.lit(0).alias("dx")))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("y", "x", F.when((F.col("y") + F.col("x")) % 7 == 0, 0).otherwise(1).alias("mask"))


def labels(spark: SparkSession, sf_dir: str, pairs: int = 4) -> DataFrame:
    """y, x, pair, label: stripes that differ by pair; 0 is invalid."""
    px = pixels(spark, sf_dir).select("y", "x", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))).alias("pair"))
    return px.withColumn("label", ((F.col("pair") + F.floor(F.col("y") / 5) + F.floor(F.col("x") / 5)) % 7).cast("int"))


def bperp(k: Column) -> Column:
    return (((k * 37) % 41 - 20) * 20).cast("double")


def slant(x: Column) -> Column:
    return 850000.0 + 30.0 * x


def incidence(x: Column) -> Column:
    return 30.0 + 10.0 * x / 25.0


# the same in DuckDB SQL
PX = "px as (select cast(vec_id // 25 as int) y, cast(vec_id % 25 as int) x, vec_id, cast(label as int) as label, list_transform(embedding, lambda v: v::double) e from embeddings)"


def st(n: int = BANDS) -> str:
    return f"st as (select y, x, cast(k as int) band, e[2*k+1] re, e[2*k+2] im from px, (select unnest(range({n})) k))"


def ed(ny: int = 2, nx: int = 2) -> str:
    return f"ed as (select a.y, a.x, b.y - a.y dy, b.x - a.x dx, b.y qy, b.x qx from px a join px b on b.y between a.y-{ny} and a.y+{ny} and b.x between a.x-{nx} and a.x+{nx} and a.label = b.label)"


MASK = "mk as (select y, x, case when (y + x) % 7 = 0 then 0 else 1 end mask from px)"
LABELS = "lb as (select y, x, cast(p as int) pair, cast((p + y // 5 + x // 5) % 7 as int) as label from px, (select unnest(range(4)) p))"
BPERP = "(((band * 37) % 41 - 20) * 20)::double"
SLANT, INC = "(850000.0 + 30.0 * x)::double", "(30.0 + 10.0 * x / 25.0)::double"
