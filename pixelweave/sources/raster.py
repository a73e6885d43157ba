"""Raw rasters, stacks of acquisitions, subsets and sinks. Files are opened by Spark alone, so any of its stores will do."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import RasterError

#: Numpy types of raw samples.
TYPES = {"complex64": np.dtype("<c8"), "float32": np.dtype("<f4"), "float64": np.dtype("<f8"), "uint8": np.dtype("u1"), "int16": np.dtype("<i2"), "uint32": np.dtype("<u4")}


def read_raw(spark: SparkSession, path: str, width: int, kind: str = "complex64", bands: int = 1) -> DataFrame:
    """y, x and re, im (complex), value (one real band) or values (an array of interleaved ones) of a raw raster.

    Lines are fixed-length records, so that a file of any size is split; each task decodes its own lines.
    """
    dtype = TYPES[kind]
    length = width * bands * dtype.itemsize
    lines = spark.sparkContext.binaryRecords(path, length).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))
    rows = spark.createDataFrame(lines, "y long, line binary")
    schema = "y int, x int, re double, im double" if kind == "complex64" else "y int, x int, value double" if bands == 1 else "y int, x int, values array<double>"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.arange(width, dtype=np.int32)
        for batch in batches:
            for y, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.frombuffer(line, dtype)
                cols = {"y": np.full(width, y, np.int32), "x": x}
                if kind == "complex64":
                    cols |= {"re": v.real.astype(float), "im": v.imag.astype(float)}
                elif bands == 1:
                    cols["value"] = v.astype(float)
                else:
                    cols["values"] = pa.array(list(v.reshape(width, bands).astype(float)))
                yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(decode, schema)


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in order, without reading them."""
    return sorted(r[0] for r in spark.read.format("binaryFile").load(pattern).select("path").collect())


def stack_dates(paths: list[str], pattern: str = r"(\d{8})[^/]*/[^/]*$") -> list[date]:
    """The date in each path: by default of the parent folder, which has one for each acquisition."""
    out = []
    for p in paths:
        m = re.search(pattern, p)
        if not m:
            raise RasterError(104, f"no date in {p}")
        out.append(datetime.strptime(m[1], "%Y%m%d").date())
    return out


def read_stack(spark: SparkSession, pattern: str, width: int, wavelength: float, crop: tuple[int, int, int, int] | None = None, date_pattern: str = r"(\d{8})[^/]*/[^/]*$") -> tuple[DataFrame, DataFrame]:
    """A long stack (y, x, band, re, im) and its bands (band, date, decimal_year, wavelength), in order of the dates."""
    from ..functions.dates import decimal_year

    paths = list_files(spark, pattern)
    found = sorted(zip(stack_dates(paths, date_pattern), paths))
    parts = []
    for band, (_, path) in enumerate(found):
        part = read_raw(spark, path, width).withColumn("band", F.lit(band))
        parts.append(subset(part, *crop) if crop else part)
    bands = spark.createDataFrame([(i, d, float(wavelength)) for i, (d, _) in enumerate(found)], "band int, date date, wavelength double")
    return reduce(DataFrame.unionByName, parts).select("y", "x", "band", "re", "im"), bands.select("band", "date", decimal_year(F.col("date")).alias("decimal_year"), "wavelength")


def read_tops(spark: SparkSession, folder: str, width: int, **options) -> tuple[DataFrame, DataFrame]:
    """Coregistered burst stacks: folder/SLC/<date>/*.slc.full."""
    return read_stack(spark, f"{folder}/SLC/*/*.slc.full", width, options.pop("wavelength", 0.05546576), **options)


def read_stripmap(spark: SparkSession, folder: str, width: int, **options) -> tuple[DataFrame, DataFrame]:
    """Stripmap stacks: folder/<date>/*.slc."""
    return read_stack(spark, f"{folder}/*/*.slc", width, options.pop("wavelength", 0.03), **options)


def parse_annotation(text: str) -> dict[str, str]:
    """`name (unit) = value ; comment` lines of an annotation file, names in lower case."""
    out = {}
    for line in text.splitlines():
        body = line.split(";")[0]
        key, eq, value = body.partition("=")
        if eq and key.strip():
            out[re.sub(r"\s*\([^)]*\)\s*$", "", key.strip()).lower()] = value.strip()
    return out


def annotation_date(fields: dict[str, str], key: str = "start time of acquisition") -> date:
    return datetime.strptime(fields[key], "%d-%b-%Y %H:%M:%S UTC").date()


def read_airborne(spark: SparkSession, folder: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Airborne stacks: one annotation per acquisition (*.ann beside *.slc), from which dates and wavelengths come."""
    images, notes = list_files(spark, f"{folder}/*.slc"), list_files(spark, f"{folder}/*.ann")
    if len(images) != len(notes):
        raise RasterError(103, "as many annotations as images are needed")
    fields = [parse_annotation(r[0]) for r in (spark.read.text(n, wholetext=True).first() for n in notes)]
    found = sorted(zip((annotation_date(f) for f in fields), images, (float(f.get("center wavelength", "nan")) for f in fields)))
    parts = [read_raw(spark, p, width).withColumn("band", F.lit(b)) for b, (_, p, _) in enumerate(found)]
    bands = spark.createDataFrame([(i, d, w) for i, (d, _, w) in enumerate(found)], "band int, date date, wavelength double")
    return reduce(DataFrame.unionByName, parts).select("y", "x", "band", "re", "im"), bands


def read_llh(spark: SparkSession, path: str, width: int) -> DataFrame:
    """y, x, lat, lon, hgt of triples of floats."""
    v = F.col("values")
    return read_raw(spark, path, width, "float32", 3).select("y", "x", v[0].alias("lat"), v[1].alias("lon"), v[2].alias("hgt"))


def stretch(layer: DataFrame, value: str, rows: int, cols: int, fy: int, fx: int) -> DataFrame:
    """A multilooked layer at rows x cols pixels, bilinear between its cells; edges are held.

    A cell knows the pixels that it weighs on, so this is an explosion and a sum, not a search.
    """
    ny, nx = -(-rows // fy), -(-cols // fx)

    def spread(c: str, f: int, n: int, size: int) -> Column:
        """Pixels with their weight of a cell at index c."""
        lo, hi = F.greatest((F.col(c) - 1) * f, F.lit(0)), F.least((F.col(c) + 2) * f - 1, F.lit(size - 1))
        at = lambda p: F.greatest(F.least((p + 0.5) / f - 0.5, F.lit(n - 1.0)), F.lit(0.0))
        return F.filter(F.transform(F.sequence(lo.cast("int"), hi.cast("int")), lambda p: F.struct(p.alias("p"), F.greatest(F.lit(0.0), 1 - F.abs(at(p) - F.col(c))).alias("w"))), lambda s: s["w"] > 0)

    down = layer.select("y", "x", value, F.explode(spread("y", fy, ny, rows)).alias("a")).select("x", value, F.col("a.p").alias("py"), F.col("a.w").alias("wy"))
    both = down.select("py", "wy", value, F.explode(spread("x", fx, nx, cols)).alias("b"))
    w = F.col("wy") * F.col("b.w")
    return both.groupBy(F.col("py").alias("y"), F.col("b.p").alias("x")).agg((F.sum(F.col(value) * w) / F.sum(w)).alias(value))


def subset(pixels: DataFrame, y0: int, x0: int, rows: int, cols: int) -> DataFrame:
    """Pixels of a window, with their own indices; the filter reaches the scan of a stored stack."""
    return pixels.where(F.col("y").between(y0, y0 + rows - 1) & F.col("x").between(x0, x0 + cols - 1))


def geographic_window(geometry: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """One row y0, x0, rows, cols: the window between the pixels next to the south-east and north-west corners."""
    near = lambda lat, lon: F.min_by(F.struct("y", "x"), F.struct(F.pow(F.col("lat") - lat, 2) + F.pow(F.col("lon") - lon, 2), "y", "x"))
    c = geometry.agg(near(south, east).alias("a"), near(north, west).alias("b"))
    lo, hi = lambda f: F.least(f"a.{f}", f"b.{f}"), lambda f: F.greatest(f"a.{f}", f"b.{f}")
    return c.select(lo("y").alias("y0"), lo("x").alias("x0"), (hi("y") - lo("y") + 1).alias("rows"), (hi("x") - lo("x") + 1).alias("cols"))


def read_pairs(spark: SparkSession, path: str, threshold: float = 0.2, scale: float = 1.0) -> DataFrame:
    """master, slave, unwrapped, coherence, threshold, scale from a CSV with named columns; the last two are optional.

    Names are taken in lower case; a mandatory field that is empty is an error.
    """
    df = spark.read.csv(path, header=True)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    must = {"master date": "master", "slave date": "slave", "unwrapped interferogram": "unwrapped", "coherence": "coherence"}
    if missing := [c for c in must if c not in df.columns]:
        raise RasterError(106, f"columns are missing: {missing}")
    if not df.where(reduce(Column.__or__, [F.col(c).isNull() for c in must])).isEmpty():
        raise RasterError(107, "a mandatory field is empty")
    extra = [F.coalesce(F.col(c).cast("double") if c in df.columns else F.lit(None), F.lit(v)).alias(c) for c, v in (("threshold", threshold), ("scale", scale))]
    return df.select(*[F.to_date(c, "yyyyMMdd").alias(n) if n in ("master", "slave") else F.col(c).alias(n) for c, n in must.items()], *extra)


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    return df.toDF(*[c.strip().lower() for c in df.columns]).select(F.to_date("date", "yyyyMMdd").alias("date"), "baseline")


def write_raster(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, split by a column; refuses a folder that exists. Rows are sorted by position, so windows prune row groups."""
    keys = [c for c in (by, "y", "x") if c and c in df.columns]
    writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_commands(commands: DataFrame, path: str) -> None:
    """One text file with a command per line, in order of the dates."""
    commands.orderBy("date").select("command").coalesce(1).write.mode("errorifexists").text(path)


def with_constants(bands: DataFrame, calibrated: DataFrame) -> DataFrame:
    """bands with the amplitude constant of each."""
    return bands.join(F.broadcast(calibrated.select("band", "amp_const")), "band", "left").fillna(1.0, ["amp_const"])
