"""Readers and writers of rasters, and the stream of acquisitions."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.model import RasterError
from pixelweave.sources import raster
from pixelweave.streaming import ministacks


def _image(path, z):
    path.parent.mkdir(parents=True, exist_ok=True)
    z.astype("<c8").tofile(path)


def test_stacks_of_raw_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    z = {d: (rng.normal(size=(5, 4)) + 1j * rng.normal(size=(5, 4))).astype("<c8") for d in ("20220113", "20220101")}
    for d, v in z.items():
        _image(tmp_path / "SLC" / d / f"{d}.slc.full", v)
    stack, bands = raster.read_tops(spark, str(tmp_path), 4, crop=(1, 1, 3, 2))
    assert [(r.band, r.date) for r in bands.orderBy("band").collect()] == [(0, date(2022, 1, 1)), (1, date(2022, 1, 13))]
    got = {(r.y, r.x, r.band): complex(r.re, r.im) for r in stack.collect()}
    assert len(got) == 12 and got[2, 1, 1] == complex(z["20220113"][2, 1])
    out = str(tmp_path / "out")
    raster.write_raster(stack, out, "band")
    assert spark.read.parquet(out).count() == 12
    with pytest.raises(Exception, match="exists|EXIST"):
        raster.write_raster(stack, out, "band")


def test_annotated_images_and_geometry(spark, tmp_path):
    for k, d in enumerate(("02-Jan-2020 10:00:00 UTC", "01-Jan-2020 10:00:00 UTC")):
        _image(tmp_path / f"i{k}.slc", np.full((2, 3), k + 1j))
        (tmp_path / f"i{k}.ann").write_text(f"Start Time of Acquisition (text) = {d} ; when\nCenter Wavelength (cm) = 23.8\n")
    stack, bands = raster.read_airborne(spark, str(tmp_path), 3)
    assert [r.date.day for r in bands.orderBy("band").collect()] == [1, 2] and stack.where("band = 0").first().re == 1.0
    (tmp_path / "i1.ann").unlink()
    with pytest.raises(RasterError):
        raster.read_airborne(spark, str(tmp_path), 3)
    llh = np.arange(18, dtype="<f4")
    llh.tofile(tmp_path / "g.llh")
    assert {tuple(r) for r in raster.read_llh(spark, str(tmp_path / "g.llh"), 3).collect()} == {(y, x, *(float(3 * (3 * y + x) + k) for k in range(3))) for y in range(2) for x in range(3)}


def test_stretch_is_bilinear(spark):
    v = np.random.default_rng(1).normal(size=(3, 4))
    df = spark.createDataFrame([(y, x, float(v[y, x])) for y in range(3) for x in range(4)], "y int, x int, v double")
    got = {(r.y, r.x): r.v for r in raster.stretch(df, "v", 6, 12, 2, 3).collect()}
    assert len(got) == 72
    for (y, x), value in got.items():
        fy, fx = np.clip((y + 0.5) / 2 - 0.5, 0, 2), np.clip((x + 0.5) / 3 - 0.5, 0, 3)
        a, b = min(int(fy), 1), min(int(fx), 2)
        p, q = fy - a, fx - b
        want = (1 - p) * ((1 - q) * v[a, b] + q * v[a, b + 1]) + p * ((1 - q) * v[a + 1, b] + q * v[a + 1, b + 1])
        assert np.isclose(value, want)


def test_pair_lists(spark, tmp_path):
    p = tmp_path / "pairs.csv"
    p.write_text("Master Date,Slave Date,Unwrapped Interferogram,Coherence,Scale\n20200101,20200113,a.unw,a.cor,\n20200113,20200125,b.unw,b.cor,2\n")
    got = raster.read_pairs(spark, str(p), threshold=0.3).orderBy("master").collect()
    assert [(r.master, r.threshold, r.scale) for r in got] == [(date(2020, 1, 1), 0.3, 1.0), (date(2020, 1, 13), 0.3, 2.0)]
    p.write_text("master date,slave date,unwrapped interferogram,coherence\n20200101,,a.unw,a.cor\n")
    with pytest.raises(RasterError):
        raster.read_pairs(spark, str(p))
    p.write_text("master date,slave date\n20200101,20200113\n")
    with pytest.raises(RasterError):
        raster.read_pairs(spark, str(p))
    p.write_text("Date,Baseline\n20200101,b.bin\n")
    assert raster.read_baselines(spark, str(p)).first().date == date(2020, 1, 1)


def test_commands_are_one_ordered_file(spark, tmp_path):
    df = spark.createDataFrame([(date(2020, 1, 2), "b"), (date(2020, 1, 1), "a")], "date date, command string")
    raster.write_commands(df, str(tmp_path / "c"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "c")).collect()] == ["a", "b"]


def test_a_stream_closes_complete_mini_stacks_once(spark, tmp_path):
    schema = "y int, x int, band int, re double, im double"
    closed = []
    for part in ([0, 1], [2, 3, 4]):
        rows = [(0, x, b, 1.0, 0.0) for b in part for x in range(2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = ministacks.follow(stream, str(tmp_path / "state"), 2, lambda df, k: closed.append((k, df.count())), str(tmp_path / "cp"))
        q.awaitTermination()
    assert closed == [(0, 4), (1, 4)]


def test_a_failure_before_the_mark_closes_again_and_late_rows_are_kept(spark, tmp_path):
    schema = "y int, x int, band int, re double, im double"
    calls, broken = [], [True]

    def close(df, k):
        df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"stack={k}"))
        calls.append(k)
        if k == 1 and broken.pop():
            broken.append(False)
            raise RuntimeError("lost after its work, before its mark")

    def arrive(bands, x=(0, 1)):
        spark.createDataFrame([(0, c, b, 1.0, 0.0) for b in bands for c in x], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def go():
        q = ministacks.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), 2, close, str(tmp_path / "cp"))
        q.awaitTermination()

    arrive([0, 1, 2, 3, 4])
    with pytest.raises(Exception, match="before its mark"):
        go()
    go()  # the same batch again: its rows of closed stacks are not late
    assert calls == [0, 1, 0, 1] or calls == [0, 1, 1]
    assert ministacks.late_rows(spark, str(tmp_path / "state")) is None
    arrive([1], x=(7,))
    arrive([5])
    go()
    late = ministacks.late_rows(spark, str(tmp_path / "state")).collect()
    assert [(r.x, r.band, r.ministack) for r in late] == [(7, 1, 0)] and calls[-1] == 2
    out = spark.read.parquet(str(tmp_path / "out")).groupBy("stack").count().collect()
    assert {r["stack"]: r["count"] for r in out} == {0: 4, 1: 4, 2: 4}


def test_windowed_means(spark, tmp_path):
    schema = "time timestamp, y int, x int, re double, im double"
    spark.createDataFrame([(1_600_000_000, 3.0)], "t long, re double").select(F.timestamp_seconds("t").alias("time"), F.lit(0).alias("y"), F.lit(0).alias("x"), "re", F.lit(4.0).alias("im")).write.parquet(str(tmp_path / "in"))
    q = ministacks.windowed_means(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("means").first().amp == 5.0
