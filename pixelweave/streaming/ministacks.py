"""New acquisitions as a stream: micro-batches are stored, and a mini stack is handed on once all its dates are there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def follow(acquisitions: DataFrame, folder: str, size: int, close: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start to follow a stream of rows y, x, band, re, im.

    Batches are written under their number, so one that is repeated after a failure replaces itself, and by mini stack, so
    that a batch reads only the stacks that it has rows of. close(rows, k) is called for each mini stack k of `size` bands
    that is complete, in order. k is marked after that, with the batch that closed it: a failure between the two has
    close(rows, k) called again with the same rows, so close has to replace what it wrote for k. Rows of a stack that an
    earlier batch closed do not change it; they are kept apart, see late_rows().
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.withColumn("ministack", F.floor(F.col("band") / size)).write.mode("overwrite").partitionBy("ministack").parquet(f"{folder}/rows/batch={number}")
        if not _exists(spark, f"{folder}/rows/batch={number}"):
            return  # no rows
        mine = spark.read.parquet(f"{folder}/rows/batch={number}")
        met = [k for (k,) in mine.select("ministack").distinct().collect()]  # of one batch
        done: list[int] = []
        if _exists(spark, f"{folder}/closed"):
            marks = spark.read.parquet(f"{folder}/closed").where(F.col("ministack").isin(met) & (F.col("batch") < number))
            done = [k for (k,) in marks.select("ministack").collect()]
        if done:
            mine.where(F.col("ministack").isin(done)).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        rows = spark.read.parquet(f"{folder}/rows").where(F.col("ministack").isin([k for k in met if k not in done]) & (F.col("batch") <= number))
        full = rows.groupBy("ministack").agg(F.countDistinct("band").alias("n")).where(F.col("n") == size).select("ministack")
        for (k,) in sorted(full.collect()):
            close(rows.where(F.col("ministack") == k).drop("ministack", "batch").dropDuplicates(["y", "x", "band"]), k)
            spark.createDataFrame([(number,)], "batch long").write.mode("overwrite").parquet(f"{folder}/closed/ministack={k}")

    return acquisitions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(spark: SparkSession, folder: str) -> DataFrame | None:
    """Rows that came after their mini stack was closed, with ministack and batch; None where there are none."""
    return spark.read.parquet(f"{folder}/late") if _exists(spark, f"{folder}/late") else None


def windowed_means(acquisitions: DataFrame, late: str = "30 days", window: str = "60 days") -> DataFrame:
    """Mean amplitudes of a stream (time, y, x, re, im) by windows of time, rows later than `late` left out."""
    amp = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return acquisitions.withWatermark("time", late).groupBy(F.window("time", window)).agg(F.avg(amp).alias("amp"), F.count(F.lit(1)).alias("n"))
