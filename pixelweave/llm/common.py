"""What several operators of this subpackage share: checkpoints, guarded broadcasts, Arrow row streams."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import checkpoint as checkpoint
from ..plans.checkpoints import folder
from ..plans.checkpoints import tidy as tidy

#: Rows up to which a table may be broadcast; above, the join is shuffled (adaptive execution splits hot keys).
BROADCAST_ROWS = 50_000

#: Rows and bytes of an Arrow batch; the usual 10,000 long texts would hold much memory in both the JVM and Python.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20

#: The white space of the contracts, and what is between it.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of this run in the shared folder, read again. It stays there for whoever needs it."""
    path = f"{folder(df.sparkSession)}/tables/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def join_small(df: DataFrame, small: DataFrame, on: Column, rows: int, how: str = "left") -> DataFrame:
    """Join a side of `rows` counted rows: broadcast below the bound, shuffled above it."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python in batches of BATCH_ROWS and BATCH_BYTES, unless the session names its own bytes and fewer rows.

    Plans read these settings when they run, so they stay set in the session; they change no result.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if spark.conf.get(size, str(BATCH_BYTES + 1)) == str(BATCH_BYTES + 1):  # not set
        spark.conf.set(size, BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def give_back() -> None:
    """Return freed memory to the system, as reused workers would else hold what earlier stages needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[list[list]], list], schema: str, rows: int = 256, held: list | None = None) -> DataFrame:
    """Stream rows through fn, some hundred at a time: fn gets a list for each input column and returns one for each output
    column. held: what fn keeps for a task, which is let go at the end."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the kernels make no cycles, and each collection walks all that they remember
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    out = fn([c.to_pylist() for c in part.columns])
                    yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, target, strict=True)], schema=target)
        finally:
            gc.enable()
            if held is not None:
                held.clear()
            give_back()

    return df.mapInArrow(run, schema)


def row_udf(fn: Callable[[list], list], schema: str, rows: int = 256, held: list | None = None) -> Callable[[Column], Column]:
    """A column function of one column over Arrow batches, some hundred rows at a time; for operators that keep all columns
    of their input. held: as in map_batches()."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(f"v {schema}")).field(0).type
    small_batches(SparkSession.active())

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for values in batches:
                out: list = []
                for at in range(0, len(values), rows):
                    out += fn(values.slice(at, rows).to_pylist())
                yield pa.array(out, kind)
        finally:
            if held is not None:
                held.clear()
            give_back()

    return run
