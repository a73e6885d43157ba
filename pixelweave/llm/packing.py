"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Partitions pack their pieces best-fit, longest first. Of the sequences that they fill, all but the emptiest are final:
after best fit at most one is half empty, and as a sequence over half full only takes in such a one, a group of FAN
partitions can use at most FAN of the others. So each partition passes on its FAN + 1 emptiest sequences as items, which
loses no merge, and these are packed best-fit again, FAN partitions at a time, up the tree. What is passed on is bounded,
however large the input is. A sequence carries its pieces, so nothing is joined back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_batches
from .tokens import ROWS, Ids, one

LENGTH = 2048

#: Partitions that are merged at once, and pieces that are packed at once.
FAN, ITEMS = 8, 200_000

#: Pieces that a partition has at least, on average.
LEAST = 10_000

_PIECE = "struct<doc_id:{0},piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins (lists of item numbers) of best-fit decreasing: each item goes where it leaves least space."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(size + 1)]
    have = 0  # bit s: some bin has s free
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        rest = have >> n
        if rest:
            space = n + (rest & -rest).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                have ^= 1 << space
            bins[b].append(i)
        else:
            b, space = len(bins), size
            bins.append([i])
        if space - n:
            by_space[space - n].append(b)
            have |= 1 << (space - n)
    return bins


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = LENGTH, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of the ids as little-endian 32-bit numbers)."""

    def work(cols: list[list]) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        end = end_id.to_bytes(4, "little")
        for doc_id, ids in zip(cols[0], one(Ids, path).encode_all(pa.array(cols[1], pa.large_string()))):
            data = bytes(ids) + end
            for k, at in enumerate(range(0, len(data), 4 * size)):
                part = data[at : at + 4 * size]
                for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                    column.append(value)
        return out

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    return map_batches(rows, work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", ROWS)


def _pack(df: DataFrame, kind: str, size: int, carry: int) -> DataFrame:
    """Pack the items (fill, pieces) of each partition; open marks those sequences that go on."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"fill long, pieces array<{kind}>, open boolean"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list]] = []

        def give(bins: list[tuple[int, list]], is_open: bool) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(bins), 2000):
                part = bins[at : at + 2000]
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in part], pa.int64()), pa.array([b[1] for b in part], target.field(1).type), pa.array([is_open] * len(part))], schema=target)

        def packed() -> list[tuple[int, list]]:
            out = []
            for b in best_fit([f for f, _ in held], size):
                inside = [p for i in b for p in held[i][1]]
                for p, at in zip(inside, accumulate((p["length"] for p in inside), initial=0)):
                    p["offset"] = at
                out.append((sum(held[i][0] for i in b), inside))
            return sorted(out, key=lambda b: b[0])

        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(held) >= ITEMS:
                bins = packed()
                held = bins[: carry * FAN]
                yield from give(bins[carry * FAN :], False)
        bins = packed()
        yield from give(bins[:carry], True)
        yield from give(bins[carry:], False)

    return df.mapInArrow(run, schema)


def pack(items: DataFrame, size: int = LENGTH, fan: int = FAN, least: int = LEAST) -> DataFrame:
    """The pieces with sequence_id and offset; sequences are gapless from 0 and hold at most `size` tokens.

    Partitions that have less than `least` pieces on average are joined first, since few pieces fit less well.
    """
    n, parts = items.count(), items.rdd.getNumPartitions()
    items = items.coalesce(max(1, min(parts, n // least)))
    kind = _PIECE.format(items.schema["doc_id"].dataType.simpleString())
    cols = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset")).cast(kind)
    rows = items.select(F.col("length").alias("fill"), F.array(cols).alias("pieces"))
    done = [rows.where(F.col("fill") >= size)]
    state = checkpoint(_pack(rows.where(F.col("fill") < size), kind, size, fan + 1))
    while True:
        done.append(state.where(~F.col("open")).select("fill", "pieces"))
        rest = state.where("open").select("fill", "pieces")
        n = state.rdd.getNumPartitions()
        if n <= 1:
            break
        # groups of partitions are packed anew; few rows of each are open
        state = checkpoint(_pack(rest.coalesce(max(1, -(-n // fan))), kind, size, fan + 1))
    done.append(rest)
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces")
    return numbered.select("sequence_id", F.explode("pieces").alias("p")).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = LENGTH) -> DataFrame:
    """One row per piece of df's documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and id 0, so null and empty texts are one token. Only documents of more than `size`
    tokens are cut. Repeated rows are packed each on its own. Empty table: no rows. Other columns are not read.
    """
    return pack(checkpoint(pieces(df, path, id_col, text_col, size)), size)
