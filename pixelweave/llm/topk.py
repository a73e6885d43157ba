"""Exact top-k by inner product over an impact-ordered index, processed score at a time.

Vectors are dealt into shards. In a shard each dimension has its rows ordered by value and cut into segments of equal
quantised value, so a segment's impact for a query is one number: the query's component times that value. Segments of
all dimensions are processed by descending impact; each adds its lower bound to its rows. What is still to come is at
most the sum over dimensions of the largest impact left there. When the k-th best lower bound proves that most rows can't
be among the best, processing stops, and the rows that may be members are scored exactly. So the result is exact; if
there is never such a proof, all segments are processed.

The rows stay in their shards, one index at a time in a task, and each query goes to each shard: a stated query set against
all rows. What is shuffled is the rows once, and the queries once for each shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, give_back, small_batches

#: Rows of a shard, width of a quantised value, and the segments between two looks for a proof.
SHARD, WIDTH, STEP = 16_384, 32, 24

#: The share of a shard's rows that may be members when processing stops.
MEMBERS = 0.2

TOP, SCALE, EVERY = 5, 256, 50


class ImpactIndex:
    """The rows of one shard, by dimension and quantised value. rows: what tells apart rows of the same id, else the ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None, width: int = WIDTH):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)  # sums of integers below 2**53 are exact
        self.own = self.ids if rows is None else rows[order]
        level = np.floor_divide(vectors[order], width)
        self.dims, self.low, self.high, self.rows = [], [], [], []
        for d in range(vectors.shape[1]):
            by = np.argsort(level[:, d], kind="stable")
            cuts = np.flatnonzero(np.diff(level[by, d])) + 1
            for part in np.split(by, cuts):
                self.dims.append(d)
                self.low.append(self.vectors[part, d].min())
                self.high.append(self.vectors[part, d].max())
                self.rows.append(part)
        self.dims, self.low, self.high = np.array(self.dims), np.array(self.low), np.array(self.high)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids and scores, ties to smaller ids; the query's own row is none of them."""
        q = query.astype(np.float64)
        n = len(self.ids)
        a, b = q[self.dims] * self.low, q[self.dims] * self.high
        least, most = np.minimum(a, b), np.maximum(a, b)  # what a segment's rows have at least and at most
        floor = np.full(len(q), np.inf)
        np.minimum.at(floor, self.dims, least)
        impact, spread = most - floor[self.dims], most - least
        order = np.argsort(-impact, kind="stable")
        members = np.arange(n)
        if n > 4 * k:
            got = np.zeros(n)  # lower bounds, above the sum of the floors
            slack = np.zeros(len(q))
            np.maximum.at(slack, self.dims, spread)
            # after each segment: the largest impact that is left in each dimension, and what quantising may hide
            for at in range(0, len(order), STEP):
                for s in order[at : at + STEP].tolist():
                    got[self.rows[s]] += least[s] - floor[self.dims[s]]
                left = order[at + STEP :]
                to_come = np.zeros(len(q))
                np.maximum.at(to_come, self.dims[left], impact[left])
                # a row either has a dimension's part already, short by the slack, or has at most what is to come
                rest = np.maximum(to_come, slack).sum()
                kth = np.partition(got, n - k - 1)[n - k - 1]  # one more than k, for the query's own row
                may = got + rest >= kth
                if at + STEP >= len(order) or may.sum() <= MEMBERS * n:
                    members = np.flatnonzero(may)
                    break
        members = members[self.own[members] != own]
        score = self.vectors[members] @ q
        best = np.lexsort((self.ids[members], -score))[:k]
        return self.ids[members[best]], score[best].astype(np.int64)


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, or null for vectors that are null or hold null or non-finite components."""
    x = embedding.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * float(scale))))


def _answers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Answers to the queries of each shard, from rows (shard, asks, row, id, v) in the order of shard and asks."""
    held: list[tuple[np.ndarray, ...]] = []  # rows of a shard: row, id, length, all components
    shard, indexes = None, {}
    for batch in batches:
        shards, asks, row, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        lengths = np.diff(batch.column(4).offsets.to_numpy())
        flat = batch.column(4).flatten().to_numpy()
        starts = np.cumsum(lengths) - lengths
        cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(asks) != 0)) + 1
        found: list[tuple[np.ndarray, ...]] = []
        for lo, hi in zip([0, *cuts], [*cuts, len(shards)]):
            if lo == hi:
                continue
            if shards[lo] != shard:
                shard, held, indexes = shards[lo], [], {}
            if not asks[lo]:
                held.append((row[lo:hi], ids[lo:hi], lengths[lo:hi], flat[starts[lo] : starts[hi - 1] + lengths[hi - 1]]))
                continue
            if held:  # the shard is complete: an index for each length of vectors
                all_row, all_ids, all_lengths, all_flat = map(np.concatenate, zip(*held))
                each = np.repeat(all_lengths, all_lengths)
                indexes = {n: ImpactIndex(all_ids[all_lengths == n], all_flat[each == n].reshape(-1, n), all_row[all_lengths == n]) for n in np.unique(all_lengths).tolist()}
                held = []
            for q in range(lo, hi):
                if index := indexes.get(int(lengths[q])):
                    best, score = index.search(row[q], flat[starts[q] : starts[q] + lengths[q]], k)
                    found.append((np.full(len(best), row[q]), np.full(len(best), ids[q]), best, score))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in map(np.concatenate, zip(*found))], ["row", "query_id", "vec_id", "score"])
    give_back()


def top_k(vectors: DataFrame, asked: Column, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `vectors` with the largest inner product for each row that is asked for.

    Every row is a candidate but the query's own; ties go to smaller ids. Vectors that are null, empty or hold null or
    non-finite components take no part, nor do null ids; a vector of another length than the query's is no candidate. Rows
    that repeat an id are rows of their own, as queries and as candidates. With fewer rows than k, all are returned; from an
    empty table, none. Columns of other names do no harm: `asked` is taken on `vectors`.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), quantised(F.col(f"`{vector_col}`"), scale).alias("v"), asked.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0)).select(F.monotonically_increasing_id().alias("row"), "id", "v", F.coalesce("asks", F.lit(False)).alias("asks"))
    rows = checkpoint(rows)  # the numbers of the rows stay
    parts = max(1, -(-rows.count() // SHARD))
    held = rows.select(F.pmod(F.xxhash64("row"), F.lit(parts)).alias("shard"), F.lit(False).alias("asks"), "row", "id", "v")
    sent = rows.where("asks").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("shard"), "asks", "row", "id", "v")
    small_batches(rows.sparkSession)
    met = held.unionByName(sent).repartition(parts, "shard").sortWithinPartitions("shard", "asks")
    out = met.mapInArrow(lambda batches: _answers(batches, k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
