"""Near-duplicate documents by SimHash fingerprints, BK-trees and connected components.

1. Each text gets a 64-bit fingerprint of its word shingles (vectorised, in bounded blocks, whole texts).
2. Fingerprints at radius r or less agree on one of r + 1 bit blocks, so each distinct fingerprint goes to one shard for
   each block. A shard's BK-tree holds its fingerprints, children keyed by their integer Hamming distance to the parent;
   a query follows only edges within the radius. Shards that are larger than SHARD are dealt again by blocks of their
   remaining bits, which is as exact, until they are small: once all bits are used a shard holds one fingerprint. So no
   shard is cut short, none grows with a group of copies, and no pair is tested outside a shard. Trees meet their queries
   in the shuffle instead of by a broadcast from the driver, which must not hold the fingerprints of all documents.
3. Within a shard, links are merged, and those that join a member to the least of its part are kept. Alternating
   large-star and small-star steps over these links give the components.

Equal fingerprints are one node throughout, so that copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import components
from .common import checkpoint, join_small, map_batches, row_udf, tidy
from .tokens import Memory

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42

#: Fingerprints that one BK-tree holds at most, and shingles that are counted at once.
SHARD, BLOCK = 2048, 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles, repeats included; no word gives 0.

    A-Z are lower-cased; words are divided by the six ASCII white-space characters; fewer words than a shingle has
    are one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    lo, hi = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(lo[at : at + BLOCK], hi[at : at + BLOCK])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    """The long that has these 64 bits."""
    return value - (1 << 64) if value >> 63 else value


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a long of the same bits."""
    return row_udf(lambda texts: [signed(fingerprint(t, shingle)) for t in texts], "long")(text.cast("binary"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows of 64-bit words) to one."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int16)


class BKTree:
    """A BK-tree in arrays: for each node its fingerprint, and its children ordered by their distance to it.

    Fingerprints are numbers of 64 bits, or rows of several.
    """

    def __init__(self, values: np.ndarray):
        self.values = values = values.reshape(len(values), -1) if values.ndim == 1 else values
        n = len(values)
        # all nodes move down together: those at the same parent and distance follow the first of them, which stays
        self.children: list[dict[int, int]] = [{} for _ in range(n)]
        waiting = {0: np.arange(1, n)} if n else {}
        while waiting:
            below: dict[int, np.ndarray] = {}
            for parent, ids in waiting.items():
                d = distances(values[ids], values[parent])
                order = np.argsort(d, kind="stable")
                ids, d = ids[order], d[order]
                for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(d)) + 1):
                    if len(part):
                        head = int(ids[part[0]])
                        self.children[parent][int(d[part[0]])] = head
                        if len(part) > 1:
                            below[head] = ids[part[1:]]
            waiting = below

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of the query, node) at the radius or less. Queries go down the tree together."""
        queries = queries.reshape(len(queries), -1) if queries.ndim == 1 else queries
        found_q, found_n = [], []
        stack = [(0, np.arange(len(queries)))] if len(self.values) else []
        while stack:
            node, q = stack.pop()
            d = distances(queries[q], self.values[node])
            near = q[d <= radius]
            found_q.append(near)
            found_n.append(np.full(len(near), node))
            for edge, child in self.children[node].items():
                follow = q[np.abs(d - edge) <= radius]
                if len(follow):
                    stack.append((child, follow))
        return np.concatenate(found_q or [np.empty(0, int)]), np.concatenate(found_n or [np.empty(0, int)])


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (member, least of its part) that join what is linked within one shard."""
    v = np.array(values, np.int64).view(np.uint64)
    least = _parts(len(v), *BKTree(v).within(v, radius))
    order = v.view(np.int64)
    root = np.full(len(v), np.iinfo(np.int64).max)
    np.minimum.at(root, least, order)
    return [(int(a), int(b)) for a, b in zip(order, root[least]) if a != b]


def _parts(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least index of the part of each of n members, by links (x, y) that go both ways."""
    least = np.arange(n)
    while True:  # each takes the least index around, then that one's own
        new = least.copy()
        np.minimum.at(new, x, least[y])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, min(parts, len(bits))) if len(x)]


def _pattern(bits: list[int]) -> int:
    return signed(sum(1 << b for b in bits))


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b), a > b, that span what is linked by pairs of distinct fingerprints `fp` at the radius or less."""
    # a shard is named by the bits that its members share: which (mask) and how they are set (value)
    todo = prints.select(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("value"), "fp")
    levels: dict[int, list[int]] = {0: list(range(BITS))}
    out = []
    while levels:
        masks: dict[int, list[int]] = {}
        dealt = []
        for mask, free in levels.items():
            for block in _blocks(free, radius + 1):
                own = signed((mask | _pattern(block)) & (2**64 - 1))
                masks[own] = [b for b in free if b not in block]
                dealt.append((mask, own))
        rule = F.array(*[F.struct(F.lit(a).cast("long").alias("was"), F.lit(b).cast("long").alias("mask")) for a, b in dealt])
        keys = todo.select("fp", F.col("mask").alias("was"), F.explode(rule).alias("r")).where(F.col("r.was") == F.col("was"))
        keys = keys.select(F.col("r.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("r.mask")).alias("value"), "fp").distinct()
        sizes = checkpoint(keys.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
        small = keys.join(sizes.where(F.col("n") <= shard), ["mask", "value"]).groupBy("mask", "value").agg(F.collect_list("fp").alias("fps")).select("fps")
        out.append(map_batches(small, lambda cols: _split([e for fps in cols[0] for e in shard_links(fps, radius)], cols), "a array<long>, b array<long>", 64).select(F.explode(F.arrays_zip("a", "b")).alias("e")).select("e.a", "e.b"))
        large = sizes.where(F.col("n") > shard)
        hot = [r[0] for r in large.select("mask").distinct().collect()]  # at most as many as there are blocks
        levels = {m: masks[m] for m in hot if masks[m]}
        if levels:
            todo = checkpoint(keys.join(large.select("mask", "value"), ["mask", "value"]))
    return reduce(DataFrame.unionByName, out).distinct()


def _split(edges: list[tuple[int, int]], cols: list[list]) -> list[list]:
    """The links of a batch in one row, the other rows empty: a column needs as many rows as the batch has."""
    rest = [[] for _ in range(max(0, len(cols[0]) - 1))]
    return [[[e[0] for e in edges], *rest], [[e[1] for e in edges], *rest]] if cols[0] else [[], []]


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (doc_id, fp and more) with component_id, the smallest doc_id of its component, and root, its least fingerprint."""
    own = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(own.select("fp"), radius))
    nodes = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = checkpoint(nodes.join(ids, "root").select("fp", "root", "component_id"))
    return prints.join(named, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of df: doc_id, fp (long), component_id.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Null ids are never the smallest,
    unless a component has no other. Repeated rows are rows of one component. Empty table: no rows. Columns of df but
    for the two named ones are not read.
    """
    prints = checkpoint(df.select(F.col(f"`{id_col}`").alias("doc_id"), fingerprints(F.col(f"`{text_col}`"), shingle).alias("fp")))
    return classes(prints, radius).select("doc_id", "fp", "component_id")


# ---- near copies of a given similarity: SimHash, BK-trees, and a check of whole sets ------------------------------

#: Words of a shingle, and the similarity (Jaccard, of sets of shingles).
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8

#: Bits of a fingerprint of a set, the distance up to which two sets are compared whole, and that for sets of fewer than
#: FEW shingles. Bits of sets of similarity 0.8 differ with probability 0.15, of small sets with 0.19 at most, so these
#: distances are five deviations above the mean and more: a similar pair is farther apart with a probability below 1e-6.
NEAR_BITS, NEAR_RADIUS, FEW_RADIUS, FEW = 256, 72, 80, 32

#: Rows and shingles of a shard, texts that the order of shingles is taken from, and shingles that it names.
CROWD, SHINGLES, SAMPLE, COMMON = 1024, 1 << 18, 2000, 100_000

#: Far above the rounding of a product of the similarity, far below one shingle.
_EPS = 1e-6

#: Odd 64-bit factors for the places of a shingle, and for the four numbers of a fingerprint.
_PLACES = np.array([2 * xxhash.xxh64_intdigest(bytes([k]), SEED) + 1 & 2**64 - 1 for k in range(64)], np.uint64)
_PRINTS = _PLACES[: NEAR_BITS // BITS]


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers to well-mixed ones, one to one."""
    for factor in _PLACES[-2:]:
        h = (h ^ (h >> np.uint64(32))) * factor
    return h ^ (h >> np.uint64(32))


class ShingleSets:
    """Sets of 64-bit hashes of the shingles of texts; the hashes of words are remembered in bounded generations."""

    def __init__(self, shingle: int = NEAR_SHINGLE):
        self.shingle, self.words = shingle, Memory(lambda w: xxhash.xxh64_intdigest(w, SEED), 50_000)

    def of(self, text: bytes | None) -> np.ndarray:
        """The sorted hashes of the distinct shingles of a whole text, words as in fingerprint(); no word gives none. Fewer
        words than a shingle has are one shingle."""
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        width = min(self.shingle, len(h))
        n = len(h) - width + 1
        sums = np.full(n, width, np.uint64)
        for k in range(width):
            sums += h[k : k + n] * _PLACES[k]
        return np.unique(_mixed(sums))


def set_print(values: np.ndarray) -> np.ndarray:
    """The SimHash of a set as NEAR_BITS / 64 numbers: a bit is 1 if it is set in over half of the members' hashes."""
    counts = np.zeros(NEAR_BITS, np.int64)
    for at in range(0, len(values), 255):  # as many as a byte counts
        bits = np.unpackbits(_mixed(values[at : at + 255, None] + _PRINTS).view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(values), bitorder="little").view(np.int64)


def similar(x: np.ndarray, y: np.ndarray, similarity: float = NEAR_SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets is reached, exactly."""
    if min(len(x), len(y)) + _EPS < similarity * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared + _EPS >= similarity * (len(x) + len(y) - shared)


def prefix(values: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the order of (count, hash), so many that similar sets share one of them."""
    if len(common) and len(values):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        rank = np.where(common[at] == values, counts[at], 0)
        if rank.any():
            values = values[np.argsort(rank, kind="stable")]
    return values[: len(values) - int(np.ceil(similarity * len(values) - _EPS)) + 1]


def _common(texts: DataFrame, rows: int, shingle: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles that are common in a sample of the distinct texts (mark, text), sorted, their counts, and the texts that
    one of the sample stands for. Any list gives the same links: it only moves common shingles to the end of the order, so
    that few documents meet at them, and tells which keys are too crowded for one task."""
    every = max(1, rows // SAMPLE)
    some = texts.where(F.pmod("mark", F.lit(every)) == 0).groupBy("mark").agg(F.first("text").alias("text")).select("text")
    made: list[ShingleSets] = []

    def work(cols: list[list]) -> list[list]:
        made[:] = made or [ShingleSets(shingle)]
        return [[made[0].of(t).view(np.int64) for t in cols[0]]]

    words = map_batches(some, work, "v array<long>", held=made).select(F.explode("v").alias("v"))
    top = words.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "v").limit(COMMON).collect()
    v, n = np.array([r.v for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64)
    order = np.argsort(v)
    return v[order], n[order], every


def _described(texts: DataFrame, common: np.ndarray, counts: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """texts (doc_id, mark, text) as rows (doc_id, mark, id, n, fp, keys): the set's own hash, size, fingerprint and prefix."""
    made: list[ShingleSets] = []
    kind = texts.schema["doc_id"].dataType.simpleString()

    def work(cols: list[list]) -> list[list]:
        made[:] = made or [ShingleSets(shingle)]
        sets = [made[0].of(t) for t in cols[2]]
        ids = [signed(xxhash.xxh64_intdigest(v.tobytes(), SEED)) for v in sets]
        return [cols[0], cols[1], ids, list(map(len, sets)), [set_print(v) for v in sets], [prefix(v, common, counts, similarity).view(np.int64) for v in sets]]

    return map_batches(texts.select("doc_id", "mark", "text"), work, f"doc_id {kind}, mark long, id long, n long, fp array<long>, keys array<long>", held=made)


def _near(similarity: float) -> Column:
    """Whether two sets (n and fp, m and gp) may be similar, by their sizes and fingerprints."""
    far = reduce(lambda a, b: a + b, [F.bit_count(F.col("fp")[k].bitwiseXOR(F.col("gp")[k])) for k in range(NEAR_BITS // BITS)])
    return (F.least("n", "m") + _EPS >= similarity * F.greatest("n", "m")) & (far <= F.when(F.least("n", "m") < FEW, FEW_RADIUS).otherwise(NEAR_RADIUS))


def _tree_pairs(roots: list, n: list, fp: list, part: list, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one part, or between two, that may be similar and are not linked yet. Each pair of a part is
    found both ways."""
    r, m, g = (np.array(x, np.int64) for x in (roots, n, part))
    prints = np.array(fp, np.int64).view(np.uint64)
    one, other = np.flatnonzero(g == g.min()), np.flatnonzero(g == g.max())
    q, node = BKTree(prints[other]).within(prints[one], max(NEAR_RADIUS, FEW_RADIUS))
    x, y = one[q], other[node]
    fits = (r[x] != r[y]) & (np.minimum(m[x], m[y]) + _EPS >= similarity * np.maximum(m[x], m[y]))
    x, y = x[fits], y[fits]
    far = np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1, dtype=np.int64)
    fits = far <= np.where(np.minimum(m[x], m[y]) < FEW, FEW_RADIUS, NEAR_RADIUS)
    return x[fits], y[fits]


def _tree_links(ids: list, roots: list, n: list, fp: list, part: list, similarity: float) -> tuple[list, list]:
    """Links (member, another) that span what those pairs join."""
    x, y = _tree_pairs(roots, n, fp, part, similarity)
    least = _parts(len(ids), np.concatenate([x, y]), np.concatenate([y, x]))
    moved = np.flatnonzero(least != np.arange(len(ids)))
    return [ids[k] for k in moved], [ids[k] for k in least[moved]]


def _similar_links(ids: list, roots: list, n: list, fp: list, part: list, texts: list, sets: ShingleSets, similarity: float) -> tuple[list, list]:
    """Links of similar sets that span what those pairs join that are similar by their whole sets."""
    x, y = _tree_pairs(roots, n, fp, part, similarity)
    if len(set(part)) == 1:
        x, y = x[x < y], y[x < y]
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    label = np.unique(np.array(roots, np.int64), return_inverse=True)[1]
    made = {int(k): sets.of(texts[k]) for k in np.unique(np.concatenate([x, y]))}
    out: tuple[list, list] = ([], [])
    for k, mates in zip(x[np.flatnonzero(np.diff(x, prepend=-1))].tolist(), np.split(y, np.flatnonzero(np.diff(x)) + 1)):
        own = made[k]
        mates = mates[label[mates] != label[k]]
        for at in range(0, len(mates), 256):
            some = [made[m] for m in mates[at : at + 256].tolist()]
            lengths = np.array(list(map(len, some)))
            flat = np.concatenate(some)
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            shared = np.add.reduceat(hit, np.cumsum(lengths) - lengths, dtype=np.int64)
            for m in mates[at : at + 256][shared + _EPS >= similarity * (lengths + len(own) - shared)].tolist():
                if label[m] != label[k]:
                    label[label == label[m]] = label[k]
                    out[0].append(max(ids[k], ids[m]))
                    out[1].append(min(ids[k], ids[m]))
    return out


def _texts_of(ids: DataFrame, info: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, text) for the nodes (id), one text for each set; other texts are not shuffled where these are few."""
    wanted = checkpoint(ids.distinct().join(info.select("id", F.col("mark").alias("m")), "id"))
    found = join_small(texts.select("mark", "text"), wanted, F.col("mark") == F.col("m"), wanted.count(), "inner")
    return checkpoint(found.groupBy("id").agg(F.first("text").alias("text")))


def _verified(pairs: DataFrame, info: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose whole sets are similar."""
    pairs = checkpoint(pairs)
    found = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), info, texts)
    both = pairs.join(found.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(found.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    made: list[ShingleSets] = []
    last: list = []

    def work(cols: list[list]) -> list[list]:
        made[:] = made or [ShingleSets(shingle)]
        out: list[list] = [[], []]
        for a, b, ta, tb in zip(*cols):
            if last[:1] != [b]:  # many members meet the same one
                last[:] = b, made[0].of(tb)
            if similar(made[0].of(ta), last[1], similarity):
                out[0].append(a)
                out[1].append(b)
        return out

    return checkpoint(map_batches(both.select("a", "b", "ta", "tb"), work, "a long, b long", 64, made))


def _met(members: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Array columns of each two parts of a key that meet. members has key, root, n and the columns.

    A part has about CROWD rows and SHINGLES shingles. Classes of a part and more have parts of their own, which do not meet
    each other, as their members are linked; the others share parts, which also meet themselves.
    """
    weight = F.greatest(F.count(F.lit(1)) / CROWD, F.sum("n") / SHINGLES)
    by_root = members.groupBy(key, "root").agg(weight.alias("w"))
    by_root = by_root.select(F.col(key).alias("k"), F.col("root").alias("r"), "w", F.when(F.col("w") >= 1, F.col("root")).alias("own"))
    groups = by_root.groupBy(F.col("k").alias("gk"), F.col("own").alias("gown")).agg(F.ceil(F.sum("w")).alias("of"))
    order = Window.partitionBy("gk").orderBy("gown")  # as many rows as a key has large classes
    groups = groups.withColumn("at", F.sum("of").over(order) - F.col("of")).withColumn("all", F.sum("of").over(Window.partitionBy("gk")))
    dealt = by_root.join(groups, (F.col("gk") == F.col("k")) & F.col("gown").eqNullSafe(F.col("own"))).select("k", "r", "own", "of", "at", "all")
    rows = members.join(dealt, (F.col(key) == F.col("k")) & (F.col("root") == F.col("r"))).withColumn("part", F.col("at") + F.pmod(F.xxhash64("id"), F.col("of")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda q: F.col("own").isNull() | (q < F.col("at")) | (q >= F.col("at") + F.col("of")))
    rows = rows.withColumn("q", F.explode(others)).withColumn("lo", F.least("part", "q")).withColumn("hi", F.greatest("part", "q"))
    blocks = rows.groupBy(key, "lo", "hi").agg(F.collect_list(F.struct(*columns, "part")).alias("m")).where(F.size("m") > 1)
    return blocks.select(*[F.col("m")[c].alias(c) for c in (*columns, "part")])


def _links(blocks: DataFrame, work: Callable[..., tuple[list, list]], held: list | None = None) -> DataFrame:
    """The links that work finds in each block, as rows (a, b)."""
    found = map_batches(blocks, lambda cols: list(map(list, zip(*[work(*row) for row in zip(*cols)]))) or [[], []], "a array<long>, b array<long>", 1, held)
    return found.select(F.explode(F.arrays_zip("a", "b")).alias("e")).select("e.a", "e.b")


def near_classes(texts: DataFrame, rows: int, shingle: int = NEAR_SHINGLE, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """doc_id, mark, root for each row of texts (doc_id, mark: a hash of the text, text): root is equal for near copies.

    1. Equal sets are one node, with its size and a SimHash fingerprint.
    2. Similar sets share one of the first shingles of each, in an order that all sets have in common (prefix filter), so
       nodes are dealt into shards by these: no similar pair misses each other.
    3. Each node meets the least and the greatest node of its shard. After that only pairs that are not linked yet are of
       use, so a group of near copies is not expanded into pairs.
    4. They are found by the BK-trees of a key's shards of about CROWD rows, each shard with each other. What such pairs
       join is a cluster. Its texts meet, shard by shard, and are compared there, so no list of pairs is ever made.
    5. Every pair near enough by its fingerprints is compared by whole sets; components of these links are the classes.
    """
    common, counts, every = _common(texts, rows, shingle)
    prints = checkpoint(_described(texts, common, counts, shingle, similarity))
    info = checkpoint(prints.groupBy("id").agg(F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    size = info.select("id", "n", "fp")
    # equal sets have equal keys: each key of a node once
    keys = prints.groupBy("id").agg(F.first("keys").alias("keys")).select("id", F.explode("keys").alias("key"))
    # a key that many share: its ends by partial sums, and no row of it is moved; of others all rows meet in a task
    crowded = [(int(v),) for v, n in zip(common.view(np.int64), counts) if n * every > CROWD]
    shard = Window.partitionBy("key")
    if crowded:
        crowded = F.broadcast(texts.sparkSession.createDataFrame(crowded, "key long"))  # COMMON rows at most
        hot = keys.join(crowded, "key", "left_semi")
        ends = hot.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        hot, keys = hot.join(F.broadcast(ends), "key"), keys.join(crowded, "key", "left_anti")
    shared = keys.select("key", "id").withColumn("lo", F.min("id").over(shard)).withColumn("hi", F.max("id").over(shard))
    shared = checkpoint((shared.unionByName(hot) if crowded else shared).where(F.col("lo") != F.col("hi")))
    tidy(texts.sparkSession)
    linked = None
    for end in ("lo", "hi"):
        pairs = shared.select(F.col("id").alias("a"), F.col(end).alias("b"))
        pairs = pairs.where("a <> b").distinct()
        if linked is not None:
            pairs = _unlinked(pairs, roots)
        pairs = pairs.join(size.withColumnRenamed("id", "a"), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("fp").alias("gp")), "b")
        found = _verified(pairs.where(_near(similarity)).select("a", "b"), info, texts, shingle, similarity)
        linked = found if linked is None else linked.unionByName(found)
        roots = checkpoint(components(linked)).withColumnRenamed("node", "id")
    own = shared.select("key", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = own.groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("h"), F.count(F.lit(1)).alias("c")).where("l <> h and c > 2")
    own = checkpoint(own.join(mixed.select("key"), "key").join(size, "id"))
    tried = _links(_met(own, "key", ["id", "root", "n", "fp"]), lambda *row: _tree_links(*row, similarity))
    clusters = checkpoint(components(tried)).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    members = clusters.join(size, "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    members = members.join(_texts_of(clusters.select("id"), info, texts), "id")
    made: list[ShingleSets] = []

    def work(*row: list) -> tuple[list, list]:
        made[:] = made or [ShingleSets(shingle)]
        return _similar_links(*[row[k] for k in (0, 1, 2, 3, 5, 4)], made[0], similarity)

    linked = linked.unionByName(checkpoint(_links(_met(members, "cluster", ["id", "root", "n", "fp", "text"]), work, made)))
    roots = checkpoint(components(linked)).withColumnRenamed("node", "id")
    return prints.select("doc_id", "mark", "id").join(roots, "id", "left").select("doc_id", "mark", F.coalesce("root", "id").alias("root"))


def _unlinked(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes."""
    at = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias("r" + c))
    return pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """df's rows, all columns, one of each group of near copies: that of the smallest id (null ids last), then of the least
    text hash.

    Near copies are linked by pairs whose sets of five-word shingles have the similarity or more, exactly; groups are what
    such links join. Null, empty and blank texts are one group. Of repeated rows one stays. Empty table: no rows. Any
    column names are safe.
    """
    text = F.col(f"`{text_col}`").cast("string")
    mark = F.xxhash64(F.coalesce(text, F.lit("")))
    texts = df.select(F.col(f"`{id_col}`").alias("doc_id"), mark.alias("mark"), text.cast("binary").alias("text"))
    every = checkpoint(near_classes(texts, df.count(), shingle, similarity))
    first = every.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("k"), F.count(F.lit(1)).alias("c")).where("c > 1")
    groups = every.join(first, "root").select("doc_id", "mark", F.col("k.doc_id").alias("kd"), F.col("k.mark").alias("km"))
    stays = F.col("doc_id").eqNullSafe(F.col("kd")) & (F.col("mark") == F.col("km"))
    gone = checkpoint(groups.where(~stays).select(F.col("doc_id").alias("gd"), F.col("mark").alias("gm")).distinct())
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), mark.alias("mark"))
    out = join_small(rows, gone, F.col("doc_id").eqNullSafe(F.col("gd")) & (F.col("mark") == F.col("gm")), gone.count(), "left_anti")
    # only where an id has the same text in several rows is there more to drop
    repeated = groups.where(stays).groupBy("doc_id", "mark").count().where("count > 1")
    return (out if repeated.isEmpty() else out.dropDuplicates(["doc_id", "mark"])).select("row.*")
