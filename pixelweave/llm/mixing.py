"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source gets a target of words. A document is expected min(CAP, level * measure) times in the mix, where its measure
is the number of binary digits of its size in words (longer documents are worth more, by the logarithm of their length),
and the source's level is such that the expected words are the target. The whole part of that number is allocated as
certain copies; what is left of it is the inclusion probability p of one more copy, which differs by document.

These are drawn by Pareto order sampling: documents are ranked by random odds divided by inclusion odds,
u / (1 - u) : p / (1 - p), and taken in that order as long as they fit into what the certain copies leave of the target.
The sample's size is fixed in words, not in documents, since the targets are words; the expected words of the draw are
just what is left, so a document is drawn with about its p. What the first document that does not fit leaves open is filled
by at most PICKS documents, the nearest in size each, and only where that comes nearer to the target.

All decisions are a function of a row and its source's small state (level, the last rank taken, the picks). No row is
looked up by its id, so that repeated ids and rows do no harm, and the texts are not shuffled. Ranks are summed by ranges
of ranges: per source at most FINE sums of partial aggregation, whose coarse sums tell which FINE / COARSE of them, and
these which one range, of about a FINE-th of the source's documents, has to be walked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, join_small

WEIGHTS, CAP, PICKS = (5, 2, 1), 3, 3

#: Ranges of ranks of a source, and ranges of such ranges.
FINE, COARSE = 1 << 16, 1 << 8


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Targets from one row per source (src, source_size): weights repeat by code point of the source, null last; a target
    stops at cap times the source's size, and the excess is shared again by weight until none is above.

    Sharing again ends where level * weight is below the cap for all sources but those with the least cap per weight;
    the level is found over the sources in that order. There is one row per source here, so one window over them holds.
    """
    by_name = Window.orderBy(F.col("src").isNull(), F.col("src"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    df = sources.withColumn("weight", w).withColumn("most", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("src").isNull(), F.col("src"))
    upto, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = (
        df.withColumn("capped", F.coalesce(F.sum("most").over(upto), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("weight_left"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(all_rows))
    )
    return df.select("src", "source_size", F.coalesce(F.least(F.col("most"), F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"))


def rank_key(row_id: Column, text: Column, seed: str) -> Column:
    """A uniform number in (0, 1) from 52 bits of an MD5 digest of id and text: the same on every run and machine."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(row_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


class Plan:
    """The small state by which rows are taken: one row per source."""

    def __init__(self, states: DataFrame, rows: int):
        self.states, self.rows = states, rows


def measure(size: Column) -> Column:
    """Binary digits of a size."""
    return F.length(F.bin(size)).cast("double")


def _expected() -> Column:
    """How often a document is expected in the mix, by its size and its source's level; no level: as often as it may."""
    return F.coalesce(F.least(F.lit(float(CAP)), F.col("level") * measure(F.col("size"))), F.lit(float(CAP)))


def _copies(expected: Column) -> Column:
    """Certain whole copies."""
    return F.floor(expected + 1e-9)


def _with_rank(rows: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """rows with their source's state, copies, p and rank: random odds by inclusion odds, null where there is no draw."""
    row = join_small(rows, state.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s")), n).withColumn("copies", _copies(_expected()))
    row = row.withColumn("p", F.when(F.col("size") > 0, F.greatest(_expected() - F.col("copies"), F.lit(0.0))).otherwise(F.lit(0.0)))
    return row.withColumn("rank", F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))))


def levels(classes: DataFrame, sums: DataFrame) -> DataFrame:
    """sums (src, source_size, target) with level and gap, from classes (src, size: the least of its measure, words).

    The documents of the largest measures reach CAP first. In the order of falling measures, the level is that of the first
    class that stays below CAP if all before it have reached it; a source has a class for each number of binary digits.
    """
    same = F.col("src").eqNullSafe(F.col("s"))
    df = classes.withColumnRenamed("src", "s").join(sums, same).withColumn("m", measure(F.col("size")))
    by = Window.partitionBy("src").orderBy(F.col("m").desc())
    upto, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    capped, rest = F.coalesce(F.sum("words").over(upto), F.lit(0)), F.sum((F.col("words") * F.col("m")).cast("long")).over(after)
    df = df.withColumn("level", F.when(rest > 0, (F.col("target") - float(CAP) * capped) / rest))
    found = df.groupBy("src").agg(F.max(F.when(F.col("level") * F.col("m") <= float(CAP), F.col("level"))).alias("level")).withColumnRenamed("src", "s")
    out = sums.join(found, same, "left").drop("s")
    # the words of the certain copies of a class are known from its sum
    sure = classes.withColumnRenamed("src", "s").join(out, same).groupBy("src").agg(F.sum((F.col("words") * _copies(_expected())).cast("long")).alias("sure")).withColumnRenamed("src", "s")
    return out.join(sure, same, "left").drop("s").withColumn("gap", F.greatest(F.col("target") - F.coalesce("sure", F.lit(0)), F.lit(0.0))).drop("sure")


def measured(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *keep: Column) -> DataFrame:
    """src, size and the uniform number u of each row, beside the columns to keep."""
    text = F.col(f"`{text_col}`")
    return df.select(*keep, F.col(f"`{source_col}`").cast("string").alias("src"), word_count(text).alias("size"), rank_key(F.col(f"`{id_col}`"), text, seed).alias("u"))


def _taken(picks: int) -> Column:
    """True for rows that are drawn, by their rank or as one of the picks so far."""
    out = F.col("rank") <= F.col("cut")
    for k in range(picks):
        out = out | ((F.col("size") == F.col(f"size{k}")) & (F.col("rank") == F.col(f"rank{k}")))
    return F.coalesce(out, F.lit(False))


def plan(rows: DataFrame, picks: int = PICKS) -> Plan:
    """Decide from src, size and u (checkpointed) how often rows are taken. An empty table gives an empty plan."""
    classes = checkpoint(rows.groupBy("src", measure(F.col("size")).alias("m")).agg(F.min("size").alias("size"), F.sum("size").alias("words")).drop("m"))
    sums = checkpoint(targets(classes.groupBy("src").agg(F.sum("words").alias("source_size"))))
    n = sums.count()
    state = checkpoint(levels(classes, sums))
    same = F.col("src").eqNullSafe(F.col("s"))
    drawn = _with_rank(rows.select("src", "size", "u"), state, n).where(F.col("rank").isNotNull()).select("src", "size", "rank", "gap")
    drawn = drawn.withColumn("fine", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * FINE), F.lit(FINE - 1)))
    fine = checkpoint(drawn.groupBy("src", "fine", "gap").agg(F.sum("size").alias("words"), F.max("rank").alias("last")).withColumn("coarse", F.floor(F.col("fine") / (FINE // COARSE))))
    # sums of ranges of ranges, then of the ranges in that which crosses the gap, then of the ranks in the one which does
    whole, edge = _crossing(fine.groupBy("src", "coarse", "gap").agg(F.sum("words").alias("words"), F.max("last").alias("last")).withColumn("before", F.lit(0)), "coarse")
    cuts, inner = whole, join_small(fine, edge.withColumnRenamed("at", "c"), same & (F.col("coarse") == F.col("c")), n, "inner").drop("s", "c")
    whole, edge = _crossing(inner, "fine")
    cuts, inner = cuts.unionByName(whole), join_small(drawn, edge.withColumnRenamed("at", "f"), same & (F.col("fine") == F.col("f")), n, "inner").drop("s", "f")
    whole, _ = _crossing(inner.groupBy("src", "rank", "gap", "before").agg(F.sum("size").alias("words")).withColumn("last", F.col("rank")), "rank")
    cuts = cuts.unionByName(whole).groupBy("src").agg(F.max("last").alias("cut"), F.max("upto").alias("got")).withColumnRenamed("src", "s")
    state = state.join(cuts, same, "left").drop("s").fillna({"cut": -1.0, "got": 0})
    state = checkpoint(state.withColumn("gap", F.col("gap") - F.col("got")).drop("got"))
    for k in range(picks):
        left = _with_rank(rows.select("src", "size", "u"), state, n).where(F.col("rank").isNotNull() & ~_taken(k) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
        near = left.groupBy("src").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "rank", "size")).alias("pick")).select(F.col("src").alias("s"), F.col("pick.size").alias(f"size{k}"), F.col("pick.rank").alias(f"rank{k}"))
        near = checkpoint(near)
        # equal rows are taken alike, so all of them must come nearer to the target
        alike = join_small(left.drop("s"), near, same & (F.col("size") == F.col(f"size{k}")) & (F.col("rank") == F.col(f"rank{k}")), n, "inner")
        alike = alike.groupBy(F.col("src").alias("s"), "gap", f"size{k}", f"rank{k}").agg(F.sum("size").alias("more")).where(F.abs(F.col("gap") - F.col("more")) < F.col("gap")).drop("gap")
        state = checkpoint(state.join(alike, same, "left").drop("s").withColumn("gap", F.col("gap") - F.coalesce("more", F.lit(0))).drop("more"))
    return Plan(state.drop("gap"), n)


def _crossing(sums: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """From sums (src, at, gap, before, words, last), in the order of `at`: (src, last, upto) of those that fit as a whole
    into the gap, and (s, at, before) of the one that crosses it, with the sum before it."""
    run = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("src").orderBy(at)) + F.col("before"))
    fit = F.col("upto") <= F.col("gap")
    edge = run.where(~fit & (F.col("upto") - F.col("words") <= F.col("gap")))
    return run.where(fit).select("src", "last", "upto"), edge.select(F.col("src").alias("s"), F.col(at).alias("at"), (F.col("upto") - F.col("words")).alias("before"))


def decide(rows: DataFrame, to: Plan) -> DataFrame:
    """rows (src, size, u and more) with source_size, target, p (of one more copy than the certain ones) and times; the
    plan's states are broadcast where they are small."""
    row = _with_rank(rows, to.states, to.rows)
    times = (F.col("copies") + F.when(_taken(PICKS), 1).otherwise(0)).cast("int")
    return row.select(*[F.col(c) for c in rows.columns], "source_size", "target", "p", times.alias("times"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """One row per row of df: doc_id, source, size, source_size, target, p and times, how often the mix takes it.

    Null text: size 0, taken as often as it is certain. Null source: a source of its own, last. Equal rows (of the same id
    and text) are all taken alike, and only if all of them fit or come nearer to the target. Empty table: no rows. Columns of df but for the three named ones are not read.
    """
    rows = checkpoint(measured(df, id_col, text_col, source_col, seed, F.col(f"`{id_col}`").alias("doc_id")))
    return decide(rows, plan(rows)).select("doc_id", F.col("src").alias("source"), "size", "source_size", "target", "p", "times")


def repeat(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """df's rows, all columns, each as often as the mix takes it; nulls, ties and empty tables as in mix()."""
    rows = checkpoint(measured(df, id_col, text_col, source_col, seed))
    whole = measured(df, id_col, text_col, source_col, seed, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return decide(whole, plan(rows)).where(F.col("times") > 0).select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")
