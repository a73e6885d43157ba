"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows of each class that a sample has at most, and the characters that those of a class have together at most
#: where a model is fitted to whole texts on the driver.
SAMPLE, CHARS = 2000, 20_000_000

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for every fifth document, by the CRC-32 of its id as text; null ids are as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, extra: list[str] = [], size: int = SAMPLE, chars: int | None = None) -> DataFrame:  # noqa: B006
    """Rows (label, text, extra columns) of at most `size` labelled documents of each class, none of them held out.

    The ids are chosen by a hash among those that have a document, so that reruns agree, before a text is read. A repeated
    id counts once, by its greatest label and its least text. With `chars`, a class ends before the row, in that order, at
    which its texts have more characters together; no text is cut, and none is left out for its own length but one that is
    longer than `chars`. All this only bounds what fits the model; every text is scored whole.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = ids.join(docs.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = [ids.where(F.col("label") == c).orderBy(order, "doc_id").limit(size) for c in (0, 1)]
    picked = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")  # 2 * size ids at most
    one = picked.groupBy("doc_id", "label").agg(F.min(F.struct("text", *extra)).alias("d")).select("doc_id", "label", "d.*")
    if chars is not None:
        length = F.coalesce(F.length("text"), F.lit(0))
        one = one.where(length <= chars).withColumn("upto", F.sum(length).over(Window.partitionBy("label").orderBy(order, "doc_id"))).where(F.col("upto") <= chars).drop("upto")
    return one.orderBy("label", order, "doc_id").drop("doc_id")
