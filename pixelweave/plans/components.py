"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import checkpoint, tidy


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b); a root is its component's least node. Ends when the links stay."""
    links, before = checkpoint(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hub = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("hub"))
        up = both.where(F.col("b") > F.col("a")).join(hub, "a").select(F.col("b").alias("a"), F.col("hub").alias("b")).distinct()
        hub = up.groupBy("a").agg(F.min("b").alias("hub"))
        down = up.join(hub, "a").select(F.col("b").alias("a"), F.col("hub").alias("b")).unionByName(hub.select("a", F.col("hub").alias("b")))
        links = checkpoint(down.where(F.col("a") != F.col("b")).distinct())
        tidy(links.sparkSession)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = now
