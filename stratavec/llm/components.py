"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.session import discard, stored


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, not null). A row per node that has an edge to another: node, component (the smallest node reachable).

    Each step links a node's neighbours to the smallest of them, which keeps components and shrinks
    every tree; a node's neighbours are never gathered, only their minimum. The minima are stored, so
    that the edges of a node with very many can be split when they are joined. Ends when a round
    changes nothing.
    """
    rows = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = None
    while True:
        before = rows
        both = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(_mins(both), "mins")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stored(large, "large-star")
        lower = stored(_mins(large), "mins")
        small = large.join(lower, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        rows = stored(small, "small-star")
        discard(before, low, lower, large)  # the round's result stands on its own
        now = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            return rows.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(rows.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
