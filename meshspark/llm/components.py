"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star pass; edges (a, b) always point from the larger to the smaller id."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    kept = edges.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).where("b = m").select("a", "b")
    edges = large.union(kept).distinct()
    lower = edges.groupBy("a").agg(F.min("b").alias("m"))
    small = edges.join(lower, "a")
    return small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(lower.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs, any direction, repeats and loops allowed -> (node, root), root the smallest id of the component.

    Every node that occurs in an edge between different ids gets a row. Each round is written to the shared
    folder, so a lost executor costs one round. The number of rounds grows with the logarithm of the longest path.
    """
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        fresh = store(_round(now), "edges")
        row = fresh.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now, same = fresh, tuple(row) == mark
        mark = tuple(row)
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()
