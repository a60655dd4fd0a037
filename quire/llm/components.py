"""Connected components by alternating large-star and small-star steps, every step a grouping and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import stored


def _large(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours with the smallest of its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours with the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def star_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root, the smallest node of its component, for all nodes of ``edges`` (long columns a, b).

    Ends when a round changes nothing (number and a checksum of the links are compared); raises after ``rounds``.
    """
    seen = None
    for r in range(rounds):
        edges = stored(_small(_large(edges)), f"stars{r}")
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
