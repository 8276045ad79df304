"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.session import cut


def components(edges: DataFrame, most_rounds: int = 60, hot_from: int = 1_000_000) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``: the smallest node of its component.

    Alternating large-star and small-star steps over the edge table: each round is two grouped minima, edges shrink towards stars and
    hot nodes are aggregated, never collected. Rounds grow with the logarithm of the longest path; ``most_rounds`` only guards against a fault.
    From ``hot_from`` edges on, nodes with more than a thousandth of all edges (so at most 2,000) get their minimum by a broadcast, so that no task holds a hub.
    Null ends and loops are ignored; an empty table gives an empty table.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    now, n = _kept(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(most_rounds):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        now, n = _kept(_contracted(now, n // 1000 if n >= hot_from else None))
    raise RuntimeError("components did not settle")


def _kept(edges: DataFrame) -> tuple[DataFrame, int]:
    """Distinct edges as a written table, and their number."""
    seen = Observation()
    return cut(edges.distinct().observe(seen, F.count("*").alias("n"))), seen.get["n"]


def _settled(now: DataFrame) -> bool:
    """Whether every node points to one root and no root points anywhere."""
    ends = now.select(F.col("a").alias("node"), F.lit(1).alias("n"), F.lit(0).alias("r")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("n"), F.lit(1).alias("r")))
    return ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("r").alias("r")).where("n > 1 or (n = 1 and r = 1)").isEmpty()


def _with_least(edges: DataFrame, hot: int | None) -> DataFrame:
    """``a, b, m``: every edge with the least of ``a`` and its partners; nodes with more than ``hot`` partners by a broadcast."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    if hot is None:
        return edges.join(least.drop("n"), "a")
    hubs = cut(least.where(F.col("n") > hot).drop("n"))
    return edges.join(F.broadcast(hubs), "a", "left_anti").join(least.drop("n"), "a").unionByName(edges.join(F.broadcast(hubs), "a"))


def _contracted(now: DataFrame, hot: int | None) -> DataFrame:
    both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    down = _with_least(both, hot).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    small = _with_least(down, hot)
    return small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b")
