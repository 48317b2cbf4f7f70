"""Connected components of large graphs, by alternating stars.

Every round points each node's larger neighbours, then its smaller ones, to the
smallest node it knows; paths shrink by a constant factor a round.  Rounds are
written to the shared folder, so a lost executor costs no earlier round.  Only
smallest neighbours are gathered, never a node's whole neighbourhood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rounds

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of one ordered type to (node, component): the smallest
    node reachable.  Nodes without a link to another are left out."""
    rounds = Rounds(edges.sparkSession, "edges")
    held = rounds.hold(_ordered(edges.select("a", "b")))
    mark = _mark(held)
    for _ in range(ROUNDS):
        if not mark[0]:
            break
        held = rounds.hold(_small_star(_large_star(held)))
        now = _mark(held)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    roots = held.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", "component"))


def _ordered(edges: DataFrame) -> DataFrame:
    """Each link once, the larger node in ``a``."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.where("v > u").join(least, "u")
    return out.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).distinct()
