"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Staging, join_heavy

MAX_ROUNDS = 60


def _sum_of(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r.n, r.x


def connected_components(edges: DataFrame, scope: Staging) -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its smallest node.

    ``edges`` has a and b (bigint); direction, repeats and loops don't matter. Every round is
    a few shuffles of pairs of ids, written to the shared folder; nothing meets on the driver.
    """
    now = scope.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", slim=True)
    state = _sum_of(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        # Nodes with many neighbours join by broadcast: a component's centre may have a third of all edges.
        least = both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("d")).select("x", F.least("x", "m").alias("m"), "d")
        # Large star: every larger neighbour moves to the smallest node around x.
        large = scope.write(join_heavy(both.where("y > x"), least, ["x"], "d", 2 * state[0]).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large", slim=True)
        # Small star: the smaller neighbours of u, and u, move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = join_heavy(large, low, ["u"], "d", state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = scope.write(small, "edges", slim=True)
        scope.drop(large)
        scope.drop(now)
        now, before = after, state
        state = _sum_of(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
