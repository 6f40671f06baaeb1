"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakespark.llm.common import CHAIN_ROWS, discard, join_small, settle

#: Far above the logarithm of any graph's size; reached only if the edges kept changing.
MOST_ROUNDS = 60


def _lowest(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    """(u, m): the least of u and its neighbours."""
    used.append(settle(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "lowest"))
    return used[-1]


def _large_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return join_small(both, _lowest(both, used), ["u"], most=CHAIN_ROWS).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = _lowest(down, used)
    moved = join_small(down, lowest, ["u"], most=CHAIN_ROWS).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v")))


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge to another; the root is a component's least node.

    Loops and repeated edges do no harm. Nodes are longs. Minima are
    aggregated before they are shuffled, so a node with very many edges is
    dealt over the tasks that hold them.
    """
    now = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).alias("mark")
    before = now.agg(mark).first()["mark"]
    for _ in range(MOST_ROUNDS):
        used = [now]
        now = settle(_small_star(_large_star(now, used), used).where("u <> v").distinct(), "edges")
        discard(*used)
        after = now.agg(mark).first()["mark"]
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
    raise RuntimeError("the components did not settle")
