"""Connected components of an edge table by alternating large and small stars.

Both star steps (Kiveris et al., Connected Components in MapReduce and Beyond, 2014) hang every
node's neighbours on their smallest one. Minima are pre-aggregated before the shuffle and the join
that brings them back can be split by adaptive execution, so a hub is no bottleneck. Every round is
written to the shared folder: its lineage ends there and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.storage import cut, drop


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    # a large star's edges run from the larger node to the smaller one already
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node with an edge.

    Ids must be orderable and non-null; edges with a null end are left out, loops yield their node
    only if it has another edge. Direction, order and repetition of edges do not matter.
    """
    pairs = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where(f"`{src}` is not null and `{dst}` is not null and a <> b").distinct()
    now = cut(pairs, "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        after = cut(_small(_large(now)), "edges")
        drop(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
