"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterline.llm.common import written


def _settled(edges: DataFrame) -> bool:
    """Are these stars: one edge at most from every node, and none from a node that others lead to?"""
    up = edges.where("a != b")
    ends = up.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(up.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up > 0 and root > 0)").head(1)


#: Up to so many edges, the minimum of every node is small enough to broadcast (16 bytes each, two nodes an edge).
BROADCAST_EDGES = 1 << 17


def _with_least(rows: DataFrame, least: DataFrame, most: int, few: bool) -> DataFrame:
    """rows (a, b) with m of `least` (a, m, n), which is broadcast if there are few edges.

    Else a node with more than `most` rows is looked up in a broadcast table, so that its rows stay
    where they are.  Such nodes are few: `most` is a part of a fair partition's rows.
    """
    if few:
        return rows.join(F.broadcast(least.select("a", "m")), "a")
    hot = F.broadcast(least.where(F.col("n") > most).select(F.col("a").alias("hot"), F.col("m").alias("hot_m")))
    split = rows.join(hot, rows["a"] == hot["hot"], "left")
    cold = split.where("hot is null").select("a", "b").join(least.select("a", "m"), "a")
    return split.where("hot is not null").select("a", "b", F.col("hot_m").alias("m")).unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, not null).  Returns node, component: the least node it is linked to.

    edges is read several times, so it should be a stored table.  Every round is two joins of the
    edges with a minimum for each node, which is combined before it is shuffled; repeated edges,
    which change no minimum, go once a round, when it is written.  Beyond BROADCAST_EDGES edges, nodes
    with over an eighth of a partition's edges or somewhat more, of which there are at most eight a
    partition, are joined by broadcast, so the label of a large class gathers nowhere.  Rounds are
    written to the shared folder.

    Defined cases: a pair a = a keeps a node without other edges; repeated pairs count once; an
    empty table gives an empty result; further columns are ignored.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    n = now.count()
    # A power of two, so that rounds share their generated code.
    most = 1 << max(4, (2 * n // (8 * parts)).bit_length())
    few = n <= BROADCAST_EDGES
    while True:
        # Large star: every greater neighbour of a node goes to the node's least neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, least, most, few).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(now.where("a = b"))
        # Small star: a node and its lesser neighbours go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        ends = F.explode(F.array("a", "b")).alias("a")
        now = written(_with_least(large, least, most, few).select(ends, F.col("m").alias("b")).distinct(), "edges")
        if _settled(now):
            break
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
