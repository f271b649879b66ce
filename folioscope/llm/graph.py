"""Connected components of an edge table, by contraction: no collect, no unbounded group, lineage cut by tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.store import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the edges (a, b): root is the smallest node that can be reached.

    Each round draws a new order of the nodes (a hash), hooks every node to the first of its neighbours and itself, follows
    that once more, and contracts the edges. As the order is random, a share of the nodes vanishes in each round whatever
    the graph, also along chains, so rounds grow with the logarithm of the nodes. Minima are aggregated before the shuffle;
    tables of a round go once the next one has them. Without an edge the result is empty.
    """
    edges = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "roots")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        one = written(both.groupBy("a").agg(F.min(place("b")).alias("m")).select(F.col("a").alias("x"), F.least(place("a"), F.col("m"))["n"].alias("y")), "up")
        next_up = one.select(F.col("x").alias("y"), F.col("y").alias("z"))
        up = written(one.join(next_up, "y", "left").select("x", F.coalesce("z", "y").alias("y")), "up")
        left, right = up.toDF("a", "p"), up.toDF("b", "q")
        new = edges.join(left, "a").join(right, "b").where("p != q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
        new_roots = written(roots.join(up.toDF("root", "r"), "root", "left").select("node", F.coalesce("r", "root").alias("root")), "roots")
        new_edges = written(new.distinct(), "edges")
        dropped(one, up, roots, edges)
        roots, edges = new_roots, new_edges
    least = written(roots.groupBy("root").agg(F.min("node").alias("least")), "least")
    out = written(roots.join(least, "root").select("node", F.col("least").alias("root")), "roots")
    dropped(edges, roots, least)
    return out
