"""Connected components over a table of edges, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaforge.session import cut, release


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Connect the larger (or the smaller) neighbours of each node with the least of them and itself."""
    least = cut(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")  # stored: Spark may split a hub's pairs in the join
    joined = pairs.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    done = cut(out.filter("u > v").distinct(), "star")
    release(least)
    return done


def _done(e: DataFrame) -> bool:
    """Every node hangs on one root, and no root hangs on another node."""
    twice = e.groupBy("u").count().filter("count > 1").limit(1).count()
    return not twice and not e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi").limit(1).count()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of `edges` (u, v, both bigint), with the component's least node as root.

    Large-star and small-star steps in turn until nothing hangs on a node that is no root; each step is written to the shared folder, so a lost executor costs one
    step. Loops and repeated edges are allowed; null ends are not.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), name)
    while True:  # each round at least halves the longest path, so this ends
        if _done(e):
            roots = e.select(F.col("v").alias("node")).distinct()
            found = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
            found.cut_path = e.cut_path
            return found
        once = _star(_both(e), True)
        release(e)
        e = _star(once, False)
        release(once)
