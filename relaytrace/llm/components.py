"""Connected components by alternating large-star and small-star rounds.

Edges stay distributed; each round is two aggregations and two joins over the
edge table and goes to the shared checkpoint folder, so a lost executor costs
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaytrace.session import scratch_path


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the larger (large star) or the smaller and the node itself (small
    star) of each node's neighbours at the least of them."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # each edge stands at its larger end
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` of whole numbers to ``(node, least)``: the least node reachable
    from each node that has an edge.  An empty table gives no rows."""
    now = _written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    seen = None
    while True:
        # stars are final once a round leaves all edges as they were
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = _written(_star(_star(now, large=True), large=False), "stars")
    tips = now.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), "least")
    return tips.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())
