"""Connected components by alternating large-star and small-star steps.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.) Both
steps keep the components and turn each into a star around its smallest node.
Nothing is collected; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import join_counted
from .store import materialize


def _spread(near: DataFrame, only_larger: bool) -> DataFrame:
    """near (u, v): each u gives its neighbours its smallest neighbour m (or itself) to hang on."""
    least = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
    hung = join_counted(near, least, ["u"], near.count())  # the centre of a large star is a hot key
    if only_larger:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    own = least.where("u <> m").select("u", F.col("m").alias("v"))
    return hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of non-null longs -> (node, root), root the smallest node of its component; isolated nodes have no row."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = materialize(now, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_spread(both, only_larger=True), "edges")
        now = materialize(_spread(large, only_larger=False), "edges")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
