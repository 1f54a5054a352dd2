"""Connected components by alternating large-star and small-star rounds.

Both rounds are a minimum per node (partial aggregation absorbs hubs before the shuffle) and a join back on the
node, which AQE may split when one node holds most edges. No neighbour list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import remove_folder, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _spread(low: DataFrame) -> DataFrame:
    """One row per node, dealt anew: the join below then shuffles both sides, which lets AQE split a hub's edges."""
    return low.repartition(F.xxhash64("src"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    low = _spread(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low")))
    return both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = _spread(down.groupBy("src").agg(F.min("dst").alias("low")))
    hung = down.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return hung.unionAll(low.select("src", F.col("low").alias("dst"))).where("src <> dst")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Null ends and self-loops are ignored, direction and repeats do not matter, no edges give no rows. Each round is
    written to the shared folder, so lineage stays short, and the round before it is deleted; rounds stop when the edge set
    no longer changes.
    """
    once = (edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst")
            .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    now, folder = written(once, "components")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).alias("mark")
    seen = now.agg(mark).head()["mark"]
    for _ in range(max_rounds):
        if not seen[0]:
            break
        before = folder
        now, folder = written(_small_star(_large_star(now).distinct()).distinct(), "components")
        remove_folder(edges.sparkSession, before)
        mark_now = now.agg(mark).head()["mark"]
        if mark_now == seen:
            break
        seen = mark_now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionAll(
        now.select(F.col("dst"), F.col("dst")).distinct())
