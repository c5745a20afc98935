"""Connected components of a link table, as a loop of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.util import cut_lineage, drop_table_files


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: ``root`` is the smallest node reachable.

    Each round takes the least root among a node and its neighbours, then the root's own
    root, so long chains shrink fast.  A round is written to the checkpoint folder; only
    the number of changed rows reaches the driver.  An empty table gives an empty result.
    """
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:  # each round lowers a root, so it ends
        near = both.join(state, both.b == state.node).groupBy("a").agg(F.min("root").alias("near"))
        lower = cut_lineage(state.join(near, state.node == near.a).select("node", F.least("root", "near").alias("root"),
                                                                          F.col("root").alias("was")))
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        new = cut_lineage(lower.join(up, "root").select("node", F.least("root", "higher").alias("root"), "was"))
        changed = new.filter("root < was").limit(1).count()
        drop_table_files(lower)
        drop_table_files(state)
        state = new
        if not changed:
            drop_table_files(both)
            return state.select("node", "root")
