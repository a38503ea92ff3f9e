"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b), the root being the smallest node that can be reached.

    Each round takes the smallest root among neighbours and then that root's own root, so chains shorten by half and more
    per round. Minima are formed before the shuffle, so a node with very many links is no load on one task. Rounds are
    written, so none of them is ever computed again.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = materialize(both.distinct(), "links")
    roots = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "roots")
    while True:
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        better = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        moved = materialize(better.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")), "roots")
        roots = moved.select("node", "root")
        if moved.where("old <> root").isEmpty():
            return roots
