"""Connected components."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for the nodes of undirected edges between longs; the root is a component's smallest node.

    Each round gives every node the smallest label around it and then follows that label's own label, so a chain takes as
    many rounds as its length has doublings. Minima are combined before the shuffle and joined by equality, so a node with
    many edges costs no more than its rows. Nulls and self-loops are dropped.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("root").alias("other")), "v").groupBy(
            F.col("u").alias("node")).agg(F.min("other").alias("other"))
        best = cut_lineage(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "other").alias("new")))
        # labels that were given up learn what took their place, and so does everything under them
        moved = best.where("old <> new").groupBy(F.col("old").alias("at")).agg(F.min("new").alias("to"))
        hooked = best.join(moved, F.col("old") == F.col("at"), "left").select("node", "old", F.least("new", F.coalesce("to", "new")).alias("root"))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = cut_lineage(hooked.join(up, "root", "left").select("node", "old", F.coalesce("above", "root").alias("root")))
        labels = after.select("node", "root")
        if after.where("old <> root").isEmpty():
            return labels
