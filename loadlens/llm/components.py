"""Connected components of a graph given as a table of links.

Every node starts with itself as label.  A round lets each node, and the node its
label names, take the smallest label seen across a link, and then follows labels
once.  Labels at least halve their distance to the smallest node of a component,
so rounds grow with the logarithm of a chain's length.  Each round is stored in the
shared folder.  Nodes and links are never collected; sums over popular labels
are combined before they are shuffled, and the joins read stored tables on both
sides, which lets adaptive execution split a label that very many nodes share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loadlens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root the smallest node reachable.

    Loops and repeated links change nothing; links with NULL are left out; no
    links give no rows.
    """
    known = links.select("a", "b").dropna().where("a != b")
    edges = stored(known.union(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    # After the first step a label is the smallest neighbour or the node itself.
    labels = stored(
        edges.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels"
    )
    own = labels.schema["root"].dataType
    while True:
        grand = _follow(labels)
        across = edges.join(grand.select(F.col("node").alias("b"), "root"), "b").select("a", "root")
        lowest = across.groupBy("a").agg(F.min("root").alias("root")).withColumnRenamed("a", "node")
        # What a node hears is also told to the node that its label names.
        told = labels.withColumnRenamed("root", "parent").join(lowest, "node")
        heard = lowest.union(told.groupBy("parent").agg(F.min("root").alias("root"))).withColumn("was", F.lit(None).cast(own))
        # Every node has its old label next to the new one.
        heard = heard.union(grand.select("node", "root", "was"))
        best = stored(heard.groupBy("node").agg(F.min("root").alias("root"), F.max("was").alias("was")), "labels")
        labels = best.select("node", "root")
        if best.where("root != was").isEmpty():
            return labels


def _follow(labels: DataFrame) -> DataFrame:
    """Each node with the label of its label, and its own as ``was``."""
    to = labels.select(F.col("node").alias("was"), F.col("root").alias("next"))
    return labels.withColumnRenamed("root", "was").join(to, "was").select("node", F.col("next").alias("root"), "was")
