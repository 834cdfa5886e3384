"""Connected components of a graph whose edges are a DataFrame, by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (u, v): label is the smallest ``value`` that the node reaches.

    ``values`` has (node, value); value is a struct whose last field ``cid`` is the
    node itself. Each round takes the smallest label of the neighbours, then
    that of the node whose label one has, so chains halve. Labels are written
    between rounds; the returned table is one that ``cut`` wrote. Joins on a node or label that many rows share are merge joins
    over tables as written, which Spark can split.
    """
    both = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "component-edges")
    nodes = both.select(F.col("u").alias("node")).distinct()
    labels = cut(values.join(nodes, "node").select("node", F.col("value").alias("label")), "component-labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("v"), "label").hint("merge"), "v").groupBy("u").agg(F.min("label").alias("near"))
        spread = labels.join(heard, labels["node"] == heard["u"]).select("node", "label", F.least("label", "near").alias("new"))
        spread = cut(spread, "component-spread")
        if spread.where(F.col("new.cid") != F.col("label.cid")).isEmpty():
            discard(both, spread)
            return labels
        of = spread.select(F.col("node").alias("via"), F.col("new").alias("farther")).hint("merge")
        jumped = spread.join(of, F.col("new.cid") == F.col("via")).select("node", F.least("new", "farther").alias("label"))
        before, labels = labels, cut(jumped, "component-labels")
        discard(before, spread)
