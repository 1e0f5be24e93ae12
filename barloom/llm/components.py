"""Connected components of a link table, by contraction, without the links leaving Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of every node in ``edges`` (a, b: long).

    In each round every root takes its smallest neighbour as parent; links are carried over to the
    new roots and those inside one component vanish. Rounds end when no link is left.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    nodes = written(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "nodes")
    while not links.isEmpty():
        parent = written(links.groupBy("a").agg(F.min("b").alias("parent")), "parents")
        hop = parent.select(F.col("a").alias("root"), "parent")
        nodes = written(nodes.join(hop, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "nodes")
        of_a, of_b = hop.select(F.col("root").alias("a"), F.col("parent").alias("pa")), hop.select(F.col("root").alias("b"), F.col("parent").alias("pb"))
        moved = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        links = written(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    return nodes
