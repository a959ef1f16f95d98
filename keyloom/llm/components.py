"""Connected components of a graph that may have any number of nodes, by min labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the label is the smallest node of its component.

    Each round links the roots of both ends of each edge (the larger root under the smallest
    neighbour root), then shortens the paths; edges inside one component are dropped. The rounds needed grow with the
    logarithm of the component's size. Written tables cut the lineage, so a lost executor costs one round.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").where("a is not null and b is not null")
    nodes = both.select(F.col("a").alias("node")).unionByName(both.select(F.col("b").alias("node"))).distinct()
    # the first hooks come from the edges themselves: to the smallest neighbour, or itself
    hooks = both.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).groupBy("node").agg(F.min("to").alias("to"))
    parent = materialize(nodes.join(hooks, "node", "left").select("node", F.coalesce("to", "node").alias("label")), "parents")
    left = both
    while True:
        parent = _flatten(parent)
        ends = left.join(parent.toDF("a", "la"), "a").join(parent.toDF("b", "lb"), "b")
        ends = materialize(ends.where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "open")
        if left is not both:
            discard(spark, left)
        left = ends
        if left.isEmpty():
            return parent
        hooks = left.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).groupBy("node").agg(F.min("to").alias("to"))
        old = parent
        parent = materialize(parent.join(hooks, "node", "left").select("node", F.coalesce("to", "label").alias("label")), "parents")
        discard(spark, old)


def _flatten(parent: DataFrame) -> DataFrame:
    """Every node points to its root."""
    spark = parent.sparkSession
    while True:
        up = parent.toDF("label", "above")
        moved = materialize(parent.join(up, "label").select("node", F.col("above").alias("label"), (F.col("above") != F.col("label")).alias("moved")), "parents")
        discard(spark, parent)
        parent = moved.select("node", "label")
        parent._keyloom_path = moved._keyloom_path
        if moved.where("moved").isEmpty():
            return parent
