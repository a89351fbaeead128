"""Components of threshold graphs, without gathering any node's neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import checkpointed

Names = Sequence[str]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)`` for nodes ``(id)`` and edges ``(a, b)``: the smallest id reachable.

    Every round a node and the node that it is labelled by take the smallest
    label around it, then the label of their label: whole trees hook onto each
    other, so rounds grow with the logarithm of a component's width.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = checkpointed(both)
    labels = checkpointed(nodes.select("id", F.col("id").alias("label")))
    while True:  # a round that moves nothing is the last
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        offers = labels.join(near, labels["id"] == near["a"]).where("near < label").select(F.explode(F.array_distinct(F.array("id", "label"))).alias("a"), "near")
        best = offers.groupBy("a").agg(F.min("near").alias("near"))
        pulled = labels.join(best, labels["id"] == best["a"], "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"))
        up = pulled.select(F.col("id").alias("label"), F.col("label").alias("up"))
        jumped = checkpointed(pulled.join(up, "label", "left").select("id", F.least("label", F.coalesce("up", "label")).alias("label")))
        moved = jumped.agg(F.sum(F.xxhash64("id", "label").cast("decimal(38,0)"))).first()[0] != labels.agg(F.sum(F.xxhash64("id", "label").cast("decimal(38,0)"))).first()[0]
        labels = jumped
        if not moved:
            return labels.withColumnRenamed("label", "component")


def dominant_component(nodes: DataFrame, edges: DataFrame, keys: Names) -> DataFrame:
    """nodes ``(keys, id)`` of each key's largest component (the one with the smallest id on ties)."""
    found = nodes.join(components(nodes, edges), "id")
    sizes = found.groupBy(*keys, "component").agg(F.count("*").alias("_n"))
    best = sizes.groupBy(*keys).agg(F.max_by("component", F.struct(F.col("_n"), -F.col("component"))).alias("component"), F.max("_n").alias("size"))
    return found.join(best, [*keys, "component"])
