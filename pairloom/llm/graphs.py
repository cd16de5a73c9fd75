"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import stage


def least_neighbours(edges: DataFrame) -> DataFrame:
    """(node, next): the smallest of every node of (a, b) and its neighbours."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("next"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("next")))
    return ends.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("next"))


def roots(steps: DataFrame) -> DataFrame:
    """(node, next) with the last node that steps (node, next) lead to. Steps go down and end at a node that is its own."""
    while True:
        further = steps.select(F.col("node").alias("next"), F.col("next").alias("last"))
        went = (F.col("next") != F.col("last")).alias("went")
        moved = stage(steps.join(further, "next").select("node", F.col("last").alias("next"), went), "labels")
        steps = moved.select("node", "next")
        if not moved.where("went").limit(1).count():
            return steps


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of (a, b), two numbers. Each round leads every
    node to its smallest neighbour, on to that one's and so to the end, and keeps only the distinct edges between ends:
    a node that is not led away leaves in the next round or has another led to it, so two rounds halve the nodes, and
    later rounds have few edges left. The smallest neighbour is found before the shuffle in each task, so a node with
    very many edges is no hot spot there. Every round is a staged table."""
    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = stage(edges.where("a <> b").select(*pair).distinct(), "edges")
    labels = None
    while True:
        led = roots(stage(least_neighbours(edges), "labels"))
        if labels is None:
            labels = led.withColumnRenamed("next", "component")
        else:
            moved = led.select(F.col("node").alias("component"), "next")
            labels = labels.join(moved, "component", "left")
            labels = stage(labels.select("node", F.coalesce("next", "component").alias("component")), "labels")
        start = led.select(F.col("node").alias("a"), F.col("next").alias("next_a"))
        end = led.select(F.col("node").alias("b"), F.col("next").alias("next_b"))
        left = edges.join(start, "a").join(end, "b").where("next_a <> next_b")
        left = left.select(F.col("next_a").alias("a"), F.col("next_b").alias("b")).select(*pair).distinct()
        edges = stage(left, "edges")
        if not edges.limit(1).count():
            return labels
