"""Connected components of an edge table by rounds of hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricklens.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that it reaches.

    Each round, every node that still has edges hooks to its smallest
    neighbour if that is smaller, chains of hooks are shortened to their roots,
    and edges are rewritten to roots; loops and repeats go. A round at least
    merges every node that has a smaller neighbour, so few rounds are needed;
    each is written to the shared folder, so lost executors cost one round.
    """
    left = stored(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges"
    )
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not left.isEmpty():
        hooks = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))  # written with the first jump
        while True:
            further = hooks.select(F.col("node").alias("f_node"), F.col("to").alias("f_to"))
            jumped = hooks.join(further, F.col("to") == F.col("f_node"), "left")
            jumped = stored(jumped.select("node", F.coalesce("f_to", "to").alias("to"), F.col("f_to").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        to = hooks.select(F.col("node").alias("h_node"), F.col("to").alias("h_to"))

        def rooted(df: DataFrame, column: str) -> DataFrame:
            found = df.join(to, F.col(column) == F.col("h_node"), "left")
            return found.withColumn(column, F.coalesce("h_to", column)).drop("h_node", "h_to")

        nodes = stored(rooted(nodes, "component"), "nodes")
        ends = rooted(rooted(left, "a"), "b").where(F.col("a") != F.col("b"))
        left = stored(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return nodes


def grown(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Like ``components`` of all links so far: ``found`` of the earlier ones, joined by the new ``links`` (a, b).

    Only the new links are walked, between the components that the earlier ones made.
    """
    if found is None:
        return components(links)
    ends = links.select("a", "b")
    for c in ("a", "b"):
        root = found.select(F.col("node").alias(f"{c}_node"), F.col("component").alias(f"{c}_root"))
        ends = ends.join(root, F.col(c) == F.col(f"{c}_node"), "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_node", f"{c}_root")
    over = components(ends)
    if over.isEmpty():
        return found
    to = over.select(F.col("node").alias("t_node"), F.col("component").alias("t_component"))
    old = found.join(to, F.col("component") == F.col("t_node"), "left").select("node", F.coalesce("t_component", "component").alias("component"))
    return stored(old.unionByName(over.join(found.select("node"), "node", "left_anti")), "nodes")
