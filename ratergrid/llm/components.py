"""Connected components by contraction: in each round a node joins the smallest one that its pointers lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratergrid.session import stored


def connect(links: DataFrame) -> list[DataFrame]:
    """Maps (_node, _to), to be applied one after the other, that lead every node of (_a, _b) to its component.

    In a round each node points to its smallest neighbour, if that is smaller, and pointers jump to where their target
    points until they rest, twice as far each time. So a chain in any order of numbers is shortened by half at least
    in a round, and a rising one falls into one node in as many jumps as the logarithm of its length. Each jump and
    round is kept in the shared folder. A node with very many links is summed up by partial aggregation.
    """
    maps = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        to = stored(both.groupBy("_a").agg(F.min("_b").alias("_low")).select(
            F.col("_a").alias("_node"), F.least("_a", "_low").alias("_to")), "map")
        to = _at_rest(to)
        maps.append(to)
        ends = links.join(to.select(F.col("_node").alias("_a"), F.col("_to").alias("_x")), "_a").join(
            to.select(F.col("_node").alias("_b"), F.col("_to").alias("_y")), "_b")
        links = stored(ends.where("_x != _y").select(
            F.least("_x", "_y").alias("_a"), F.greatest("_x", "_y").alias("_b")).distinct(), "links")
    return maps


def _at_rest(to: DataFrame) -> DataFrame:
    """The map (_node, _to) with every pointer led to a node that points to itself. Pointers never rise."""
    while True:
        moving = to.where("_node != _to").select(F.col("_node").alias("_to"), F.col("_to").alias("_next"))
        jumped = stored(to.join(moving, "_to", "left").select(
            "_node", F.coalesce("_next", "_to").alias("_to"), F.col("_next").isNotNull().alias("_moved")), "jump")
        if jumped.where("_moved").isEmpty():
            return to
        to = jumped.select("_node", "_to")


def compose(rows: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """``rows`` (with a column _node) and _comp, the component that the maps lead to."""
    out = rows.withColumn("_comp", F.col("_node"))
    for to in maps:
        out = out.join(to.select(F.col("_node").alias("_comp"), "_to"), "_comp", "left").select(
            *rows.columns, F.coalesce("_to", "_comp").alias("_comp"))
    return out
