"""Connected components of a table of links, by contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """One row per id that occurs in ``links`` (columns a and b): node and component, the smallest id reachable from it.

    In each round every id moves to its smallest neighbour and the links move along; links within one id vanish. The smallest id of a
    component never moves, so the rounds end with it. Each round is a counting aggregate and two joins of stored tables, whose large
    keys Spark may split; no component is ever gathered.
    """
    left = stored(links.filter("a <> b").select("a", "b"))
    moves: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        move = stored(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent")))
        moves.append(move)
        moved = (left.join(move.select(F.col("node").alias("a"), F.col("parent").alias("to_a")), "a")
                 .join(move.select(F.col("node").alias("b"), F.col("parent").alias("to_b")), "b"))
        left = stored(moved.filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = moves[0].withColumnRenamed("parent", "component")
    for move in moves[1:]:
        onward = move.select(F.col("node").alias("component"), "parent")
        labels = labels.join(onward, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
    return stored(labels)
