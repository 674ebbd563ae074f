"""Connected components of a table of links, by contraction.

In each round every node points to its least neighbour (or stays) and links are
redrawn between what their ends point to. Links inside a component vanish round by
round; the number of rounds grows with the logarithm of a component's size. Every
step is an aggregation with a partial sum or a plain equi-join whose hot side Spark
can split, and every round is stored, so lost executors repeat one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lactoscope.llm.stages import stored


def _ordered(links: DataFrame) -> DataFrame:
    return (
        links.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of a link ``a, b``; the root is one node of the component."""
    links = stored(_ordered(links))
    rounds = []
    while not links.isEmpty():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(
            ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up"))
        )
        rounds.append(up)
        first = up.select(F.col("node").alias("a"), F.col("up").alias("up_a"))
        second = up.select(F.col("node").alias("b"), F.col("up").alias("up_b"))
        moved = links.join(first, "a").join(second, "b")
        links = stored(_ordered(moved.select(F.col("up_a").alias("a"), F.col("up_b").alias("b"))))
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = rounds.pop().withColumnRenamed("up", "root")
    while rounds:
        further = labels.withColumnsRenamed({"node": "up"})
        labels = stored(rounds.pop().join(further, "up", "left").select("node", F.coalesce("root", "up").alias("root")))
    return labels
