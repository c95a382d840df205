"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import step

#: The rounds needed grow with the logarithm of the longest chain; far more than any input takes.
MAX_ROUNDS = 100


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of every node are linked to the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    met = both.filter("b > a").join(least, "a")
    return met.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``(a, b)`` that is not the smallest of its component.

    Nodes without links, and the roots themselves, have no row. Every round is written to the shared
    folder, so lineage stays short and lost executors cost one round at most.
    """
    links = step(links.filter("a <> b").distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        count = links.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        ).first()
        if count.n == 0 or (count.n, count.h) == state:
            break
        state = (count.n, count.h)
        links = step(_small_star(_large_star(links)))
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
