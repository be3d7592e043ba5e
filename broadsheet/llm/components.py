"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.batches import written


MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id) of every end of ``links`` (columns a, b).

    A large star ties the larger neighbours of every id to its least neighbour, a small star the
    smaller ones; after few rounds every component is a star around its least id. Stars change
    links, never their number of ends, so no group is collected; the least neighbour is an
    aggregate that combines before its shuffle, and the join back has one row for each id on one
    side, which adaptive execution can split on the other.
    """
    current = written(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    before = None
    for _ in range(MAX_ROUNDS):
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Now every link points from a smaller to a larger id: gather the smaller neighbours.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(low, "b")
            .select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
            .where("a <> b")
            .distinct()
        )
        current = written(small)
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select("a").distinct().select(F.col("a").alias("id"), F.col("a").alias("component"))
    return current.select(F.col("b").alias("id"), F.col("a").alias("component")).union(roots)
