"""Joins on keys of which a few hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from broadsheet.session import materialize

# Bound of the list of heavy keys; it is broadcast whatever the data.
MAX_HEAVY_KEYS = 1000
# A dimension of short rows up to this size is broadcast; a larger one is shuffled.
MAX_BROADCAST_ROWS = 50_000


def heavy_keys(sample: DataFrame, key: str) -> DataFrame:
    """The most frequent keys of a sample, at most ``MAX_HEAVY_KEYS``.

    They only steer the salting. Any choice of keys gives the same join result.
    """
    return (
        sample.groupBy(key)
        .count()
        .orderBy(F.desc("count"), key)
        .limit(MAX_HEAVY_KEYS)
        .select(key)
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    heavy: DataFrame | None = None,
    salts: int = 32,
) -> DataFrame:
    """Inner equi join; rows of ``heavy`` keys are spread over ``salts`` sub-keys.

    Without ``heavy`` it is a plain join, where adaptive execution splits skewed tasks.
    """
    if heavy is None:
        return left.join(right, key)
    # both sides read the list, so it is written once
    listed = materialize(heavy.select(key).distinct())
    marks = F.broadcast(listed.withColumn("_heavy", F.lit(True)))
    spread = F.pmod(F.xxhash64(*[c for c in left.columns if c != key]), F.lit(salts))
    salted_left = left.join(marks, key, "left").withColumn(
        "_salt", F.when(F.col("_heavy"), spread).otherwise(F.lit(0)).cast("int")
    )
    every = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    salted_right = right.join(marks, key, "left").withColumn("_salt", F.explode(every))
    return (
        salted_left.drop("_heavy")
        .join(salted_right.drop("_heavy"), [key, "_salt"])
        .drop("_salt")
    )


def join_dimension(
    left: DataFrame, dim: DataFrame, key: str, max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Inner join with a written dimension: broadcast while it is counted to be small.

    A larger one is shuffled, with the most frequent keys of ``left`` salted.
    """
    if dim.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(dim), key)
    return salted_join(left, dim, key, heavy_keys(left, key))
