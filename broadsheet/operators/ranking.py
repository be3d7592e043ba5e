"""Positions in a total order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.operators.skew import join_dimension
from broadsheet.session import materialize


def global_positions(df: DataFrame, keys: Sequence[Column | str], name: str) -> DataFrame:
    """Number rows from 1 in the order of ``keys``, which should be unique.

    One range-partitioned sort, written once to the checkpoint folder with the row's
    number inside its partition. A hot group is cut wherever a range ends. The driver sees
    one count per partition and turns them into offsets.
    """
    ordered = df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id())
    ordered = materialize(ordered)
    part = F.shiftright("_at", 33)
    counts = dict(ordered.groupBy(part.alias("part")).count().collect())
    if not counts:
        return ordered.withColumn(name, F.lit(0).cast("bigint")).drop("_at")
    sizes = [counts.get(no, 0) for no in range(max(counts) + 1)]
    offsets = ",".join(str(v) for v in [0, *accumulate(sizes)])
    offset = F.split(F.lit(offsets), ",").cast("array<bigint>")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    position = F.element_at(offset, part.cast("int") + 1) + within + 1
    return ordered.withColumn(name, position).drop("_at")


def with_group_start(df: DataFrame, group: str, position: str, start: str) -> DataFrame:
    """Add the lowest ``position`` of each group.

    The groups are a written dimension of one short row each, so a group with a large share of the
    rows meets its row by broadcast, or salted where there are many groups.
    """
    starts = materialize(df.groupBy(group).agg(F.min(position).alias(start)))
    return join_dimension(df, starts, group)
