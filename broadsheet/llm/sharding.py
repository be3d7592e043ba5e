"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table, given by an offset
and a stride from hashes of its name. Shards take turns claiming their next free slot until the
table is full, so each holds an equal share to within one slot and adding or losing a shard
moves few slots. A row's key hashes to a slot; the table, bounded by its size, is broadcast.

Defined cases: a null key hashes as the empty text; equal keys go to the same shard; an empty
input gives no rows; extra columns stay as they are, a column named like an output is replaced.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, functions as F

#: Prime, and well over a hundred slots for each shard.
TABLE_SIZE = 8191
MAX_TABLE_SIZE = 1 << 20
HEX_DIGITS = 15


def _hash(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:HEX_DIGITS], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the owning shard for each slot; ``size`` is prime and at most ``MAX_TABLE_SIZE``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not len(shards) <= size <= MAX_TABLE_SIZE or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime between the number of shards and the limit")
    turn = [_hash(f"offset:{name}") % size for name in shards]
    stride = [_hash(f"stride:{name}") % (size - 1) + 1 for name in shards]
    table = [-1] * size
    free = size
    while free:
        for shard, step in enumerate(stride):
            while table[turn[shard]] >= 0:
                turn[shard] = (turn[shard] + step) % size
            table[turn[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key: the leading hex digits of its MD5 modulo the table size."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HEX_DIGITS)
    return (F.conv(digits, 16, 10).cast("bigint") % size).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; one look-up a row, no shuffle."""
    table = fill_table(shards, size)
    owners = df.sparkSession.createDataFrame(
        [(slot, shards[owner]) for slot, owner in enumerate(table)], "slot int, shard string"
    )
    # The slot is found first, since the key may itself be called like an output.
    rows = df.withColumn("_slot", slot_of(F.col(key), size)).drop("slot", "shard").withColumnRenamed("_slot", "slot")
    return rows.join(F.broadcast(owners), "slot")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, files: int = 1, size: int = TABLE_SIZE) -> None:
    """Write each shard's rows under ``shard=<name>``, in at most ``files`` files each.

    A key with very many rows stays in its shard but spreads over the shard's files.
    """
    # By the row itself, so that a task that runs again puts it into the same file.
    file = F.pmod(F.xxhash64(*(c for c, kind in df.dtypes if not kind.startswith("map"))), F.lit(files)).cast("int")
    placed = place(df.withColumn("_file", file), key, shards, size)
    placed.repartition(len(shards) * files, "shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)
