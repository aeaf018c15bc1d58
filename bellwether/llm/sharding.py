"""Sharding through a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own (an offset and a
skip from two hashes of its name). The shards take turns claiming their next free slot until
the table is full. A row's slot is a hash of its key; the table, of fixed size, is broadcast.
Shares differ by at most one slot, and adding or removing a shard moves few other rows.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, math.isqrt(n) + 1))


def _hash(name: str, use: str) -> int:
    return int(hashlib.md5(f"{use}:{name}".encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Per slot, the number of the shard that claimed it. Shards take turns in the order of their names."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need one name each")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size has to be a prime of at least the number of shards")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    wish = {i: _hash(shards[i], "offset") % size for i in turns}
    skip = {i: _hash(shards[i], "skip") % (size - 1) + 1 for i in turns}
    slots, free = [-1] * size, size
    while free:
        for i in turns[: min(len(turns), free)]:
            while slots[wish[i]] >= 0:
                wish[i] = (wish[i] + skip[i]) % size
            slots[wish[i]] = i
            free -= 1
    return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Hash of a key written as text, modulo the table size; a null key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size))


def lookup_table(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The filled table as rows (slot, shard); ``size`` rows whatever the data."""
    rows = [(slot, i) for slot, i in enumerate(fill_table(shards, size))]
    return spark.createDataFrame(rows, "slot bigint, shard int")


def place(df: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """Adds ``slot`` and ``shard`` to every row, without a shuffle.

    Rows with equal keys, repeated rows among them, share a shard; null keys share one, that of empty text.
    Columns of ``df`` called slot or shard are replaced. An empty table gives an empty table.
    """
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), size))
    placed = rows.join(F.broadcast(lookup_table(df.sparkSession, shards, size)), "slot")
    return placed.select(*rows.columns, "shard")


def write_shards(placed: DataFrame, path: str, pieces: int = 8) -> None:
    """One folder per shard of at most ``pieces`` files; a shard is dealt over several tasks by slot and row."""
    salted = placed.withColumn("_piece", F.pmod(F.xxhash64(*placed.columns), F.lit(pieces)))
    salted.repartition("shard", "_piece").drop("_piece").write.partitionBy("shard").parquet(path)
