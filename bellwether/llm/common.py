"""Helpers shared by the operators of this package."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation, and gives Catalyst
    the true size of the table, so a later join broadcasts it only if it is small enough.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(keys: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``keys``, a stored table of a few numbers a row, marked for broadcast if it has at most so many rows.

    For joins whose other side holds texts; beyond that size they are joined as Spark sees fit."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of(key: str, modulus: int) -> Column:
    """crc32 of a key written as text, modulo ``modulus``; 0 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(0)) % modulus


def hashed_share(key: str, wanted: int, rows: int, seed: str) -> Column:
    """True for a share of the keys of ``wanted / rows`` (all, if there are no more rows), by hash."""
    if rows <= wanted:
        return F.lit(True)
    cut = math.floor(wanted / rows * (1 << 62))
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 2) < F.lit(cut)
