"""Writers: stage tables, curves, metrics, resumable appends and stage reuse."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet; with ``by``, one directory per value. Rows are grouped by directory first so
    that each task writes few files, and AQE splits a directory with very many rows."""
    w = df.hint("rebalance", *by) if by else df
    out = w.write.mode(mode)
    (out.partitionBy(*by) if by else out).parquet(path)


def write_curve(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def write_metrics(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_missing(new: DataFrame, path: str, key: list[str]) -> None:
    """Append one row for each key that is not stored yet; running it again adds nothing.

    Only the key columns of the stored table are read.
    """
    old = _existing(new.sparkSession, path)
    batch = new.dropDuplicates(key)
    fresh = batch if old is None else batch.join(old.select(*key), key, "left_anti")
    fresh.write.mode("append").parquet(path)


def stage_cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a stage's output if it was written to its end, else build and store it.

    The table is written beside its place and moved there when it is complete; what an
    interrupted run left behind is replaced.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")):
        beside = f"{path}-{uuid.uuid4().hex}"
        write_table(build(), beside)
        fs.delete(place, True)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(beside), place):
            raise OSError(f"cannot move {beside} to {path}")
    return spark.read.parquet(path)
