"""Session alignment of an unbounded news source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bellwether.operators.calendar import assign_session


def session_stream(spark: SparkSession, path: str, schema: str, cal: DataFrame) -> DataFrame:
    """News files arriving under ``path``, each row with its sessions as it comes.

    The rule needs only the row's own time and the static calendar, so there is no state,
    no watermark and no late data.
    """
    return assign_session(spark.readStream.schema(schema).parquet(path), cal)
