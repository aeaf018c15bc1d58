"""From raw documents to shards: classify, de-duplicate, decontaminate, mix, place.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a table with
the columns of ``documents``; the last adds ``slot`` and ``shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.llm import decontamination, mixing, quality, sharding, shingles
from bellwether.llm.common import stored, table
from bellwether.llm.queries import SHARDS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    judged = quality.classify(docs.select(F.struct("*").alias("row"), "text"), model)
    return judged.filter("predicted = 1").select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles.

    SimHash fingerprints of these shingles are linked by the index of op10 and held to the exact similarity; prefixes of shingle sets
    find the links that three bits lose (``llm/shingles.py``)."""
    return shingles.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources are read again, at most twice in all."""
    sized = mixing.sized_rows(docs)
    planned = mixing.plan(mixing.source_table(sized, "source"), max_repeats=2.0)
    return mixing.mix(docs.select(F.struct("*").alias("document"), "source", "doc_id"), sized, planned).select("document.*")


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Slot and shard of every row."""
    return sharding.place(docs, SHARDS)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", place_in_shards),
]
#: A learned classifier and fingerprints have no SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
