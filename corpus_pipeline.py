"""Corpus pipeline: from raw documents to packed training sequences.

Toxic documents go, repeated lines go, one document of each group of near copies stays,
sources are mixed to target weights, and the rest is packed.  Every stage is written as
Parquet to the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqnet.llm.common import on_workers
from seqnet.llm.linededup import drop_repeated_lines
from seqnet.llm.mixing import mix
from seqnet.llm.packing import pack
from seqnet.llm.simhash import drop_near_duplicates
from seqnet.llm.toxicity import drop_toxic
from seqnet.plans.lineage import write_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; learnt from the labels of the folder."""
    on_workers(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more of them share, but for the last holder."""
    on_workers(spark)
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: similarity of 0.8 or more on shingles of five words.

    The similarity alone decides: there is no limit on the distance of fingerprints.
    """
    on_workers(spark)
    return drop_near_duplicates(docs, width=5, max_distance=None, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics meet their target weights."""
    on_workers(spark)
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    on_workers(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained score decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir))
    return docs
