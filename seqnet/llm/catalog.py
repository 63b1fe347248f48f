"""One query per corpus operator over the given tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqnet.llm import divergence, embeddings, licenses, linededup, mixing, mpeg, packing, prefixtrie, scoring, secrets, simhash, toxicity, warc
from seqnet.llm.common import on_workers


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(secrets.secrets(table(spark, folder, "documents")))


def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"))


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op8_mpeg_audio(spark: SparkSession, folder: str) -> DataFrame:
    return mpeg.digests(mpeg.stored_features(table(spark, folder, "documents")))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.digests(linededup.line_report(table(spark, folder, "documents")))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op11_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score(table(spark, folder, "documents"))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, folder, "conversations"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_license_scan,
        op3_toxicity,
        op4_embedding_near_dedup,
        op5_secret_scan,
        op6_source_mixing,
        op7_best_fit_packing,
        op8_mpeg_audio,
        op9_line_dedup,
        op10_warc,
        op11_lm_scoring,
        op12_conversation_trie,
        op13_source_divergence,
    )
}

ORACLES: dict[str, str] = {
    "op2_license_scan": licenses.oracle(),
    "op6_source_mixing": mixing.oracle(),
    "op9_line_dedup": linededup.oracle(),
    "op10_warc": warc.oracle(),
    "op12_conversation_trie": prefixtrie.oracle(),
    "op13_source_divergence": divergence.oracle(),
}
