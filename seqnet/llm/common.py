"""Small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Settings with which workers, which Spark keeps for later tasks, give freed memory back at once.
LEAN = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "262144"}
#: Rows of a batch that are Python objects at a time.
SLICE = 500
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def on_workers(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package as the driver does, and keep them lean."""
    settings = spark.sparkContext.environment
    known = settings.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        settings["PYTHONPATH"] = f"{known}:{ROOT}".strip(":")
    settings.update(LEAN)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in small pieces, so that long texts are not all turned into objects together."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside exchange ``SLICE`` rows at a time with Python workers, so that long values do not fill an executor's memory outside its heap."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, min(SLICE, int(before)) if int(before) > 0 else SLICE)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def raw_text(text: str) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key is in the one column of ``dropped``; null keys stay."""
    gone = fresh(docs, "_gone")
    other = dropped.toDF(gone)
    return docs.join(other, docs[key] == other[gone], "left_anti").select(*docs.columns)
