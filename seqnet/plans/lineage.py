"""Reliable lineage cuts for iterative operators, and size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Largest measured size, in bytes, that is sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    It is the one ``spark.checkpoint.dir`` names; where that is unset, a folder below the
    warehouse, if one is configured or all tasks run on this machine.  On a cluster without
    either this is an error: a folder of the driver's own machine cannot be shared.
    """
    current = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    given = spark.sparkContext.getConf().get("spark.sql.warehouse.dir")
    if not given and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(given or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/_intermediate"


def write_table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/seqnet-{uuid.uuid4().hex}"
    df.write.options(**WRITE_OPTIONS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Below this measured size a table is read as one partition, so joins and
#: aggregations among such tables need no shuffle at all.
ONE_PARTITION_BYTES = 4 * 1024 * 1024


#: Loop tables are read by the job that wrote them, so they need no success marker.
WRITE_OPTIONS = {"compression": "lz4", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


class Stage:
    """A written DataFrame together with figures measured while it was written."""

    def __init__(self, df: DataFrame, columns: int, figures: dict, path: str = ""):
        self.figures = figures
        self.path = path
        self.rows = figures["_rows"]
        self.bytes = (figures["_text"] or 0) + 16 * columns * self.rows
        self.tiny = self.bytes <= ONE_PARTITION_BYTES
        self.df = df.coalesce(1) if self.tiny else df

    def __getitem__(self, name: str):
        return self.figures[name]

    def small(self, other: Stage | None = None) -> DataFrame:
        """The DataFrame as the smaller side of a join, hinted as its measured size allows.

        Two one-partition tables are hash-joined where they are; otherwise the side is
        broadcast up to ``BROADCAST_BYTES`` and shuffled beyond.
        """
        if self.tiny and other is not None and other.tiny:
            return self.df.hint("shuffle_hash")
        return F.broadcast(self.df) if self.bytes <= BROADCAST_BYTES else self.df


def beside(df: DataFrame, tiny: bool) -> DataFrame:
    """The side of a join between tables of one partition each, joined in place without a broadcast job."""
    return df.hint("shuffle_hash") if tiny else df


def _text_bytes(df: DataFrame):
    """Bytes of text, binary and nested values; nested ones count as they read when printed."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind in ("struct", "array", "map"):
            total = total + F.coalesce(F.octet_length(F.col(field.name).cast("string")), F.lit(0))
    return F.sum(total)


def cut(df: DataFrame, tiny: bool = False, replaces: Stage | None = None, **figures) -> Stage:
    """Write ``df`` as a table into the checkpoint folder in one job and measure it on the way.

    Reading the table back gives a plan with no history at all: a lost executor costs a
    re-read, and neither constraints nor orderings pile up over the rounds of a loop.
    ``tiny`` marks results that are bounded by inputs measured as tiny; they are written
    as one file.  ``figures`` are extra aggregate columns observed in the same job, so a
    loop learns whether anything changed without a second action.  ``replaces`` names the
    table of the round before, which nothing reads once this one is written: it is removed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/seqnet-{uuid.uuid4().hex}"
    seen = Observation()
    watched = (df.coalesce(1) if tiny else df).observe(
        seen,
        F.count(F.lit(1)).alias("_rows"),
        _text_bytes(df).alias("_text"),
        *[value.alias(name) for name, value in figures.items()],
    )
    # Inferred filters multiply in chains of self-joins and have nothing to prune here.
    before = spark.conf.get(CONSTRAINTS, "true")
    spark.conf.set(CONSTRAINTS, "false")
    try:
        watched.write.options(**WRITE_OPTIONS).parquet(path)
    finally:
        spark.conf.set(CONSTRAINTS, before)
    if replaces is not None:
        remove(spark, replaces.path)
    return Stage(spark.read.schema(df.schema).parquet(path), len(df.schema.fields), seen.get, path)


def keep(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, for plans that read it several times."""
    return cut(df).df
