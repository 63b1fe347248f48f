"""Ordered access inside groups, safe for groups too large for one task.

A window over ``(graph, case)`` sorts each case in one task.  Cases with more than
``HOT_ROWS`` rows are first divided into consecutive chunks along their full
order; the window then runs per chunk and one small row per chunk carries the
last item, the first item and the row count across the chunk borders.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqnet.plans.lineage import cut, write_table

#: A group larger than this is divided before it is sorted.
HOT_ROWS = 2_000_000

CHUNK = "_chunk"


def as_number(df: DataFrame, name: str) -> Column:
    """A DOUBLE that never decreases along the column's own order."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(name)).cast("double")
    if kind == "timestamp":
        return F.unix_micros(F.col(name)).cast("double")
    if kind == "date":
        return F.unix_date(F.col(name)).cast("double")
    return F.col(name).cast("double")


def with_chunks(df: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """Add ``_chunk`` when, and only when, some group holds more than ``hot_rows`` rows.

    Rows of hot groups are range-partitioned by group and full order, so every group gets cut
    points of its own.  Rows that tie in the order are told apart by their place among the
    sorted rows of their input partition, which is the same whenever the partition is computed
    again, in whatever order its rows come.  The chunked rows are written once, so all later steps see the same chunks.  ``df`` is read once to count its groups, unless ``sizes`` has
    the keys and an upper bound ``_n`` of each group's rows: worth giving where ``df`` is dear.
    """
    if CHUNK in df.columns:
        return df
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if sizes is None else sizes.select(*keys, "_n")
    hot = cut(sizes.filter(F.col("_n") > hot_rows), _hot_rows=F.sum("_n"))
    if not hot.rows:
        return df
    # No chunk holds much more than half of the limit.
    pieces = 2 * math.ceil(hot["_hot_rows"] / hot_rows)
    groups = hot.small().select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)]
    rows = df.join(groups, same, "left_semi").sortWithinPartitions(*keys, *order, F.xxhash64(*df.columns))
    rows = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(pieces, *keys, *order, "_place")
    placed = write_table(rows.drop("_place").withColumn(CHUNK, F.spark_partition_id() + 1))
    return df.join(groups, same, "left_anti").withColumn(CHUNK, F.lit(0)).unionByName(placed)


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    value: str,
    position: bool = True,
) -> DataFrame:
    """Add ``prev`` and ``next`` of ``value`` and a 1-based ``pos`` within ``keys``."""
    chunked = CHUNK in df.columns
    window = Window.partitionBy(*keys, *([CHUNK] if chunked else [])).orderBy(*order)
    out = df.withColumn("prev", F.lag(value).over(window)).withColumn("next", F.lead(value).over(window))
    if position:
        out = out.withColumn("pos", F.row_number().over(window).cast("long"))
    if not chunked:
        return out
    rank = F.struct(*order)
    borders = df.groupBy(*keys, CHUNK).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(value, rank).alias("_first"),
        F.max_by(value, rank).alias("_last"),
    )
    along = Window.partitionBy(*keys).orderBy(CHUNK)
    borders = borders.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(CHUNK).alias("_border"),
        F.lag("_last").over(along).alias("_before"),
        F.lead("_first").over(along).alias("_after"),
        F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_skip"),
    ).filter("_before is not null or _after is not null")
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = out.join(borders, [*match, F.col(CHUNK) == F.col("_border")], "left")
    joined = joined.withColumn("prev", F.coalesce("prev", "_before")).withColumn("next", F.coalesce("next", "_after"))
    if position:
        joined = joined.withColumn("pos", F.col("pos") + F.coalesce("_skip", F.lit(0)))
    return joined.select(*out.columns)
