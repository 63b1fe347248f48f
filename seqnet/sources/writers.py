"""Result tables as files, one folder per graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of one output file, about.
FILE_ROWS = 5_000_000


def _placed(df: DataFrame) -> DataFrame:
    """Rows of a graph side by side, large graphs in several places: few files, no long task."""
    sizes = df.groupBy("graph_id").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).cast("int").alias("_files"))
    salted = df.join(sizes.withColumnRenamed("graph_id", "_graph"), F.col("graph_id").eqNullSafe(F.col("_graph")))
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.col("_files")))
    return salted.repartition("graph_id", "_salt").select(*df.columns)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "errorifexists") -> dict[str, str]:
    """Write each table below ``folder``, divided by ``graph_id`` where there is one.

    Array columns become JSON text in CSV, which has no arrays.
    """
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError("format must be parquet, csv or json")
    paths = {}
    for name, df in tables.items():
        if fmt == "csv":
            nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
            df = df.withColumns({c: F.to_json(c) for c in nested})
        writer = df.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        if "graph_id" in df.columns:
            writer = _placed(df).write.mode(mode).format(fmt)
            if fmt == "csv":
                writer = writer.option("header", True)
            writer = writer.partitionBy("graph_id")
        paths[name] = f"{folder}/{name}"
        writer.save(paths[name])
    return paths
