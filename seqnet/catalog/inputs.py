"""The given tables as events, sequences and networks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqnet.operators import events as ev
from seqnet.operators import influence as inf
from seqnet.operators import network as nw
from seqnet.plans.lineage import cut, shared_folder, keep


#: Labels of the event table, as columns of the wide matrices.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder."""
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


def user_events(spark: SparkSession, folder: str) -> DataFrame:
    return ev.event_table(table(spark, folder, "events"), "user_id", "ts", "event_type")


def segment_events(spark: SparkSession, folder: str) -> DataFrame:
    """User events with the customer's market segment as the graph; stored, so the join runs once."""
    users = table(spark, folder, "customer", "c_custkey", "c_mktsegment")
    rows = table(spark, folder, "events", "user_id", "ts", "event_type").join(users, F.col("user_id") == F.col("c_custkey"))
    return keep(ev.event_table(rows, "user_id", "ts", "event_type", graph="c_mktsegment"))


def brand_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Brands bought by each customer in order of date, order and line; one graph per segment."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, folder, "part", "p_partkey", "p_brand")
    customers = table(spark, folder, "customer", "c_custkey", "c_mktsegment")
    rows = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
    )
    return ev.event_table(rows, "o_custkey", "o_orderdate", "p_brand", graph="c_mktsegment", tie=["o_orderkey", "l_linenumber"])


def brand_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each customer, counted by order before the wide join: no case of ``brand_rows`` has more events."""
    lines = table(spark, folder, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_lines"))
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, folder, "customer", "c_custkey", "c_mktsegment")
    counted = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("_lines").alias("_n"))
    rows = counted.join(customers, F.col("o_custkey") == F.col("c_custkey")).filter("c_mktsegment is not null")
    return rows.select(F.col("c_mktsegment").alias("graph_id"), F.col("o_custkey").alias("case_id"), "_n")


def brand_events(spark: SparkSession, folder: str) -> DataFrame:
    """``brand_rows``, stored."""
    return keep(brand_rows(spark, folder))


def brand_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The observed network of brands, in one pass over the joined rows."""
    return nw.pair_frequencies(brand_rows(spark, folder), sizes=brand_sizes(spark, folder))


def order_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's orders as a chain of nodes, one graph per segment; ``chain`` is the customer."""
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, folder, "customer", "c_custkey", "c_mktsegment")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    placed = ev.event_table(rows.withColumn("_key", F.format_string("%08d", "o_orderkey")), "o_custkey", "o_orderdate", "_key", graph="c_mktsegment", tie=["o_orderkey"])
    steps = nw.transitions(placed)
    return keep(steps.join(rows.select(F.format_string("%08d", "o_orderkey").alias("src"), F.col("o_custkey").alias("chain")), "src").select("graph_id", "src", "dst", F.lit(1.0).alias("weight"), "chain"))


def order_events(spark: SparkSession, folder: str) -> DataFrame:
    return ev.event_table(table(spark, folder, "orders"), "o_custkey", "o_orderdate", "o_orderpriority")


def role_events(spark: SparkSession, folder: str) -> DataFrame:
    return ev.event_table(table(spark, folder, "conversations"), "conv_id", "turn", "role")


def user_network(spark: SparkSession, folder: str) -> DataFrame:
    return keep(nw.pair_frequencies(user_events(spark, folder)))


def segment_network(spark: SparkSession, folder: str) -> DataFrame:
    return keep(nw.pair_frequencies(segment_events(spark, folder)))


def segment_states(spark: SparkSession, folder: str) -> DataFrame:
    return keep(nw.observed_edges(nw.state_network(segment_events(spark, folder))))


def brand_network(spark: SparkSession, folder: str) -> DataFrame:
    return keep(brand_pairs(spark, folder))


def brand_states(spark: SparkSession, folder: str) -> DataFrame:
    return keep(nw.observed_edges(nw.state_network(brand_events(spark, folder))))


def strong_brands(spark: SparkSession, folder: str) -> DataFrame:
    """The 30 heaviest brand transitions of each segment: a sparse network."""
    return keep(nw.filter_edges(brand_pairs(spark, folder), top_n=30))


def token_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents as word sequences, one graph per language."""
    words = F.filter(F.split(F.lower("text"), r"[ \t\r\n]+"), lambda w: w != "")
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    return docs.select(F.col("lang").alias("graph_id"), F.col("doc_id").alias("seq_id"), words.alias("items"), F.lit(1).cast("long").alias("weight"))


def signals(spark: SparkSession, folder: str) -> DataFrame:
    return inf.prepare_signals(table(spark, folder, "events"), "user_id", "ts", "event_type")


def influence_rows(spark: SparkSession, folder: str, latency: float = 3600.0) -> DataFrame:
    return inf.temporal_influence(signals(spark, folder), latency)


def influence_net(spark: SparkSession, folder: str) -> DataFrame:
    """Influence edges within an hour, weights rounded so that equal sums compare equal."""
    edges = inf.influence_edges(inf.smooth_and_filter(influence_rows(spark, folder)))
    return cut(edges.withColumn("weight", F.round("weight", 9))).df
