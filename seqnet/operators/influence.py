"""Temporal influence: ordered pairs of signals of one entity within a latency.

Times are kept as whole microseconds, so equal distances group exactly; distances are
shown in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqnet.functions.discretize import order_kind
from seqnet.functions.text import clean_signal
from seqnet.operators.events import require_columns, sequences
from seqnet.operators.graph import is_dag
from seqnet.operators.network import adjacency_matrix
from seqnet.plans.lineage import cut
from seqnet.plans.ordering import HOT_ROWS, as_number, neighbours, with_chunks

ENTITY = ["graph_id", "entity"]
MICROS = 1_000_000
# Default smoothing and latency of the temporal analysis.
EPSILON, LATENCY_SECONDS = 0.01, 3600.0
#: Events of one entity in one latency bucket above which the bucket is divided.
HOT_BUCKET_ROWS = 20_000


def _signal(df: DataFrame, name: str) -> Column:
    return clean_signal(name) if df.schema[name].dataType.typeName() == "string" else F.col(name).cast("string")


def prepare_signals(
    df: DataFrame, entity: str, time: str, signal: str, graph: str | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``graph_id, entity, time, signal, event_index, order_kind, t`` with ``t`` in microseconds.

    Text times that are neither numbers nor dates order as text; an entity then uses its
    numbers when all of its values are numbers and the event index otherwise.
    """
    require_columns(df, [entity, time, signal])
    kind = order_kind(df, time)
    raw = F.col(time)
    text = df.schema[time].dataType.typeName() == "string"
    if kind == "numeric":
        order = F.trim(raw).try_cast("double") if text else raw.cast("double")
    elif kind == "datetime":
        order = F.trim(raw).try_cast("timestamp_ntz") if text else raw
    else:
        order = raw
    who = clean_signal(entity) if df.schema[entity].dataType.typeName() == "string" else F.col(entity)
    rows = df.select(
        (F.col(graph) if graph else F.lit("all")).alias("graph_id"), who.alias("entity"), raw.alias("time"), _signal(df, signal).alias("signal"), order.alias("_order")
    ).dropna(subset=["entity", "signal", "_order"])
    chunked = with_chunks(rows, ENTITY, ["_order", "signal"], hot_rows)
    placed = neighbours(chunked, ENTITY, [F.col("_order"), F.col("signal")], "signal").withColumn("event_index", F.col("pos"))
    if kind == "text":
        number = F.trim(F.col("time")).try_cast("double")
        plain = placed.groupBy(*ENTITY).agg(F.every(number.isNotNull()).alias("_plain"))
        placed = placed.join(plain, ENTITY)
        t = F.when(F.col("_plain"), number).otherwise(F.col("event_index").cast("double")) * MICROS
    else:
        t = as_number(placed, "_order") * (MICROS if kind == "numeric" else 1)
        if kind == "datetime" and placed.schema["_order"].dataType.typeName() == "date":
            t = t * 86400 * MICROS
    return placed.select(*ENTITY, "time", "signal", "event_index", F.lit(kind).alias("order_kind"), F.round(t).cast("long").alias("t"))


def positional_events(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Run-free sequences whose time is the position in the sequence."""
    rows = sequences(events, hot_rows)
    return rows.select(
        "graph_id",
        F.col("case_id").alias("entity"),
        F.col("pos").alias("time"),
        F.col("item").alias("signal"),
        F.col("pos").alias("event_index"),
        F.lit("numeric").alias("order_kind"),
        (F.col("pos") * MICROS).alias("t"),
    )


def signal_counter(signals: DataFrame) -> DataFrame:
    return signals.groupBy(*ENTITY, "time", "signal").agg(F.count(F.lit(1)).alias("signal_counter"))


def latency_pairs(
    signals: DataFrame, latency_seconds: float = LATENCY_SECONDS, hot_bucket_rows: int = HOT_BUCKET_ROWS
) -> DataFrame:
    """Pairs of signals of one entity with ``0 < dt <= latency``: ``from_signal, to_signal, dt, n``.

    An equi-join on entity and latency bucket, the earlier side in its own and the next
    bucket.  Equal (entity, time, signal) rows are counted first and pairs carry the
    product of their counts.  Buckets with very many events are divided in time, both sides:
    a piece joins one short stretch of the earlier side with one of the later side within
    reach, so the rows of a task do not grow with the bucket.
    """
    width = max(1, int(latency_seconds * MICROS))
    counted = signals.groupBy(*ENTITY, "t", "signal").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("bucket", F.floor(F.col("t") / F.lit(width)).cast("long"))
    keys = [*ENTITY, "bucket"]
    early = counted.select(*ENTITY, F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"), F.col("t").alias("t0"), F.col("signal").alias("from_signal"), F.col("n").alias("n0"))
    late = counted.select(*keys, F.col("t").alias("t1"), F.col("signal").alias("to_signal"), F.col("n").alias("n1"))
    full = cut(early.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_bucket_rows))
    if full.rows:
        parts = full.small().select(*keys, F.ceil(F.col("_n") / hot_bucket_rows).alias("_parts"))
        parts = parts.withColumn("_step", F.ceil(F.lit(width) / F.col("_parts")))

        def stretch(time: str) -> Column:
            return F.when(F.col("_step").isNotNull(), F.floor(F.col(time) / F.col("_step"))).otherwise(F.lit(0).cast("long"))

        # Within ``width`` lie at most ``_parts`` further stretches; other buckets keep one piece.
        reach = F.coalesce("_parts", F.lit(0).cast("long"))
        early = early.join(parts, keys, "left").withColumn("_early", stretch("t0"))
        early = early.withColumn("_late", F.explode(F.sequence(F.col("_early"), F.col("_early") + reach))).drop("_parts", "_step")
        late = late.join(parts, keys, "left").withColumn("_late", stretch("t1"))
        late = late.withColumn("_early", F.explode(F.sequence(F.col("_late") - reach, F.col("_late")))).drop("_parts", "_step")
        keys = [*keys, "_early", "_late"]
    gap = F.col("t1") - F.col("t0")
    pairs = early.join(late, keys).filter((gap > 0) & (gap <= width))
    return pairs.select("graph_id", "entity", "from_signal", "to_signal", gap.alias("dt"), (F.col("n0") * F.col("n1")).alias("n"))


def temporal_influence(
    signals: DataFrame, latency_seconds: float = LATENCY_SECONDS, hot_bucket_rows: int = HOT_BUCKET_ROWS
) -> DataFrame:
    """Influence per (from, to, exact distance): frequency, decay ``1/(1+dt)`` and their product."""
    pairs = latency_pairs(signals, latency_seconds, hot_bucket_rows)
    sums = pairs.groupBy("graph_id", "from_signal", "to_signal", "dt").agg(F.sum("n").alias("frequency"))
    seconds = F.col("dt") / MICROS
    decay = 1 / (1 + seconds)
    return sums.select(
        "graph_id",
        "from_signal",
        "to_signal",
        "dt",
        seconds.alias("delta_t"),
        "frequency",
        decay.alias("temporal_decay"),
        (F.col("frequency") * decay).alias("influence_weight"),
    )


def influence_filters(
    influence: DataFrame, min_frequency: float = 1.0, min_influence: float = 0.0, max_latency_seconds: float | None = None
) -> DataFrame:
    """Keep (from, to, distance) rows by frequency, smoothed weight and distance."""
    kept = influence.filter((F.col("frequency") >= min_frequency) & (F.col("smoothed_weight") >= min_influence))
    return kept if max_latency_seconds is None else kept.filter(F.col("delta_t") <= max_latency_seconds)


def smooth_and_filter(
    influence: DataFrame,
    epsilon: float = EPSILON,
    min_frequency: float = 1.0,
    min_influence: float = 0.0,
    max_latency_seconds: float | None = None,
) -> DataFrame:
    smoothed = influence.withColumn("smoothed_weight", F.col("influence_weight") + epsilon)
    return influence_filters(smoothed, min_frequency, min_influence, max_latency_seconds)


def influence_edges(filtered: DataFrame) -> DataFrame:
    """Edges of the influence network; ``delta_t`` and ``temporal_decay`` are means over distances."""
    return filtered.groupBy("graph_id", F.col("from_signal").alias("src"), F.col("to_signal").alias("dst")).agg(
        F.sum("smoothed_weight").alias("weight"),
        F.sum("influence_weight").alias("influence_weight"),
        F.sum("frequency").alias("frequency"),
        F.avg("delta_t").alias("delta_t"),
        F.avg("temporal_decay").alias("temporal_decay"),
    )


def influence_network(signals: DataFrame, latency_seconds: float = LATENCY_SECONDS, epsilon: float = EPSILON, **filters) -> DataFrame:
    """Signals to influence edges in one plan."""
    return influence_edges(smooth_and_filter(temporal_influence(signals, latency_seconds), epsilon, **filters))


def influence_matrix(edges: DataFrame, labels: list[str]) -> DataFrame:
    return adjacency_matrix(edges.select("graph_id", "src", "dst", "weight"), labels)


def influence_metrics(signals: DataFrame, latency_seconds: float = LATENCY_SECONDS, epsilon: float = EPSILON, **filters) -> DataFrame:
    """Per graph: events, entities, signals, relation counts, cycles and total weight."""
    influence = cut(temporal_influence(signals, latency_seconds)).df
    filtered = smooth_and_filter(influence, epsilon, **filters)
    edges = cut(influence_edges(filtered)).df
    # Count distinct entities and signals by counting groups, never a set in one task.
    per_entity = signals.groupBy("graph_id", "entity").agg(F.count(F.lit(1)).alias("_n"))
    events = per_entity.groupBy("graph_id").agg(F.sum("_n").alias("events"), F.count(F.lit(1)).alias("entities"))
    kinds = signals.select("graph_id", "signal").distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("signals"))
    raw = influence.groupBy("graph_id").agg(F.count(F.lit(1)).alias("raw_influence_relations"))
    kept = filtered.groupBy("graph_id").agg(F.count(F.lit(1)).alias("filtered_influence_relations"))
    net = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("temporal_relations"), F.sum("weight").alias("total_influence_weight"))
    cycles = is_dag(edges).select("graph_id", "has_cycles")
    out = events.join(kinds, "graph_id")
    for side in (raw, kept, net, cycles):
        out = out.join(side, "graph_id", "left")
    return out.na.fill(0).na.fill(False)
