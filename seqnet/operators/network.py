"""Sequences to weighted directed networks, and figures about networks.

An edge table has the columns ``graph_id, src, dst, weight``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqnet.operators.events import CASE, EVENT_ORDER, SINK, SOURCE, ordered
from seqnet.plans.ordering import CHUNK, HOT_ROWS, neighbours, with_chunks

PAIR = ["graph_id", "src", "dst"]
# Kinds of transition.
NORMAL, FROM_SOURCE, TO_SINK = "normal_transition", "source_transition", "sink_transition"


def transitions(events: DataFrame, hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """One row per change of item inside a case.

    A change from ``prev`` to ``item`` is exactly one step of the run-free sequence,
    so a single window is enough and no second pass renumbers the events.
    """
    rows = ordered(events, hot_rows, position=False, sizes=sizes).filter("prev <> item")
    return rows.select(*CASE, F.col("prev").alias("src"), F.col("item").alias("dst"))


def pair_frequencies(events: DataFrame, hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """The observed network: how often each item is followed by each other item.

    ``sizes`` (``graph_id, case_id, _n``) spares a pass that counts the rows of each case.
    """
    return transitions(events, hot_rows, sizes).groupBy(*PAIR).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def state_network(
    events: DataFrame, source: str = SOURCE, sink: str = SINK, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The observed network plus an edge into every first item and out of every last item."""
    chunked = with_chunks(events, CASE, EVENT_ORDER, hot_rows)
    rows = ordered(chunked, hot_rows, position=False)
    if CHUNK not in rows.columns:
        # A case counts when it holds two different items.
        case = Window.partitionBy(*CASE)
        rows = rows.withColumn("_ok", F.min("item").over(case) < F.max("item").over(case))
        rows = rows.filter("_ok")
        starts = F.col("prev").isNull()
        ends = F.col("next").isNull()
        step = F.array_compact(
            F.array(
                F.when(starts, F.struct(F.lit(source).alias("src"), F.col("item").alias("dst"), F.lit(FROM_SOURCE).alias("kind"))),
                F.when(
                    F.col("prev") != F.col("item"),
                    F.struct(F.col("prev").alias("src"), F.col("item").alias("dst"), F.lit(NORMAL).alias("kind")),
                ),
                F.when(ends, F.struct(F.col("item").alias("src"), F.lit(sink).alias("dst"), F.lit(TO_SINK).alias("kind"))),
            )
        )
        steps = rows.select("graph_id", F.inline(step))
        return steps.groupBy(*PAIR, "kind").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    rank = F.struct("ord", "tie", "item")
    ends = (
        events.groupBy(*CASE)
        .agg(F.min_by("item", rank).alias("a"), F.max_by("item", rank).alias("z"), F.min("item").alias("lo"), F.max("item").alias("hi"))
        .filter("lo < hi")
    )
    inside = rows.filter("prev <> item").select("graph_id", F.col("prev").alias("src"), F.col("item").alias("dst"), F.lit(NORMAL).alias("kind"))
    into = ends.select("graph_id", F.lit(source).alias("src"), F.col("a").alias("dst"), F.lit(FROM_SOURCE).alias("kind"))
    out = ends.select("graph_id", F.col("z").alias("src"), F.lit(sink).alias("dst"), F.lit(TO_SINK).alias("kind"))
    steps = inside.unionByName(into).unionByName(out)
    return steps.groupBy(*PAIR, "kind").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def start_end_network(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The state network with the older node names START and END."""
    return state_network(events, "START", "END", hot_rows)


def _steps(seqs: DataFrame) -> DataFrame:
    """Consecutive pairs of different items; equal neighbours are the runs that collapse."""
    pairs = seqs.filter(F.size("items") >= 2)
    last = F.size("items") - 1
    zipped = F.arrays_zip(F.slice("items", 1, last).alias("src"), F.slice("items", 2, last).alias("dst"))
    return pairs.select("graph_id", "seq_id", "weight", F.inline(zipped)).filter("src <> dst")


def sequence_transitions(seqs: DataFrame) -> DataFrame:
    """Steps of ``graph_id, seq_id, items, weight`` rows; no shuffle, the count stays a weight."""
    return _steps(seqs)


def sequence_network(seqs: DataFrame, virtual: bool = False) -> DataFrame:
    """Network of array sequences, optionally with the virtual nodes, weighted by ``weight``."""
    steps = _steps(seqs).drop("seq_id")
    if virtual:
        ends = F.array(
            F.struct(F.lit(SOURCE).alias("src"), F.element_at("items", 1).alias("dst")),
            F.struct(F.element_at("items", -1).alias("src"), F.lit(SINK).alias("dst")),
        )
        valid = seqs.filter(F.array_min("items") < F.array_max("items"))
        steps = steps.unionByName(valid.select("graph_id", "weight", F.inline(ends)))
    return steps.groupBy(*PAIR).agg(F.sum(F.col("weight").cast("double")).alias("weight"))


def observed_edges(edges: DataFrame) -> DataFrame:
    """Plain ``graph_id, src, dst, weight`` with parallel edges summed."""
    return edges.groupBy(*PAIR).agg(F.sum("weight").alias("weight"))


def drop_virtual(edges: DataFrame, names: tuple[str, ...] = (SOURCE, SINK)) -> DataFrame:
    return edges.filter(~F.col("src").isin(*names) & ~F.col("dst").isin(*names))


def top_edges(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` heaviest edges of each graph; ties by ``src, dst``."""
    order = Window.partitionBy("graph_id").orderBy(F.desc("weight"), "src", "dst")
    return edges.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n)


def top_transitions(edges: DataFrame, n: int = 5) -> DataFrame:
    return top_edges(edges, n).select(*PAIR, "weight", "rank")


def filter_edges(edges: DataFrame, min_weight: float | None = None, top_n: int | None = None) -> DataFrame:
    """Edges of at least ``min_weight`` (0 or None: no test), then the heaviest ``top_n`` per graph."""
    if min_weight:
        edges = edges.filter(F.col("weight") >= min_weight)
    return top_edges(edges, top_n).drop("rank") if top_n else edges


#: Fixed value: threshold of the strong network.
STRONG_WEIGHT = 20


def strong_edges(edges: DataFrame, threshold: float = STRONG_WEIGHT) -> DataFrame:
    return filter_edges(edges, min_weight=threshold)


def nodes_of(edges: DataFrame) -> DataFrame:
    """Distinct ``graph_id, node``."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node"))
    return ends.distinct()


def node_strength(edges: DataFrame) -> DataFrame:
    """Out and in weight and degree of every node; one shuffle, combined before it."""
    ends = edges.select(
        "graph_id",
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), F.col("weight").alias("o"), F.lit(0.0).alias("i"), F.lit(1).alias("od"), F.lit(0).alias("id")),
                F.struct(F.col("dst").alias("node"), F.lit(0.0).alias("o"), F.col("weight").alias("i"), F.lit(0).alias("od"), F.lit(1).alias("id")),
            )
        ),
    )
    return ends.groupBy("graph_id", "node").agg(
        F.sum("o").alias("out_weight"),
        F.sum("i").alias("in_weight"),
        F.sum("od").cast("long").alias("out_degree"),
        F.sum("id").cast("long").alias("in_degree"),
    )


def centrality(edges: DataFrame) -> DataFrame:
    """Strengths as a share of all weight, and the degree."""
    totals = edges.groupBy("graph_id").agg(F.sum("weight").alias("_total"))
    return (
        node_strength(edges)
        .join(totals, "graph_id")
        .select(
            "graph_id",
            "node",
            F.col("out_weight").alias("out_strength"),
            F.col("in_weight").alias("in_strength"),
            (F.col("out_weight") / F.col("_total") * 100).alias("out_relative_strength"),
            (F.col("in_weight") / F.col("_total") * 100).alias("in_relative_strength"),
            (F.col("out_degree") + F.col("in_degree")).alias("degree"),
        )
    )


def most_influential(edges: DataFrame) -> DataFrame:
    """Per graph the node with the largest out strength and the one with the largest in strength."""
    nodes = centrality(edges)
    return nodes.groupBy("graph_id").agg(
        F.max_by("node", F.struct("out_strength", "degree", "node")).alias("most_influential"),
        F.max("out_strength").alias("out_strength"),
        F.max_by("node", F.struct("in_strength", "degree", "node")).alias("most_received"),
        F.max("in_strength").alias("in_strength"),
    )


def relative_weight(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each edge's share of its origin's weight in percent, and its rank within the origin."""
    positive = edges.filter("weight > 0").select(*PAIR, "weight", (-F.col("weight")).alias("_order"))
    keys = ["graph_id", "src"]
    prepared = with_chunks(positive, keys, ["_order", "dst"], hot_rows)
    ranked = neighbours(prepared, keys, [F.col("_order"), F.col("dst")], "dst")
    totals = positive.groupBy(*keys).agg(F.sum("weight").alias("_total"))
    return ranked.join(totals, keys).select(
        *PAIR, "weight", (F.col("weight") / F.col("_total") * 100).alias("relative_weight"), F.col("pos").alias("rank")
    )


# When a network counts as dense.
DENSE_EDGES, DENSE_NODES, DENSE_DENSITY = 1000, 50, 0.2


def network_metrics(edges: DataFrame) -> DataFrame:
    """Nodes, edges, weight, density and average weight of each graph."""
    sizes = nodes_of(edges).groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
    sums = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("total_weight"))
    n, e = F.col("nodes"), F.col("edges")
    density = F.when(n > 1, e / (n * (n - 1))).otherwise(F.lit(0.0))
    return sums.join(sizes, "graph_id").select(
        "graph_id",
        "nodes",
        "edges",
        "total_weight",
        density.alias("density"),
        (F.col("total_weight") / e).alias("average_weight"),
        ((e > DENSE_EDGES) | ((n >= DENSE_NODES) & (density > DENSE_DENSITY))).alias("dense"),
    )


def adjacency_matrix(edges: DataFrame, labels: list[str]) -> DataFrame:
    """One row per origin and one column per label the caller names, 0 where there is no edge.

    The long form of the whole matrix, for any number of nodes, is the edge table itself.
    """
    rows = nodes_of(edges).withColumnRenamed("node", "src").join(observed_edges(edges), ["graph_id", "src"], "left")
    return rows.groupBy("graph_id", "src").pivot("dst", labels).agg(F.sum("weight")).na.fill(0.0)


def transition_matrix(edges: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """The matrix in long form, for graphs of any size.

    Without ``labels`` its cells that are not 0; with them, all cells between the nodes of each
    graph that the caller names, zeros included.
    """
    cells = observed_edges(edges)
    if labels is None:
        return cells
    kept = nodes_of(edges).filter(F.col("node").isin(labels)).withColumnRenamed("node", "src")
    rows = kept.withColumn("dst", F.explode(F.array(*[F.lit(label) for label in labels])))
    rows = rows.join(kept.withColumnRenamed("src", "dst"), ["graph_id", "dst"], "left_semi")
    return rows.join(cells, PAIR, "left").select(*PAIR, F.coalesce("weight", F.lit(0.0)).alias("weight"))


def matrix_to_edges(matrix: DataFrame, origin: str, graph: str | None = None) -> DataFrame:
    """Wide matrix to edges of positive weight; cells that are no number count as 0."""
    keys = [*([graph] if graph else []), origin]
    cells = matrix.select(*keys, *[F.col(f"`{c}`").cast("string").alias(c) for c in matrix.columns if c not in keys])
    long = cells.unpivot(keys, None, "dst", "weight")
    weight = F.coalesce(F.col("weight").try_cast("double"), F.lit(0.0))
    return long.select(
        (F.col(graph) if graph else F.lit("all")).alias("graph_id"), F.col(origin).alias("src"), "dst", weight.alias("weight")
    ).filter("weight > 0")


def merge_flow_edges(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Merged positive edges with trimmed ends for flow tables, heaviest ``limit`` per graph."""
    clean = edges.select("graph_id", F.trim("src").alias("src"), F.trim("dst").alias("dst"), "weight")
    merged = observed_edges(clean.filter("src <> '' and dst <> '' and weight > 0"))
    return filter_edges(merged, top_n=limit)
