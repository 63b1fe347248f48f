"""One named query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqnet.catalog.inputs import (
    EVENT_TYPES,
    brand_events,
    brand_network,
    brand_pairs,
    brand_states,
    influence_net,
    influence_rows,
    order_chains,
    order_events,
    role_events,
    scratch,
    segment_events,
    segment_network,
    segment_states,
    signals,
    strong_brands,
    table,
    token_sequences,
    user_events,
    user_network,
)
from seqnet.functions import discretize, text
from seqnet.operators import events as ev
from seqnet.operators import graph as gr
from seqnet.operators import influence as inf
from seqnet.operators import influence_trees as it
from seqnet.operators import metrics as me
from seqnet.operators import network as nw
from seqnet.operators import polytree as pt
from seqnet.operators import trees as tr
from seqnet.plans import analysis
from seqnet.plans.lineage import keep
from seqnet.plans.ordering import as_number
from seqnet.sources import readers as rd
from seqnet.sources.writers import write_tables
from seqnet.streaming import network as sn

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; -0.0 becomes 0.0."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in doubles})


# --- sources and sinks ----------------------------------------------------------


@query
def read_table(spark, folder):
    path = write_tables({"orders.csv": table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")}, scratch(spark), "csv")
    df = rd.read_table(spark, path["orders.csv"])
    return df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))


@query
def write_tables_by_graph(spark, folder):
    net = segment_network(spark, folder)
    path = write_tables({"edges": net}, scratch(spark))
    return spark.read.schema(net.schema).parquet(path["edges"]).select(*nw.PAIR, "weight")


@query
def profile_columns(spark, folder):
    return rounded(rd.profile_columns(table(spark, folder, "conversations")))


@query
def profile_distinct(spark, folder):
    return rd.profile_columns(table(spark, folder, "orders")).select("column", "distinct_count")


def _role_lines(spark, folder):
    """Role sequences of conversations as text with the number of conversations that share them."""
    seqs = ev.case_sequences(role_events(spark, folder))
    lines = seqs.groupBy("sequence").agg(F.count(F.lit(1)).alias("n"))
    return lines.select(F.lit("all").alias("graph_id"), F.xxhash64("sequence").alias("seq_id"), F.concat_ws(",", "sequence", F.col("n").cast("string")).alias("value"))


@query
def read_weighted_sequences(spark, folder):
    return nw.sequence_network(rd.parse_weighted_sequences(_role_lines(spark, folder), counted=True), virtual=True)


def _number_lines(spark, folder):
    """Part keys of each order as one line, followed by the lines of all documents as noise."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    packed = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    orders = packed.select(F.lit("all").alias("graph_id"), (F.col("l_orderkey") + 1).alias("seq_id"), F.concat_ws(" ", F.transform("s", lambda x: x["l_partkey"].cast("string"))).alias("value"))
    docs = table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    noise = docs.select(F.lit("all").alias("graph_id"), (F.col("doc_id") + 1_000_000_000_000).alias("seq_id"), "value")
    return orders.unionByName(noise)


@query
def read_numeric_sequences(spark, folder):
    sequences, rejects = rd.parse_numeric_sequences(_number_lines(spark, folder))
    good = sequences.agg(F.lit("sequences").alias("kind"), F.count(F.lit(1)).alias("lines"), F.sum(F.size("items")).alias("items"))
    bad = rejects.agg(F.lit("rejects").alias("kind"), F.count(F.lit(1)).alias("lines"), F.lit(0).cast("long").alias("items"))
    return good.unionByName(bad)


def _log_lines(spark, folder):
    """Conversations as a text log: a header line, then ``e case order event flag`` lines."""
    roles = F.when(F.col("role") == "system", "1").when(F.col("role") == "user", "2").otherwise("3")
    conv = table(spark, folder, "conversations", "conv_id", "turn", "role")
    rows = conv.select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("seq_id"),
        F.concat_ws("  ", F.lit("e"), F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string"), roles, F.lit("0")).alias("value"),
    )
    per_case = conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    head = per_case.agg(F.concat_ws(" ", F.lit("p"), F.count(F.lit(1)).cast("string"), F.sum("n").cast("string")).alias("value"))
    return rows.unionByName(head.select(F.lit(-1).cast("long").alias("seq_id"), "value"))


@query
def read_event_log(spark, folder):
    return rd.event_log_events(rd.parse_event_log(_log_lines(spark, folder)))


@query
def event_log_header(spark, folder):
    return rd.event_log_header(rd.parse_event_log(_log_lines(spark, folder)))


@query
def read_sequence_csv(spark, folder):
    seqs = ev.case_sequences(role_events(spark, folder)).select(F.col("case_id").cast("string").alias("Sequence ID"), F.col("sequence").alias("Sequence"))
    path = write_tables({"sequences.csv": seqs}, scratch(spark), "csv")["sequences.csv"]
    return rd.sequence_events(rd.read_sequence_csv(spark, path)).select("case_id", "ord", "item")


@query
def read_event_table(spark, folder):
    rows = user_events(spark, folder)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ord"))
    return rows.select("case_id", micros.alias("micros"), "item")


def _transactions(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return orders.select(
        F.col("o_custkey").alias("Customer ID"), F.col("o_orderdate").alias("Order Date"), F.col("o_orderpriority").alias("Category"), F.col("o_orderkey"), F.lit(1).alias("Unnamed: 0")
    )


@query
def read_transactions(spark, folder):
    return nw.pair_frequencies(rd.read_transactions(_transactions(spark, folder), source_order="o_orderkey"))


@query
def transaction_quality(spark, folder):
    return rd.transaction_quality(_transactions(spark, folder))


def _nation_flows(spark, folder):
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey")
    suppliers = table(spark, folder, "supplier", "s_suppkey", "s_nationkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("s_nationkey").alias("From"), F.col("c_nationkey").alias("To"), F.col("l_quantity").cast("string").alias("Weight"))


@query
def read_edges(spark, folder):
    return rd.read_edges(_nation_flows(spark, folder), allow_self_loops=False)


@query
def read_pair_frequencies(spark, folder):
    orders = table(spark, folder, "orders", "o_orderstatus", "o_orderpriority")
    return rd.read_pair_frequencies(orders.select(F.col("o_orderstatus").alias("Source"), F.col("o_orderpriority").alias("Target"), F.lit("1").alias("Frequency")))


@query
def matrix_to_edges(spark, folder):
    return rd_matrix(nw.adjacency_matrix(user_network(spark, folder), EVENT_TYPES))


def rd_matrix(matrix: DataFrame) -> DataFrame:
    return nw.matrix_to_edges(matrix, "src", "graph_id")


@query
def adapt_edge_columns(spark, folder):
    rows = inf.smooth_and_filter(influence_rows(spark, folder))
    named = rows.select(F.col("from_signal").alias("Source"), F.col("to_signal").alias("TARGET"), F.col("smoothed_weight").alias("Smoothed_Weight"), "influence_weight", F.col("frequency").cast("string").alias("Frequency"), F.col("delta_t").alias("avg_delta_t"))
    return rounded(rd.adapt_edge_columns(named))


# --- projections and filters -----------------------------------------------------


@query
def clean_text(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    return docs.select("doc_id", F.length(text.clean_text("text")).cast("long").alias("chars"), text.clean_text(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), "source", F.lit("\t"))).otherwise(" NaN ")).alias("label"))


@query
def min_length(spark, folder):
    runs = ev.dedup_consecutive(order_events(spark, folder))
    return ev.min_length(runs).groupBy("graph_id", "case_id").agg(F.count(F.lit(1)).alias("events"))


@query
def filter_edges(spark, folder):
    return nw.filter_edges(brand_network(spark, folder), min_weight=5, top_n=30)


@query
def strong_edges(spark, folder):
    return nw.strong_edges(brand_network(spark, folder))


@query
def drop_virtual(spark, folder):
    return nw.drop_virtual(segment_states(spark, folder))


@query
def influence_filters(spark, folder):
    rows = influence_rows(spark, folder).withColumn("smoothed_weight", F.col("influence_weight") + inf.EPSILON)
    kept = inf.influence_filters(rows, min_frequency=1, min_influence=0.0105, max_latency_seconds=1800.0)
    return rounded(kept.select("from_signal", "to_signal", "dt", "frequency", "smoothed_weight"), 9)


@query
def valid_ratio_gate(spark, folder):
    """Orders whose date arrives as text: the 80 % test passes and all rows stay."""
    orders = table(spark, folder, "orders").withColumn("date_text", F.col("o_orderdate").cast("string"))
    return ev.event_table(orders, "o_custkey", "date_text", "o_orderpriority").groupBy("item").agg(F.count(F.lit(1)).alias("events"))


@query
def reachable_subgraph(spark, folder):
    net = brand_network(spark, folder)
    return gr.reachable_subgraph(net, tr.as_nodes(tr.choose_root_forward(net)))


# --- sequences and scalar functions -------------------------------------------------


def _fused(spark, folder, **kwargs):
    events = table(spark, folder, "events", "user_id", "ts", "event_type", "value", "event_id")
    parts = ["event_type", "value", "event_id"]
    return ev.build_events(events, "ts", parts, case="user_id", **kwargs)


@query
def build_events(spark, folder):
    rows, _ = _fused(spark, folder, discretization={"value": "quantile"})
    return rows.groupBy("case_id", "item").agg(F.count(F.lit(1)).alias("events"))


@query
def build_window_events(spark, folder):
    events = table(spark, folder, "events", "user_id", "ts", "event_type", "value")
    rows, _ = ev.build_events(events, "ts", ["event_type", "value"], case_window="weekly", discretization={"value": "variation_pct"})
    return nw.pair_frequencies(rows)


@query
def sanitize_event(spark, folder):
    return table(spark, folder, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", text.sanitize_event(F.concat_ws(" / ", "p_name", "p_brand")).alias("label"))


@query
def discretize_quantile(spark, folder):
    events = table(spark, folder, "events", "event_id", "value")
    cuts = discretize.quantile_cuts(events, "value")
    return events.groupBy(discretize.quantile_label("value", cuts).alias("label")).agg(F.count(F.lit(1)).alias("events"))


@query
def discretize_variation(spark, folder):
    change = (F.col("l_discount") - F.col("l_tax")) * 100
    lines = table(spark, folder, "lineitem", "l_discount", "l_tax")
    return lines.groupBy(discretize.variation_label(F.round(change, 4)).alias("label")).agg(F.count(F.lit(1)).alias("lines"))


@query
def window_case_id(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderdate")
    return orders.select("o_orderkey", *[discretize.window_case_id("o_orderdate", w).alias(w) for w in ("daily", "weekly", "monthly", "quarterly")])


@query
def parse_order(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderdate", "o_orderstatus")
    mixed = F.when(F.col("o_orderstatus") == "P", F.col("o_orderstatus")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    when = discretize.parse_order(mixed, as_date=True)
    number = discretize.parse_order(F.when(F.col("o_orderstatus") == "F", F.lit("x")).otherwise(F.col("o_orderkey").cast("string")), as_date=False)
    return orders.select("o_orderkey", F.date_format(when, "yyyy-MM-dd").alias("day"), number.alias("number"))


@query
def order_kind(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderpriority", "o_totalprice"
    )
    return spark.createDataFrame([(c, discretize.order_kind(orders, c)) for c in orders.columns], "column string, kind string")


@query
def order_events_by_user(spark, folder):
    return ev.order_events(user_events(spark, folder)).select("case_id", "item", "pos")


@query
def dedup_consecutive(spark, folder):
    return ev.dedup_consecutive(brand_events(spark, folder)).groupBy("graph_id", "case_id").agg(F.count(F.lit(1)).alias("events"))


@query
def next_item(spark, folder):
    return ev.next_item(user_events(spark, folder)).select("case_id", "item", "next_item", "pos")


@query
def case_sequences(spark, folder):
    return ev.case_sequences(order_events(spark, folder)).select("case_id", "sequence", "length")


@query
def sequence_stats(spark, folder):
    return rounded(ev.sequence_stats(brand_events(spark, folder)))


@query
def log_consistency(spark, folder):
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber")
    return ev.log_consistency(lines, "l_orderkey", "l_linenumber")


@query
def same_time_ties(spark, folder):
    return ev.same_time_ties(order_events(spark, folder))


@query
def event_vocabulary(spark, folder):
    rows = rd.sequence_events(token_sequences(spark, folder))
    return ev.event_vocabulary(rows)


@query
def clean_number(spark, folder):
    orders = table(spark, folder, "orders", "o_orderstatus", "o_totalprice")
    value = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return orders.groupBy("o_orderstatus").agg(F.round(F.sum(text.clean_number(value)), 2).alias("total"), F.sum(text.clean_integer(value, -1)).alias("whole"))


# --- networks ------------------------------------------------------------------------


@query
def transitions(spark, folder):
    return nw.transitions(user_events(spark, folder)).groupBy("case_id", "src", "dst").agg(F.count(F.lit(1)).alias("steps"))


@query
def pair_frequencies(spark, folder):
    return nw.pair_frequencies(user_events(spark, folder))


@query
def streamed_pair_frequencies(spark, folder):
    """The same network kept up to date by a stream: four stretches of time arrive one after the other."""
    events, place = user_events(spark, folder), scratch(spark)
    at = events.withColumn("_at", as_number(events, "ord"))
    marks = at.approxQuantile("_at", [0.25, 0.5, 0.75], 0.01)
    for low, high in zip([float("-inf"), *marks], [*marks, float("inf")], strict=True):
        part = at.filter((F.col("_at") >= low) & (F.col("_at") < high)).drop("_at")
        part.write.mode("append").parquet(f"{place}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{place}/events")
        sn.maintain(stream, f"{place}/counts", f"{place}/checkpoint").awaitTermination()
    return sn.network(spark, f"{place}/counts")


@query
def brand_pair_frequencies(spark, folder):
    return brand_pairs(spark, folder)


@query
def token_network(spark, folder):
    return nw.sequence_network(token_sequences(spark, folder))


@query
def sequence_transitions(spark, folder):
    return nw.sequence_transitions(token_sequences(spark, folder)).groupBy("graph_id", "seq_id").agg(F.sum("weight").alias("steps"))


@query
def state_network(spark, folder):
    return nw.state_network(segment_events(spark, folder))


@query
def start_end_network(spark, folder):
    return nw.start_end_network(order_events(spark, folder))


@query
def adjacency_matrix(spark, folder):
    return nw.adjacency_matrix(user_network(spark, folder), EVENT_TYPES)


@query
def transition_matrix(spark, folder):
    return nw.transition_matrix(segment_network(spark, folder), EVENT_TYPES)


@query
def top_transitions(spark, folder):
    return nw.top_transitions(brand_network(spark, folder), 5)


@query
def node_strength(spark, folder):
    return nw.node_strength(brand_network(spark, folder))


@query
def centrality(spark, folder):
    return rounded(nw.centrality(brand_network(spark, folder)))


@query
def relative_weight(spark, folder):
    return rounded(nw.relative_weight(brand_network(spark, folder)))


@query
def network_metrics(spark, folder):
    return rounded(nw.network_metrics(brand_network(spark, folder)))


@query
def most_influential(spark, folder):
    return nw.most_influential(brand_network(spark, folder))


@query
def merge_flow_edges(spark, folder):
    flows = _nation_flows(spark, folder).select(F.lit("all").alias("graph_id"), F.concat(F.lit(" n"), F.col("From").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("To").cast("string"), F.lit(" ")).alias("dst"), F.col("Weight").cast("double").alias("weight"))
    return nw.merge_flow_edges(flows, limit=100)


# --- joins -------------------------------------------------------------------------------


@query
def latency_pairs(spark, folder):
    pairs = inf.latency_pairs(signals(spark, folder), 86400.0)
    return pairs.groupBy("from_signal", "to_signal").agg(F.sum("n").alias("pairs"))


@query
def frontier_levels(spark, folder):
    net = brand_network(spark, folder)
    return gr.hops(net, tr.as_nodes(tr.choose_root_forward(net))).df


@query
def uncovered_nodes(spark, folder):
    return me.uncovered_nodes(brand_network(spark, folder), strong_brands(spark, folder))


@query
def reverse_edge_lookup(spark, folder):
    net = segment_network(spark, folder)
    back = net.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("reverse_weight"))
    return net.join(back, nw.PAIR, "left")


# --- temporal influence ---------------------------------------------------------------------


@query
def prepare_signals(spark, folder):
    return signals(spark, folder).select("entity", "signal", "event_index", "t", "order_kind")


@query
def signal_counter(spark, folder):
    events = table(spark, folder, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    counted = inf.signal_counter(inf.prepare_signals(events, "o_custkey", "day", "o_orderpriority"))
    return counted.select("entity", "time", "signal", "signal_counter")


@query
def temporal_influence(spark, folder):
    rows = influence_rows(spark, folder)
    return rounded(rows.select("from_signal", "to_signal", "dt", "frequency", "temporal_decay", "influence_weight"), 9)


@query
def temporal_influence_day(spark, folder):
    rows = influence_rows(spark, folder, 86400.0)
    return rounded(rows.groupBy("from_signal", "to_signal").agg(F.count(F.lit(1)).alias("distances"), F.sum("frequency").alias("frequency"), F.sum("influence_weight").alias("influence_weight")))


@query
def smooth_and_filter(spark, folder):
    rows = inf.smooth_and_filter(influence_rows(spark, folder), epsilon=0.05, min_influence=0.051)
    return rounded(rows.select("from_signal", "to_signal", "dt", "frequency", "smoothed_weight"), 9)


@query
def influence_edges(spark, folder):
    return rounded(inf.influence_network(signals(spark, folder)))


@query
def influence_matrix(spark, folder):
    return rounded(inf.influence_matrix(influence_net(spark, folder), EVENT_TYPES))


@query
def influence_metrics(spark, folder):
    return rounded(inf.influence_metrics(signals(spark, folder)))


@query
def positional_events(spark, folder):
    rows = inf.positional_events(segment_events(spark, folder))
    return rounded(inf.influence_network(rows, latency_seconds=10.0))


# --- structures ------------------------------------------------------------------------------


@query
def choose_root_2007(spark, folder):
    roots = tr.choose_root_2007(segment_states(spark, folder))
    plain = tr.choose_root_2007(brand_network(spark, folder))
    return roots.withColumn("network", F.lit("states")).unionByName(plain.withColumn("network", F.lit("brands")))


@query
def choose_root_forward(spark, folder):
    return tr.choose_root_forward(brand_network(spark, folder))


@query
def choose_root_greedy(spark, folder):
    return tr.choose_root_greedy(brand_network(spark, folder))


@query
def infer_initial_node(spark, folder):
    net = brand_network(spark, folder)
    modes = [it.infer_initial_node(net, f).withColumn("force", F.lit(f)) for f in it.HEURISTICS]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


@query
def max_rooted_branching(spark, folder):
    states = segment_states(spark, folder)
    tree = keep(tr.max_rooted_branching(states))
    size = tree.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))
    return size


@query
def brand_rooted_branching(spark, folder):
    """Branchings of networks of brands; weight and validity do not depend on ties."""
    states = brand_states(spark, folder)
    roots = keep(tr.choose_root_2007(states))
    return rounded(me.validate_branching(tr.max_rooted_branching(states, roots), roots, states))


@query
def forward_tree(spark, folder):
    return tr.forward_tree(brand_network(spark, folder))


@query
def tree_levels(spark, folder):
    return tr.tree_levels(keep(tr.forward_tree(brand_network(spark, folder))))


@query
def tree_nodes(spark, folder):
    return tr.tree_nodes(keep(tr.forward_tree(brand_network(spark, folder))))


@query
def greedy_tree(spark, folder):
    return tr.greedy_tree(brand_network(spark, folder))


@query
def expand_paths(spark, folder):
    return tr.expand_paths(keep(tr.forward_tree(brand_network(spark, folder)))).drop("items")


@query
def expansion_metrics(spark, folder):
    return rounded(tr.expansion_metrics(keep(tr.forward_tree(brand_network(spark, folder)))))


@query
def dominant_path(spark, folder):
    return tr.dominant_path(keep(tr.forward_tree(brand_network(spark, folder))))


@query
def back_forward_polytree(spark, folder):
    return tr.back_forward_polytree(brand_network(spark, folder)).select(*nw.PAIR, "weight", "direction")


@query
def polytree_levels(spark, folder):
    return tr.back_forward_polytree(segment_network(spark, folder))


@query
def back_forward_legacy(spark, folder):
    net = keep(nw.observed_edges(nw.start_end_network(segment_events(spark, folder))))
    return tr.back_forward_legacy(net).select(*nw.PAIR, "weight", "direction")


@query
def topk_polytree(spark, folder):
    net = segment_network(spark, folder)
    return pt.topk_polytree(net, tr.choose_root_greedy(net))


@query
def brand_topk_polytree(spark, folder):
    net = brand_network(spark, folder)
    return pt.topk_polytree(net, tr.choose_root_greedy(net))


@query
def multiobjective_polytree(spark, folder):
    net = brand_network(spark, folder)
    return pt.multiobjective_polytree(net, tr.choose_root_greedy(net, gr.pagerank(net)))


@query
def collapse_polytree(spark, folder):
    net = segment_network(spark, folder)
    return pt.collapse_polytree(pt.topk_polytree(net, tr.choose_root_greedy(net)))


@query
def forum_forward_tree(spark, folder):
    net = brand_network(spark, folder)
    return it.forum_forward_tree(net, it.infer_initial_node(net, "forward")).select(*nw.PAIR, "weight", "level")


@query
def forum_forward_tree_top3(spark, folder):
    net = brand_network(spark, folder)
    return it.forum_forward_tree(net, it.infer_initial_node(net, "forward"), top_k=3).select(*nw.PAIR, "weight", "level")


@query
def forum_polytree(spark, folder):
    return it.forum_polytree(segment_network(spark, folder))


@query
def forum_polytree_capped(spark, folder):
    return it.forum_polytree(segment_network(spark, folder), max_depth=1, max_edges=3)


@query
def simplified_influence(spark, folder):
    return rounded(it.simplified_influence(segment_network(spark, folder)))


@query
def greedy_walks(spark, folder):
    return rounded(it.greedy_walks(brand_network(spark, folder)))


@query
def forward_dominant_walk(spark, folder):
    net = brand_network(spark, folder)
    roots = keep(tr.choose_root_forward(net))
    return it.forward_dominant_walk(keep(tr.forward_tree(net, roots)), roots)


@query
def polytree_dominant_path(spark, folder):
    steps = it.polytree_dominant_path(it.forum_polytree(segment_network(spark, folder)))
    return steps.groupBy("graph_id").agg(F.count(F.lit(1)).alias("steps"), F.sum("weight").alias("path_weight"))


@query
def extract_structure(spark, folder):
    net = brand_network(spark, folder)
    return rounded(it.structure_summary(net, it.extract_structure(net)))


# --- graph analytics and validation -------------------------------------------------------------


@query
def is_dag(spark, folder):
    return gr.is_dag(brand_network(spark, folder))


@query
def reachable_all(spark, folder):
    net = brand_network(spark, folder)
    return gr.reachable_all(net, tr.as_nodes(tr.choose_root_forward(net)))


@query
def weak_components(spark, folder):
    return gr.weak_components(brand_network(spark, folder))


@query
def graph_summary(spark, folder):
    return rounded(gr.graph_summary(brand_network(spark, folder)))


@query
def pagerank(spark, folder):
    return rounded(gr.pagerank(user_network(spark, folder)), 4)


@query
def betweenness(spark, folder):
    return rounded(gr.betweenness(segment_network(spark, folder)))


@query
def brand_betweenness(spark, folder):
    return rounded(gr.betweenness(brand_network(spark, folder)))


@query
def brand_pagerank(spark, folder):
    return rounded(gr.pagerank(brand_network(spark, folder)))


@query
def strong_components(spark, folder):
    """Brands follow each other in circles; SOURCE and SINK stay alone."""
    return gr.strong_components(brand_states(spark, folder))


@query
def order_chain_levels(spark, folder):
    """Place of every order in its customer's chain of orders, from the first ones on: many deep chains in a graph."""
    net = order_chains(spark, folder)
    later = net.select("graph_id", F.col("dst").alias("node"))
    first = net.select("graph_id", F.col("src").alias("node")).join(later, ["graph_id", "node"], "left_anti")
    return gr.hops(net, first).df


@query
def order_ring_is_dag(spark, folder):
    """The chains of orders, and in one segment the way back from the last order of the longest chain to its first."""
    net = order_chains(spark, folder)
    own = net.filter("graph_id = 'BUILDING'")
    longest = own.groupBy("chain").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "chain").limit(1).select("chain")
    ring = own.join(longest, "chain", "left_semi")
    last = ring.join(ring.select(F.col("src").alias("dst")), "dst", "left_anti").select("chain", F.col("dst").alias("src"))
    first = ring.join(ring.select(F.col("dst").alias("src")), "src", "left_anti").select("chain", F.col("src").alias("dst"))
    back = last.join(first, "chain").select(F.lit("BUILDING").alias("graph_id"), "src", "dst", F.lit(1.0).alias("weight"))
    return gr.is_dag(net.drop("chain").unionByName(back))


@query
def validate_observed(spark, folder):
    return rounded(me.validate_observed(brand_network(spark, folder)))


@query
def validate_branching(spark, folder):
    states = segment_states(spark, folder)
    roots = keep(tr.choose_root_2007(states))
    return rounded(me.validate_branching(tr.max_rooted_branching(states, roots), roots, states))


@query
def validate_forward(spark, folder):
    net = brand_network(spark, folder)
    roots = keep(tr.choose_root_forward(net))
    return rounded(me.validate_forward(tr.forward_tree(net, roots), roots, net))


@query
def validate_polytree(spark, folder):
    net = brand_network(spark, folder)
    return rounded(me.validate_polytree(tr.back_forward_polytree(net), net))


@query
def coverage(spark, folder):
    net = brand_network(spark, folder)
    strong = keep(nw.filter_edges(net, top_n=30))
    return rounded(me.coverage(net, strong, keep(tr.forward_tree(strong))))


@query
def polytree_metrics(spark, folder):
    net = segment_network(spark, folder)
    return rounded(me.polytree_metrics(net, pt.topk_polytree(net, tr.choose_root_greedy(net))))


@query
def weight_by_level(spark, folder):
    net = segment_network(spark, folder)
    return me.weight_by_level(pt.topk_polytree(net, tr.choose_root_greedy(net)))


@query
def condensation_metrics(spark, folder):
    net = brand_network(spark, folder)
    return rounded(me.condensation_metrics(net, keep(tr.forward_tree(net))))


@query
def node_levels(spark, folder):
    net = segment_network(spark, folder)
    roots = keep(tr.choose_root_greedy(net))
    return pt.node_levels(pt.topk_polytree(net, roots), roots)


@query
def tree_center(spark, folder):
    return me.tree_center(tr.back_forward_polytree(brand_network(spark, folder)))


@query
def graph_center(spark, folder):
    return me.graph_center(brand_network(spark, folder))


@query
def compare_methods(spark, folder):
    return rounded(analysis.analyse_sequences(segment_events(spark, folder)).comparison)


@query
def rank_methods(spark, folder):
    return rounded(analysis.analyse_sequences(segment_events(spark, folder)).ranking)


@query
def classify_structure(spark, folder):
    net = brand_network(spark, folder)
    both = me.compare_networks(net, keep(tr.forward_tree(net)))
    return me.classify_structure(both).select("graph_id", "structure")


@query
def classify_network(spark, folder):
    metrics = nw.network_metrics(brand_network(spark, folder))
    return me.classify_scenario(me.classify_network(metrics)).select("graph_id", "recurrence", "scenario")


@query
def compare_networks(spark, folder):
    net = brand_network(spark, folder)
    return rounded(me.compare_networks(net, keep(tr.forward_tree(net))))
