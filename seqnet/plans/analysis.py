"""Whole analyses: from events to networks, structures, their validation and comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqnet.operators import influence as inf
from seqnet.operators import influence_trees as it
from seqnet.operators import metrics as me
from seqnet.operators import network as nw
from seqnet.operators import trees as tr
from seqnet.plans.lineage import cut, keep


@dataclass
class SequenceAnalysis:
    """Networks of an event table, the three structures, and one row per structure and graph."""

    states: DataFrame
    network: DataFrame
    branching: DataFrame
    forward: DataFrame
    polytree: DataFrame
    checks: dict[str, DataFrame]
    comparison: DataFrame
    ranking: DataFrame


def analyse_sequences(events: DataFrame) -> SequenceAnalysis:
    """Events to the state and observed networks, the three structures, validation and ranking."""
    events = keep(events)
    states, net = keep(nw.observed_edges(nw.state_network(events))), keep(nw.pair_frequencies(events))
    state_roots, roots, starts = keep(tr.choose_root_2007(states)), keep(tr.choose_root_forward(net)), keep(tr.start_edges(net))
    branching = keep(tr.max_rooted_branching(states, state_roots))
    forward, polytree = keep(tr.forward_tree(net, roots)), keep(tr.back_forward_polytree(net))
    checks = {
        me.METHODS[0]: me.validate_branching(branching, state_roots, states),
        me.METHODS[1]: me.validate_forward(forward, roots, net),
        me.METHODS[2]: me.validate_polytree(polytree, net),
    }
    anchor = F.col("root").alias("anchor")
    rows = [
        me.method_row(me.METHODS[0], states, branching, state_roots.select("graph_id", anchor)),
        me.method_row(me.METHODS[1], net, forward, roots.select("graph_id", anchor)),
        me.method_row(me.METHODS[2], net, polytree, starts.select("graph_id", F.concat_ws(" -> ", "src", "dst").alias("anchor"))),
    ]
    comparison = cut(me.compare_methods(rows)).df
    return SequenceAnalysis(states, net, branching, forward, polytree, checks, comparison, me.rank_methods(comparison))


@dataclass
class InfluenceAnalysis:
    """Influence edges of signals, their figures, the structure taken from them and its summary."""

    edges: DataFrame
    metrics: DataFrame
    structure: DataFrame
    summary: DataFrame


def analyse_influence(signals: DataFrame, latency_seconds: float = inf.LATENCY_SECONDS, force: str = "auto", **filters) -> InfluenceAnalysis:
    """Prepared signals to influence edges (first phase) and a tree or poly-tree of them (second phase)."""
    signals = keep(signals)
    edges = keep(inf.influence_network(signals, latency_seconds, **filters).select(*nw.PAIR, "weight"))
    structure = keep(it.extract_structure(edges, force))
    return InfluenceAnalysis(edges, inf.influence_metrics(signals, latency_seconds, **filters), structure, it.structure_summary(edges, structure))
