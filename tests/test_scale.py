"""Hot groups, order chunks, exact figures, and inputs that must not be dropped."""

import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqnet.functions.discretize import exact_quantiles
from seqnet.operators import events as ev
from seqnet.operators import graph as gr
from seqnet.operators import influence as inf
from seqnet.operators import influence_trees as it
from seqnet.operators import network as nw
from seqnet.operators import polytree as pt
from seqnet.operators import trees as tr
from seqnet.plans import analysis
from seqnet.plans.ordering import CHUNK, with_chunks
from seqnet.sources import readers as rd
from seqnet.sources.writers import write_tables

EVENTS = "graph_id string, case_id string, ord int, tie int, item string"
EDGES = "graph_id string, src string, dst string, weight double"


def test_chunks_split_ties_prefixes_and_ranges(spark):
    """Equal orders, labels with a common prefix, and hot groups of other ranges: no chunk is large."""
    rows = [("g", "tied", 7, 0, f"i{i % 3}") for i in range(3000)]
    rows += [("g", "brands", 1, 0, f"Brand#{i:05d}") for i in range(3000)]
    rows += [("g", "early", i, 0, "x") for i in range(2000)] + [("g", "late", 10_000_000 + i, 0, "y") for i in range(2000)]
    rows += [("g", f"small{i}", 1, 0, "z") for i in range(50)]
    df = spark.createDataFrame(rows, EVENTS).repartition(6)
    chunked = with_chunks(df, ev.CASE, ev.EVENT_ORDER, 500)
    sizes = chunked.filter(F.col(CHUNK) > 0).groupBy("case_id", CHUNK).count().collect()
    assert max(r["count"] for r in sizes) <= 750
    assert chunked.count() == len(rows)
    assert {r["case_id"] for r in sizes} == {"tied", "brands", "early", "late"}
    plain = ev.order_events(df).select("case_id", "pos", "item").collect()
    assert sorted(map(tuple, ev.order_events(df, 500).select("case_id", "pos", "item").collect())) == sorted(map(tuple, plain))
    assert sorted(map(tuple, nw.pair_frequencies(df, 500).collect())) == sorted(map(tuple, nw.pair_frequencies(df).collect()))


def test_hub_of_equal_weights_is_ranked_in_chunks(spark):
    edges = spark.createDataFrame([("g", "hub", f"n{i:04d}", 1.0) for i in range(2000)], EDGES)
    got = nw.relative_weight(edges, 300).collect()
    assert {(r["dst"], r["rank"]) for r in got} == {(f"n{i:04d}", i + 1) for i in range(2000)}


def test_hot_latency_bucket_in_stretches(spark):
    """All pieces of a bucket stay below the limit, and the pairs are those of one piece."""
    rng = random.Random(2)
    times = sorted(rng.sample(range(100_000), 1500))
    rows = [("e", t, rng.choice("ab")) for t in times]
    signals = spark.createDataFrame([("all", e, float(t), s, i, "numeric", t * 1_000_000) for i, (e, t, s) in enumerate(rows)],
                                    "graph_id string, entity string, time double, signal string, event_index int, order_kind string, t long")
    want = {}
    for (_, t, a), (_, u, b) in itertools.combinations(rows, 2):
        if u - t <= 5000:
            want[a, b] = want.get((a, b), 0) + 1
    for limit in (100, 1_000_000):
        pairs = inf.latency_pairs(signals, 5000.0, limit)
        assert {(r["from_signal"], r["to_signal"]): r["n"] for r in pairs.groupBy("from_signal", "to_signal").agg(F.sum("n").alias("n")).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_are_exact(spark, seed):
    rng = np.random.default_rng(seed)
    values = {"a": rng.normal(size=700), "b": rng.integers(0, 5, 700).astype(float), "c": np.exp(rng.normal(size=700) * 40)}
    rows = list(zip(*[v.tolist() for v in values.values()], strict=True)) + [(None, float("nan"), 1.0)]
    shares = [0.0, 0.1, 1 / 3, 0.5, 2 / 3, 0.99, 1.0]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = exact_quantiles(df, {c: F.col(c) for c in values}, shares)
    values["c"] = np.append(values["c"], 1.0)
    for name, numbers in values.items():
        assert np.allclose(got[name], np.quantile(numbers, shares), rtol=1e-12)
    assert exact_quantiles(df, {"n": F.lit(None).cast("double")}, shares) == {"n": None}


def test_header_words_are_data_below_the_first_line(spark, tmp_path):
    lines = [(0, "sequence,count"), (1, "a b"), (4, "seq"), (5, "freq,n"), (6, "c d")]
    df = spark.createDataFrame([("g", i, v) for i, v in lines], "graph_id string, seq_id long, value string")
    got = {r.seq_id: r["items"] for r in rd.parse_weighted_sequences(df).collect()}
    assert got == {1: ["a", "b"], 4: ["s", "e", "q"], 5: ["freq", "n"], 6: ["c", "d"]}
    for name, text in (("one", "sequence\na b\nseq,n\n"), ("two", "x y\nevents\n")):
        (tmp_path / name).write_text(text)
    got = sorted(r["items"] for r in rd.read_weighted_sequences(spark, str(tmp_path)).collect())
    assert got == [["a", "b"], list("events"), ["seq", "n"], ["x", "y"]]


def test_graphs_without_a_given_root_are_inferred(spark):
    edges = spark.createDataFrame([("g1", "a", "b", 2.0), ("g1", "b", "c", 1.0), ("g2", "x", "y", 3.0)], EDGES)
    given = spark.createDataFrame([("g1", "b")], "graph_id string, root string")
    got = {(r.graph_id, r.src, r.dst) for r in it.extract_structure(edges, provided=given).collect()}
    assert got == {("g1", "b", "c"), ("g2", "x", "y")}
    assert it.extract_structure(edges.limit(0)).count() == 0
    assert pt.multiobjective_polytree(edges, tr.choose_root_greedy(edges), min_score=9.0).count() == 0


def test_degrees_where_ranks_do_not_rest(spark):
    edges = spark.createDataFrame([("g", a, b, 1.0) for a, b in ("ab", "bc", "ca", "ad")], EDGES)
    got = {r.node: r.centrality for r in gr.pagerank(edges, rounds=2).collect()}
    assert got == {"a": 1.0, "b": 2 / 3, "c": 2 / 3, "d": 1 / 3}
    assert max(r.centrality for r in gr.pagerank(edges).collect()) == 1.0


def test_greedy_root_ties_go_by_centrality(spark):
    edges = spark.createDataFrame([("g", "a", "x", 2.0), ("g", "a", "y", 2.0), ("g", "b", "a", 4.0)], EDGES)
    rank = spark.createDataFrame([("g", "b", 1.0), ("g", "a", 0.5)], "graph_id string, node string, centrality double")
    assert tr.choose_root_greedy(edges).first()["root"] == "a"
    assert tr.choose_root_greedy(edges, rank).first()["root"] == "b"


def test_matrices_of_any_size(spark):
    edges = spark.createDataFrame([("g", f"n{i}", f"n{i + 1}", 1.0) for i in range(30)], EDGES)
    assert nw.transition_matrix(edges).count() == 30
    assert sum(r.weight for r in nw.transition_matrix(edges, ["n0", "n1", "none"]).collect()) == 1.0
    assert nw.transition_matrix(edges, ["n0", "n1", "none"]).count() == 4
    assert nw.adjacency_matrix(edges, ["n1", "n5"]).columns == ["graph_id", "src", "n1", "n5"]


def test_betweenness_has_no_edge_limit(spark):
    edges = spark.createDataFrame([("g", f"n{i:02d}", f"n{i + 1:02d}", 1.0) for i in range(6)], EDGES)
    got = {r.node: r.betweenness for r in gr.betweenness(edges).collect()}
    assert math.isclose(got["n03"], 9 / 30)
    assert set(r.betweenness for r in gr.betweenness(edges, max_edges=3).collect()) == {0.0}


def test_profile_counts_distinct_values(spark):
    df = spark.createDataFrame([(str(i % 7), "x" if i else None) for i in range(50)], "a string, b string")
    assert {r["column"]: r["distinct_count"] for r in rd.profile_columns(df).collect()} == {"a": 7, "b": 1}


def test_few_files_per_graph(spark, tmp_path):
    edges = spark.createDataFrame([(f"g{i % 3}", f"n{i}", "m", 1.0) for i in range(300)], EDGES).repartition(8)
    path = write_tables({"edges": edges}, str(tmp_path))["edges"]
    assert len(list(tmp_path.glob("edges/graph_id=*/*.parquet"))) == 3
    assert spark.read.parquet(path).count() == 300


def test_whole_analyses(spark):
    rng = random.Random(4)
    rows = [("g", f"c{i % 20}", i, 0, rng.choice("abcd")) for i in range(400)]
    found = analysis.analyse_sequences(spark.createDataFrame(rows, EVENTS))
    assert [r["is_valid"] for check in found.checks.values() for r in check.collect()] == [True] * 3
    assert found.comparison.count() == 3 and found.ranking.count() == 3
    signals = inf.prepare_signals(spark.createDataFrame(rows, EVENTS), "case_id", "ord", "item")
    influence = analysis.analyse_influence(signals, 50.0)
    assert influence.summary.first()["heuristic"] in ("forward", "back_and_forward") and influence.metrics.first()["entities"] == 20
    assert statistics.fmean(r["weight"] for r in influence.edges.collect()) > 0
