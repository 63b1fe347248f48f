"""Deep, cyclic and many-rooted networks against sequential searches."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from seqnet.operators import graph as gr
from seqnet.operators import metrics as me
from seqnet.operators import trees as tr
from tests import fixtures as fx

EDGES = "graph_id string, src string, dst string, weight double"


def breadth_first(net, starts):
    level, queue = dict.fromkeys(starts, 0), list(starts)
    while queue:
        node = queue.pop(0)
        for a, b in net:
            if a == node and b not in level:
                level[b] = level[node] + 1
                queue.append(b)
    return level


def mutual(net):
    """Least node that reaches a node and is reached from it."""
    nodes = {n for e in net for n in e}
    reach = {n: fx.reachable(net, n) for n in nodes}
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.fixture(scope="module")
def networks():
    """Dense and sparse ones, rings, rings with tails in and out, rings that share ways, and trees of chains."""
    rng = random.Random(3)
    nets = fx.random_networks(20, seed=21, most=9, loops=True)
    names = [f"m{i:02d}" for i in range(40)]
    for k in range(8):
        nets[f"sparse{k}"] = {(rng.choice(names), rng.choice(names)): 1.0 for _ in range(rng.choice([30, 45, 60]))}
    ring = {(f"r{i:02d}", f"r{(i + 1) % 20:02d}"): 1.0 for i in range(20)}
    into = {(f"t{i:02d}", f"t{i + 1:02d}"): 1.0 for i in range(30)} | {("t30", "r00"): 1.0}
    out = {(f"u{i:02d}", f"u{i + 1:02d}"): 1.0 for i in range(30)} | {("r05", "u00"): 1.0}
    nets |= {"ring": ring, "tails": ring | into | out, "shared": ring | {("r10", "x"): 1.0, ("x", "y"): 1.0, ("y", "r03"): 1.0}}
    comb = {(f"a{i:02d}", f"a{i + 1:02d}"): 1.0 for i in range(40)} | {(f"a{i:02d}", f"b{i:02d}"): 1.0 for i in range(40)} | {(f"b{i:02d}", f"c{i:02d}"): 1.0 for i in range(40)}
    ladder = {e: 1.0 for i in range(20) for e in itertools.product((f"p{i:02d}", f"q{i:02d}"), (f"p{i + 1:02d}", f"q{i + 1:02d}"))}
    return nets | {"comb": comb, "ladder": ladder}


def test_strong_components_and_cycles(spark, networks):
    edges = fx.edges(spark, fx.as_rows(networks)).cache()
    want = {g: mutual(net) for g, net in networks.items()}
    got = {}
    for r in gr.strong_components(edges).collect():
        got.setdefault(r.graph_id, {})[r.node] = r.component
    assert got == want
    cycles = {r.graph_id: r.has_cycles for r in gr.is_dag(edges).collect()}
    assert cycles == {g: any(a == b for a, b in net) or len(set(want[g].values())) < len(want[g]) for g, net in networks.items()}
    assert gr.strong_components(edges.limit(0)).count() == 0 and gr.is_dag(edges.limit(0)).count() == 0


def test_levels(spark, networks):
    """One start in a graph, several in some, and one inside a ring."""
    edges = fx.edges(spark, fx.as_rows(networks)).cache()
    starts = [(g, min(n for e in net for n in e)) for g, net in networks.items()] + [("tails", "t00"), ("comb", "a20"), ("ladder", "q00")]
    got = {}
    for r in gr.hops(edges, spark.createDataFrame(starts, "graph_id string, node string")).df.collect():
        assert r.node not in got.setdefault(r.graph_id, {})
        got[r.graph_id][r.node] = r.level
    assert got == {g: breadth_first(net, [n for h, n in starts if h == g]) for g, net in networks.items()}


def test_hundred_thousand_edges_deep(spark):
    """A chain, and a ring with a long tail: rounds grow with the logarithm of the length."""
    n = 100_000
    number = spark.range(n)
    name = F.format_string("n%06d", "id")
    chain = number.select(F.lit("chain").alias("graph_id"), name.alias("src"), F.format_string("n%06d", F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    back = spark.createDataFrame([("ring", f"n{n // 2:06d}", "n000000", 1.0)], EDGES)
    edges = chain.unionByName(chain.withColumn("graph_id", F.lit("ring"))).unionByName(back).cache()
    assert {r.graph_id: r.is_dag for r in gr.is_dag(edges).collect()} == {"chain": True, "ring": False}
    sizes = gr.strong_components(edges).groupBy("graph_id", "component").count().groupBy("graph_id").agg(F.max("count").alias("n"), F.count(F.lit(1)).alias("parts"))
    assert {r.graph_id: (r.n, r.parts) for r in sizes.collect()} == {"chain": (1, n + 1), "ring": (n // 2 + 1, n // 2 + 1)}
    roots = spark.createDataFrame([("chain", "n000000"), ("ring", "n000007")], "graph_id string, node string")
    levels = gr.hops(edges, roots).df
    assert levels.filter("graph_id = 'chain' and level <> cast(substr(node, 2) as bigint)").count() == 0
    assert {r.graph_id: (r.n, r.top) for r in levels.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("top")).collect()} == {
        "chain": (n + 1, n),
        "ring": (n + 1, n - 7),
    }


@pytest.mark.parametrize("labels", [5, 0])
def test_forward_trees_by_labels_and_by_worst_ranks(spark, monkeypatch, labels):
    """The small form and the one of nested problems give what the sequential growth gives."""
    monkeypatch.setattr(tr, "LABEL_ROUNDS", labels)
    nets = {g: net for g, net in fx.random_networks(30, seed=9, most=12).items() if any(a == "n0" for a, _ in net)}
    nets["deep"] = {(f"n{i}", f"n{i + 1}"): float(50 - i) for i in range(40)} | {("n0", "n30"): 1.0, ("n17", "n3"): 60.0}
    roots = spark.createDataFrame([(g, "n0") for g in nets], "graph_id string, root string")
    got = {}
    for r in tr.forward_tree(fx.edges(spark, fx.as_rows(nets)), roots).collect():
        got.setdefault(r.graph_id, set()).add((r.src, r.dst, r.weight))
    assert got == {g: set(fx.sequential_forward(net, "n0")) for g, net in nets.items()}


def test_centers_need_few_sweeps(spark):
    """Exact, and far fewer sweeps than nodes; networks in pieces have no finite eccentricity."""
    nets = fx.random_networks(12, seed=31, most=9)
    nets["path"] = {(f"v{i:03d}", f"v{i + 1:03d}"): 1.0 for i in range(100)}
    nets["star"] = {("hub", f"s{i:02d}"): 1.0 for i in range(60)}
    got, sweeps = me.center_search(fx.edges(spark, fx.as_rows(nets)))
    want = {}
    for g, net in nets.items():
        both = {(a, b) for a, b in net} | {(b, a) for a, b in net}
        nodes = {n for e in net for n in e}
        far = {n: level for n in nodes if len(level := breadth_first(both, [n]))}
        weight = {n: sum(w * ((a == n) + (b == n)) for (a, b), w in net.items()) for n in nodes}
        best = min((max(far[n].values()) if len(far[n]) == len(nodes) else float("inf"), -weight[n], n) for n in nodes)
        want[g] = (best[2], best[0])
    assert {r.graph_id: (r.center, r.eccentricity) for r in got.collect()} == want
    assert sweeps <= 10


def test_betweenness_in_batches(spark):
    """The sum over batches of origins is that of all origins at once."""
    edges = fx.edges(spark, fx.as_rows(fx.random_networks(15, seed=5))).cache()
    once = {(r.graph_id, r.node): round(r.betweenness, 9) for r in gr.betweenness(edges).collect()}
    assert {(r.graph_id, r.node): round(r.betweenness, 9) for r in gr.betweenness(edges, batch_bytes=60_000).collect()} == once


def test_rounds_carry_open_nodes_only(spark, monkeypatch):
    """Short chains and one ring: what is written follows the nodes, not the rounds that the whole table could need."""
    edges = [("short", f"c{k}n{i}", f"c{k}n{i + 1}", 1.0) for k in range(300) for i in range(9)]
    edges += [("ring", f"r{i:02d}", f"r{(i + 1) % 30:02d}", 1.0) for i in range(30)]
    written, cut = [], gr.cut

    def counted(df, *args, **figures):
        stage = cut(df, *args, **figures)
        if "dist" in df.columns:
            written.append(stage.rows)
        return stage

    monkeypatch.setattr(gr, "cut", counted)
    arcs = cut(gr.arcs_of(spark.createDataFrame(edges, EDGES)).withColumn("len", F.lit(1).cast("long")))
    degrees = gr._degrees(arcs)
    chains = gr.Chains(degrees)
    # Eight of the ten nodes of a chain have one arc in and one out.
    assert sum(written) <= 2.5 * (300 * 8 + 30)
    assert chains.closed == 30
    assert {(r.graph_id, r.component) for r in chains.rings.collect()} == {("ring", "r00")}
    members = {r.node: (r.top, r.dist) for r in chains.members.collect()}
    assert members == {f"c{k}n{i}": (f"c{k}n1", i - 1) for k in range(300) for i in range(1, 9)}


@pytest.mark.parametrize("sizes", [(1,), (2, 3, 64), (100,)])
def test_chains_of_larger_tables(spark, monkeypatch, sizes):
    """The same ways when tables count as large: rounds join what is open with what was written."""
    edges = [("g", f"s{k}n{i:03d}", f"s{k}n{i + 1:03d}", 1.0) for k, n in enumerate(sizes) for i in range(n + 1)]
    edges += [("g", f"q{i:02d}", f"q{(i + 1) % 21:02d}", 1.0) for i in range(21)]
    arcs = gr.cut(gr.arcs_of(spark.createDataFrame(edges, EDGES)).withColumn("len", F.lit(1).cast("long")))
    degrees = gr._degrees(arcs)
    degrees.tiny = False
    chains = gr.Chains(degrees)
    assert {r.node: (r.top, r.dist) for r in chains.members.collect()} == {f"s{k}n{i:03d}": (f"s{k}n001", i - 1) for k, n in enumerate(sizes) for i in range(1, n + 1)}
    assert {(r.node, r.component) for r in chains.rings.collect()} == {(f"q{i:02d}", "q00") for i in range(21)}
