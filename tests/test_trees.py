"""Structures against published figures and against sequential algorithms on random networks."""

from pyspark.sql import functions as F

from seqnet.operators import influence_trees as it
from seqnet.operators import metrics as me
from seqnet.operators import network as nw
from seqnet.operators import polytree as pt
from seqnet.operators import trees as tr
from seqnet.operators.graph import is_dag, pagerank, weak_components
from tests import fixtures as fx


def by_graph(df, *columns):
    out = {}
    for row in df.select("graph_id", *columns).collect():
        out.setdefault(row[0], set()).add(tuple(row)[1:])
    return out


def test_published_weights(spark):
    seqs = fx.weighted_sequences(spark)
    cats = fx.edges(spark, [("c", *r) for r in fx.CATEGORIES])
    plain = nw.sequence_network(seqs).unionByName(nw.drop_virtual(cats))
    states = nw.sequence_network(seqs, virtual=True).unionByName(cats)
    sizes = {r.graph_id: (r.nodes, r.edges, r.total_weight) for r in nw.network_metrics(plain).collect()}
    assert sizes == {"w": (8, 16, 6146.0), "c": (4, 12, 352.0)}
    sizes = {r.graph_id: (r.edges, r.total_weight) for r in nw.network_metrics(states).collect()}
    assert sizes == {"w": (19, 8928.0), "c": (20, 452.0)}
    forward = by_graph(tr.forward_tree(plain), "src", "dst", "weight")
    assert forward["w"] == {("a", "c", 674), ("c", "d", 684), ("d", "e", 1080), ("e", "h", 930), ("e", "g", 461), ("a", "b", 335), ("e", "f", 146)}
    assert forward["c"] == {("Tecnologia", "Mercearia", 75), ("Tecnologia", "Higiene", 26), ("Tecnologia", "Limpeza", 22)}
    poly = by_graph(tr.back_forward_polytree(plain), "src", "dst", "weight", "level", "direction")
    assert poly["c"] == {("Tecnologia", "Mercearia", 75, 0, "INITIAL"), ("Limpeza", "Mercearia", 29, 2, "BACKWARD"), ("Tecnologia", "Higiene", 26, 1, "FORWARD")}
    assert sum(r[2] for r in poly["w"]) == 4371
    roots = tr.choose_root_2007(states)
    tree = tr.max_rooted_branching(states, roots)
    checked = {r.graph_id: (r.edges, r.total_weight, r.is_valid) for r in me.validate_branching(tree, roots, states).collect()}
    assert checked == {"w": (9, 6631.0, True), "c": (5, 165.0, True)}
    paths = by_graph(tr.expand_paths(tree), "path", "branch_depth", "path_weight", "bottleneck_weight")["c"]
    assert paths == {
        ("SOURCE -> Tecnologia -> Mercearia -> SINK", 3, 117.0, 17.0),
        ("SOURCE -> Tecnologia -> Higiene", 2, 43.0, 17.0),
        ("SOURCE -> Tecnologia -> Limpeza", 2, 39.0, 17.0),
    }


def test_published_topk(spark):
    cats = nw.drop_virtual(fx.edges(spark, [("c", *r) for r in fx.CATEGORIES]))
    rows = pt.topk_polytree(cats, tr.choose_root_greedy(cats), max_depth=3).collect()
    assert len(rows) == 10
    merged = pt.collapse_polytree(pt.topk_polytree(cats, tr.choose_root_greedy(cats), max_depth=3))
    assert merged.agg(F.sum("weight")).first()[0] / 352 * 100 == 59.375


def test_random_networks(spark):
    nets = fx.random_networks(40, seed=7)
    edges = fx.edges(spark, fx.as_rows(nets)).cache()
    roots = spark.createDataFrame([(g, "n0") for g, net in nets.items() if any(a == "n0" for a, _ in net)], "graph_id string, root string")
    rooted = [r.graph_id for r in roots.collect()]

    forward = by_graph(tr.forward_tree(edges, roots), "src", "dst", "weight")
    for g in rooted:
        assert forward[g] == set(fx.sequential_forward(nets[g], "n0")), g

    poly = by_graph(tr.back_forward_polytree(edges), "src", "dst", "weight", "level", "direction")
    for g, net in nets.items():
        assert poly[g] == set(fx.sequential_polytree(net)), g

    small = {g: net for g, net in nets.items() if g in rooted and len({n for e in net for n in e}) <= 6}
    branching = tr.max_rooted_branching(fx.edges(spark, fx.as_rows(small)), roots)
    weights = {r.graph_id: r.w for r in branching.groupBy("graph_id").agg(F.sum("weight").alias("w")).collect()}
    checked = {r.graph_id: r.is_valid for r in me.validate_branching(branching, roots.filter(F.col("graph_id").isin(list(small))), edges).collect()}
    for g, net in small.items():
        assert weights.get(g) == fx.best_branching_weight(net, "n0"), g
        assert checked[g], g


def test_given_starts(spark):
    nets = fx.random_networks(15, seed=11)
    edges = fx.edges(spark, fx.as_rows(nets)).cache()
    begin = {g: max(net) for g, net in nets.items()}
    starts = spark.createDataFrame([(g, *e) for g, e in begin.items()], "graph_id string, src string, dst string")
    poly = by_graph(tr.back_forward_polytree(edges, starts), "src", "dst", "weight", "level", "direction")
    for g, net in nets.items():
        assert poly[g] == set(fx.sequential_polytree(net, start=begin[g])), g
    nodes = starts.select("graph_id", F.col("dst").alias("node"))
    grown = by_graph(tr.back_forward_from_node(edges, nodes), "src", "dst", "weight", "level", "direction")
    for g, net in nets.items():
        assert grown[g] == set(fx.sequential_polytree(net, start_node=begin[g][1])), g


def test_influence_structures(spark):
    nets = fx.random_networks(25, seed=3)
    edges = fx.edges(spark, fx.as_rows(nets)).cache()
    roots = spark.createDataFrame([(g, "n0") for g in nets], "graph_id string, root string")
    for top_k, depth in ((1, 10), (2, 10), (3, 2)):
        got = by_graph(it.forum_forward_tree(edges, roots, top_k, depth), "src", "dst", "weight", "level")
        for g, net in nets.items():
            assert got.get(g, set()) == set(fx.sequential_queue(net, "n0", top_k, depth)), (g, top_k)
    simple = by_graph(it.simplified_influence(edges), "src", "dst")
    for g, net in nets.items():
        assert simple[g] == fx.sequential_simplified(net), g
    late = {g: max(net.items(), key=lambda e: (e[1], e[0]))[0] for g, net in nets.items()}
    for cap, limit in ((10, None), (2, None), (10, 3)):
        got = by_graph(it.forum_polytree(edges, max_depth=cap, max_edges=limit), "src", "dst", "weight", "level", "direction")
        for g, net in nets.items():
            assert got[g] == set(fx.sequential_polytree(net, start=late[g], max_depth=cap, max_edges=limit)), (g, cap, limit)


def test_self_loop_start_stays_alone(spark):
    edges = fx.edges(spark, [("g", "a", "a", 9), ("g", "a", "b", 2), ("h", "a", "b", 3), ("h", "b", "b", 1)])
    got = by_graph(it.forum_polytree(edges), "src", "dst", "level")
    assert got == {"g": {("a", "a", 0)}, "h": {("a", "b", 0)}}


def test_multiobjective(spark):
    nets = fx.random_networks(12, seed=5, heaviest=40)
    nets = {g: net for g, net in nets.items() if any(a == "n0" for a, _ in net)}
    edges = fx.edges(spark, fx.as_rows(nets)).cache()
    central = {(r.graph_id, r.node): r.centrality for r in pagerank(edges).collect()}
    roots = spark.createDataFrame([(g, "n0") for g in nets], "graph_id string, root string")
    got = by_graph(pt.multiobjective_polytree(edges, roots), "src", "dst", "weight", "level", "parent_path")
    for g, net in nets.items():
        want = fx.sequential_multiobjective(net, "n0", {n: c for (k, n), c in central.items() if k == g})
        assert got.get(g, set()) == set(want), g


def test_tours_of_every_length(spark):
    """Chains of all lengths around the steps of a round, each alone: levels count from the start."""
    for n in (2, 5, 9, 17):
        chain = fx.edges(spark, [("g", f"n{i:02d}", f"n{i + 1:02d}", 100 - i) for i in range(n)])
        got = {r.dst: r.level for r in tr.back_forward_polytree(chain).collect()}
        assert got == {f"n{i + 1:02d}": i and i + 1 for i in range(n)}, n


def test_cycles_components_and_center(spark):
    rows = [("dag", "a", "b", 1), ("dag", "b", "c", 1), ("dag", "a", "c", 1), ("ring", "a", "b", 1), ("ring", "b", "a", 1), ("loop", "a", "a", 1), ("loop", "a", "b", 1), ("two", "a", "b", 1), ("two", "c", "d", 2)]
    edges = fx.edges(spark, rows)
    assert {r.graph_id: r.is_dag for r in is_dag(edges).collect()} == {"dag": True, "ring": False, "loop": False, "two": True}
    assert {r.graph_id: r.components for r in weak_components(edges).collect()} == {"dag": 1, "ring": 1, "loop": 1, "two": 2}
    chain = fx.edges(spark, [("odd", "a", "b", 1), ("odd", "b", "c", 1), ("even", "z", "y", 1), ("even", "y", "x", 1), ("even", "x", "w", 1), ("pair", "q", "p", 1)])
    assert {r.graph_id: r.center for r in me.tree_center(chain).collect()} == {"odd": "b", "even": "x", "pair": "p"}


def test_deep_chain(spark):
    """Depth costs logarithmically many rounds where a parent or a tour is known."""
    n = 40
    chain = fx.edges(spark, [("g", f"n{i:02d}", f"n{i + 1:02d}", 100 - i) for i in range(n)])
    levels = {r.dst: r.level for r in tr.tree_levels(chain).collect()}
    assert levels == {f"n{i + 1:02d}": i + 1 for i in range(n)}
    poly = {r.dst: (r.level, r.direction) for r in tr.back_forward_polytree(chain).collect()}
    assert poly["n01"] == (0, "INITIAL") and poly["n40"] == (40, "FORWARD")
    steps = it.polytree_dominant_path(tr.back_forward_polytree(chain)).orderBy("step").collect()
    assert [r.src for r in steps] == [f"n{i:02d}" for i in range(n)]
