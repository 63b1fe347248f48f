"""Rooted branchings, forward trees and poly-trees of many networks at once.

One total order of edges is used throughout: weight descending, then source, then
destination.  It makes every greedy structure below unique.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqnet.operators.graph import reachable_subgraph
from seqnet.operators.network import PAIR, node_strength, nodes_of, observed_edges
from seqnet.plans.lineage import Stage, beside, cut
from seqnet.plans.ordering import neighbours, with_chunks

# Names that mark a start node, and the directions of poly-tree edges.
START_NAMES = ["SOURCE", "START"]
INITIAL, FORWARD, BACKWARD = "INITIAL", "FORWARD", "BACKWARD"


def edge_key() -> Column:
    """Sorts edges heaviest first, ties by source and destination."""
    return F.struct((-F.col("weight")).alias("nw"), F.col("src").alias("src"), F.col("dst").alias("dst"))


def simple_edges(edges: DataFrame) -> DataFrame:
    """Positive edges without self-loops, parallel edges summed."""
    return observed_edges(edges.filter("weight > 0 and src <> dst"))


# --- roots -------------------------------------------------------------------


def choose_root_2007(edges: DataFrame) -> DataFrame:
    """SOURCE or START if present, else a node without in edges, else the dominant node."""
    source, start = START_NAMES
    upper = F.upper("node")
    group = F.when(upper == source, 0).when(upper == start, 1).when(F.col("in_degree") == 0, 2).otherwise(3)
    surplus = F.when(group == 3, F.col("in_weight") - F.col("out_weight")).otherwise(0.0)
    rank = F.struct(group, -F.col("out_weight"), surplus, -F.col("out_degree"), F.col("node"))
    picked = node_strength(simple_edges(edges)).groupBy("graph_id").agg(
        F.min_by("node", rank).alias("root"), F.min(group).alias("_group"), F.count_if(F.col("in_degree") == 0).alias("_free")
    )
    how = (
        F.when(F.col("_group") == 0, source)
        .when(F.col("_group") == 1, start)
        .when((F.col("_group") == 2) & (F.col("_free") == 1), "single_zero_indegree")
        .when(F.col("_group") == 2, "zero_indegree_highest_out_weight")
        .otherwise("dominant_real_root")
    )
    return picked.select("graph_id", "root", how.alias("selection"))


def choose_root_forward(edges: DataFrame) -> DataFrame:
    """The node without in edges, else any node, that has the largest out weight."""
    rank = F.struct(F.when(F.col("in_degree") == 0, 0).otherwise(1), -F.col("out_weight"), F.col("node"))
    return node_strength(edges).groupBy("graph_id").agg(F.min_by("node", rank).alias("root"))


def choose_root_greedy(edges: DataFrame, centrality: DataFrame | None = None) -> DataFrame:
    """START if present, else the node with the largest out weight.

    Ties go by ``centrality`` (``graph_id, node, centrality``) where it is given, then by degree.
    """
    group = F.when(F.upper("node") == START_NAMES[1], 0).otherwise(1)
    nodes = node_strength(edges)
    nodes = nodes.withColumn("centrality", F.lit(0.0)) if centrality is None else nodes.join(centrality, ["graph_id", "node"], "left")
    rank = F.struct(group, -F.col("out_weight"), -F.coalesce("centrality", F.lit(0.0)), -F.col("out_degree"), F.col("node"))
    return nodes.groupBy("graph_id").agg(F.min_by("node", rank).alias("root"))


def as_nodes(roots: DataFrame) -> DataFrame:
    return roots.select("graph_id", F.col("root").alias("node"))


# --- rooted trees: levels and paths -------------------------------------------


def ancestors(tree: DataFrame | Stage, paths: bool = False) -> Stage:
    """For every node with a parent: its root and level, and with ``paths`` the way from the root.

    Each round every node jumps to the ancestor its current ancestor points at, so the
    number of rounds grows with the logarithm of the depth.
    """
    start = [F.col("dst").alias("node"), F.col("src").alias("top"), F.lit(1).cast("long").alias("level")]
    if paths:
        start += [F.array("dst").alias("path"), F.col("weight").alias("path_weight"), F.col("weight").alias("bottleneck_weight")]
    saved = tree if isinstance(tree, Stage) else cut(tree.select("graph_id", "src", "dst", *(["weight"] if paths else [])))
    tiny, table, total = saved.tiny, saved.df.select("graph_id", *start), saved.rows
    while True:
        for _ in range(2 if tiny else 1):
            ahead = table.select("graph_id", F.col("node").alias("top"), *[F.col(c).alias(f"_{c}") for c in table.columns[2:]])
            joined = table.join(beside(ahead, tiny), ["graph_id", "top"], "left")
            new = [
                F.coalesce("_top", "top").alias("top"),
                (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level"),
            ]
            if paths:
                new += [
                    F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path"),
                    (F.col("path_weight") + F.coalesce("_path_weight", F.lit(0.0))).alias("path_weight"),
                    F.least("bottleneck_weight", "_bottleneck_weight").alias("bottleneck_weight"),
                ]
            table = joined.select("graph_id", "node", *new)
        state = cut(table, tiny, total=F.sum("level"))
        if not state.rows or state["total"] == total:
            return state
        table, total = state.df, state["total"]


def tree_levels(tree: DataFrame) -> DataFrame:
    """Tree edges with the level of their lower end; children of the root have level 1."""
    levels = ancestors(tree).small().select("graph_id", F.col("node").alias("dst"), "level")
    return tree.join(levels, ["graph_id", "dst"]).select(*PAIR, "weight", "level")


def tree_nodes(tree: DataFrame) -> DataFrame:
    """Nodes of a rooted tree with level, root flag and degrees."""
    levels = ancestors(tree).small().select("graph_id", "node", "level")
    return node_strength(tree).join(levels, ["graph_id", "node"], "left").select(
        "graph_id", "node", F.coalesce("level", F.lit(0).cast("long")).alias("level"), F.col("level").isNull().alias("is_root"), "in_degree", "out_degree"
    )


def expand_paths(tree: DataFrame) -> DataFrame:
    """Every root-to-leaf path with its total and its least weight."""
    ways = ancestors(tree, paths=True).df
    inner = tree.select("graph_id", F.col("src").alias("node")).distinct()
    items = F.concat(F.array("top"), "path")
    return ways.join(inner, ["graph_id", "node"], "left_anti").select(
        "graph_id",
        F.concat_ws(" -> ", items).alias("path"),
        items.alias("items"),
        F.col("top").alias("start"),
        F.col("node").alias("end"),
        F.col("level").alias("branch_depth"),
        "path_weight",
        "bottleneck_weight",
    )


def expansion_metrics(tree: DataFrame) -> DataFrame:
    """Number of leaves, depth, and average and largest number of children of inner nodes."""
    depth = ancestors(tree).df.groupBy("graph_id").agg(F.max("level").alias("max_branch_depth"))
    children = node_strength(tree).groupBy("graph_id").agg(
        F.count_if(F.col("out_degree") == 0).alias("dominant_paths"),
        F.avg(F.when(F.col("out_degree") > 0, F.col("out_degree"))).alias("average_branching_factor"),
        F.max("out_degree").alias("max_branching_factor"),
    )
    return children.join(depth, "graph_id")


def dominant_path(tree: DataFrame) -> DataFrame:
    """The heaviest root-to-leaf path of each tree; ties by the path itself."""
    best = F.struct("path_weight", "path", "items", "branch_depth")
    heavy = F.struct(-F.col("path_weight"), F.col("path"))
    paths = expand_paths(tree).groupBy("graph_id").agg(F.min_by(best, heavy).alias("b"))
    return paths.select("graph_id", "b.path", "b.path_weight", "b.branch_depth")


# --- maximum rooted branching -------------------------------------------------


def cycle_members(pointers: DataFrame, size: Stage) -> DataFrame:
    """``graph_id, node, rep`` of the nodes on cycles of ``graph_id, node, to``, one ``rep`` per cycle.

    Pointers are doubled until every row has left the map or must stand on a cycle;
    ``size`` is the measured table the pointers come from.
    """
    table, rows, reach = pointers.select("graph_id", "node", "to", F.col("node").alias("low")), size.rows, 1
    steps = 2 if size.tiny else 1
    while rows and reach < rows:
        for _ in range(steps):
            ahead = table.select("graph_id", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
            # Rows that point at a node without a pointer of its own are on no cycle.
            table = table.join(beside(ahead, size.tiny), ["graph_id", "to"]).select(
                "graph_id", "node", F.col("_to").alias("to"), F.least("low", "_low").alias("low")
            )
        state = cut(table, size.tiny)
        table, rows, reach = state.df, state.rows, reach * 2**steps
    on_cycle = table.select("graph_id", F.col("to").alias("node")).distinct()
    return table.join(beside(on_cycle, size.tiny), ["graph_id", "node"], "left_semi").select("graph_id", "node", F.col("low").alias("rep"))


def max_rooted_branching(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Maximum-weight spanning arborescence of what the root of each graph can reach.

    Rounds of best in-edge per node, cycle contraction and re-weighting; every edge
    carries the chain of nodes its head was merged into, so that the last round can be
    unfolded into original edges.
    """
    base = cut(simple_edges(edges))
    roots = cut(choose_root_2007(base.df).select("graph_id", "root") if roots is None else roots.select("graph_id", "root"))
    usable = reachable_subgraph(base.df, as_nodes(roots.df)).join(roots.small(base), "graph_id").filter("dst <> root")
    arcs = cut(
        usable.select(
            "graph_id", F.col("src").alias("s"), F.col("dst").alias("d"), F.col("weight").alias("w"), "src", "dst", "weight", F.array("dst").alias("path")
        )
    )
    pick = F.struct((-F.col("w")).alias("nw"), F.col("src"), F.col("dst"), F.col("s"), F.col("weight"), F.col("path"))
    rounds = []
    tiny = arcs.tiny
    while True:
        best = cut(arcs.df.groupBy("graph_id", "d").agg(F.min(pick).alias("b")), tiny)
        members = cycle_members(best.df.select("graph_id", F.col("d").alias("node"), F.col("b.s").alias("to")), best)
        member = cut(members.join(best.small(best).withColumnRenamed("d", "node"), ["graph_id", "node"]), tiny)
        if not member.rows:
            break
        rounds.append(member)
        rep = member.small(arcs)
        into = rep.select("graph_id", F.col("node").alias("d"), F.col("rep").alias("_d"), (-F.col("b.nw")).alias("_w"))
        out = rep.select("graph_id", F.col("node").alias("s"), F.col("rep").alias("_s"))
        merged = (
            arcs.df.join(into, ["graph_id", "d"], "left")
            .join(out, ["graph_id", "s"], "left")
            .select(
                "graph_id",
                F.coalesce("_s", "s").alias("s"),
                F.coalesce("_d", "d").alias("d"),
                (F.col("w") - F.coalesce("_w", F.lit(0.0))).alias("w"),
                "src",
                "dst",
                "weight",
                "path",
            )
            .filter("s <> d")
        )
        kept = merged.groupBy("graph_id", "s", "d").agg(F.min(pick).alias("b"))
        arcs = cut(
            kept.select(
                "graph_id", "s", "d", (-F.col("b.nw")).alias("w"), "b.src", "b.dst", "b.weight", F.concat("b.path", F.array("d")).alias("path")
            ),
            tiny,
        )
    chosen = best.df.select("graph_id", "d", "b.src", "b.dst", "b.weight", "b.path")
    for depth, member in reversed(list(enumerate(rounds))):
        inner = member.small(best).select("graph_id", F.col("rep").alias("d"), "node", "b")
        enters = F.col("node").isNull() | (F.col("node") == F.element_at("path", depth + 1))
        opened = chosen.join(inner, ["graph_id", "d"], "left")
        chosen = cut(
            opened.select(
                "graph_id",
                F.coalesce("node", "d").alias("d"),
                *[F.when(enters, F.col(c)).otherwise(F.col(f"b.{c}")).alias(c) for c in ("src", "dst", "weight", "path")],
            ),
            tiny,
        ).df
    return chosen.select(*PAIR, "weight")


# --- forward tree ---------------------------------------------------------------


def ranked_edges(edges: DataFrame) -> DataFrame:
    """``graph_id, src, dst, weight, rank``: the place of every edge of a graph in the order of all its edges, from 1."""
    order = ["_nw", "src", "dst"]
    rows = with_chunks(edges.withColumn("_nw", -F.col("weight")), ["graph_id"], order)
    placed = neighbours(rows, ["graph_id"], [F.col(c) for c in order], "src")
    return placed.select(*PAIR, "weight", F.col("pos").alias("rank"))


#: Steps of a written round while tables are tiny, steps and rounds of labels, and written rounds before forced nodes are contracted.
TINY_STEPS, LABEL_STEPS, LABEL_ROUNDS, FEW_ROUNDS = 4, 6, 5, 3
PROBLEM = ["graph_id", "problem"]


def _bottlenecks(arcs: Stage, starts: Stage, contract: bool = False) -> DataFrame:
    """``graph_id, problem, node, worst``: the least possible largest rank on a way from the problem's start.

    ``arcs`` are ``graph_id, problem, src, dst, rank``.  Ways are followed edge by edge; if that
    takes many rounds, nodes with a single arc in are contracted into the node before them by
    pointer doubling, where the largest rank on the way is all that counts, and the rest is solved alike.
    """
    tiny, key = arcs.tiny, [*PROBLEM, "node"]
    forced, worthwhile = None, True
    if contract:
        worthwhile = False
        into = arcs.df.groupBy(*PROBLEM, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min("src").alias("top"), F.min("rank").alias("worst"))
        single = cut(into.filter("_n = 1").drop("_n"), tiny)
        if single.rows:
            forced, reach, steps = single, 1, 2 if tiny else 1
            while reach < single.rows:
                table = forced.df
                for _ in range(steps):
                    ahead = table.select(*PROBLEM, F.col("node").alias("top"), F.col("top").alias("_top"), F.col("worst").alias("_worst"))
                    table = table.join(beside(ahead, tiny), [*PROBLEM, "top"], "left").select(
                        *key, F.coalesce("_top", "top").alias("top"), F.greatest("worst", "_worst").alias("worst"), F.col("_top").isNotNull().alias("_moved")
                    )
                forced = cut(table.select(*key, "top", "worst", "_moved"), tiny, moved=F.count_if(F.col("_moved")))
                moved, reach = forced["moved"], reach * 2**steps
                forced = Stage(forced.df.drop("_moved"), 5, forced.figures, forced.path)
                if not moved:
                    break
            ends = forced.small(arcs)
            rest = arcs.df.join(ends.select(*PROBLEM, F.col("node").alias("dst")), [*PROBLEM, "dst"], "left_anti")
            rest = rest.join(ends.withColumnsRenamed({"node": "src", "top": "_top", "worst": "_worst"}), [*PROBLEM, "src"], "left")
            rest = rest.select(*PROBLEM, F.coalesce("_top", "src").alias("src"), "dst", F.greatest("rank", "_worst").alias("rank")).filter("src <> dst")
            rows = arcs.rows
            arcs = cut(rest.groupBy(*PROBLEM, "src", "dst").agg(F.min("rank").alias("rank")), tiny)
            worthwhile = arcs.rows < rows
    state = cut(starts.df.select(*key, F.lit(0).cast("long").alias("worst")), tiny)
    # A step of rank 0 from each node to itself keeps what it has.
    ends = arcs.df.select(*PROBLEM, F.explode(F.array("src", "dst")).alias("src")).distinct()
    steps = cut(arcs.df.unionByName(ends.select(*PROBLEM, "src", F.col("src").alias("dst"), F.lit(0).cast("long").alias("rank"))), tiny)
    before, rounds, found = None, 0, None
    while before != (state.rows, state.figures.get("total")):
        before = (state.rows, state.figures.get("total"))
        if rounds == FEW_ROUNDS and worthwhile:
            found = _bottlenecks(arcs, starts, True)
            break
        table = state.df
        for _ in range(TINY_STEPS if tiny else 1):
            moved = steps.df.join(beside(table.withColumnRenamed("node", "src"), tiny), [*PROBLEM, "src"])
            table = moved.groupBy(*PROBLEM, F.col("dst").alias("node")).agg(F.min(F.greatest("worst", "rank")).alias("worst"))
        state = cut(table, tiny, replaces=state, total=F.sum("worst"))
        rounds += 1
    found = state.df.filter("worst > 0") if found is None else found
    if forced is None:
        return found
    known = cut(found.unionByName(starts.df.select(*key, F.lit(0).cast("long").alias("worst"))), tiny)
    tops = known.small(forced).select(*PROBLEM, F.col("node").alias("top"), F.col("worst").alias("_worst"))
    behind = forced.df.join(tops, [*PROBLEM, "top"]).select(*key, F.greatest("worst", "_worst").alias("worst"))
    return known.df.filter("worst > 0").unionByName(behind)


def _by_labels(arcs: Stage, starts: Stage) -> DataFrame | None:
    """``graph_id, rank`` of the tree's edges in small shallow networks; nothing if the rounds are too few.

    The label of a node is the worst rank on its way, the worst behind that edge, and so on:
    following an edge drops the better ranks at the end of the list and appends its own.  This
    keeps the order of lists, so the least label of every node comes from one fixpoint, and
    its last rank is the edge that enters the node.
    """
    state = cut(starts.df.select("graph_id", "node", F.array().cast("array<bigint>").alias("label")), True)
    # A step of no edge from each node to itself keeps what it has.
    stay = nodes_of(arcs.df).select("graph_id", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(None).cast("bigint").alias("rank"))
    steps = cut(arcs.df.select(*PAIR, "rank").unionByName(stay), True).df.withColumnRenamed("src", "node")
    longer = F.when(F.col("rank").isNull(), F.col("label")).otherwise(F.concat(F.filter("label", lambda r: r > F.col("rank")), F.array("rank")))
    mark = None
    for _ in range(LABEL_ROUNDS):
        table = state.df
        for _ in range(LABEL_STEPS):
            moved = steps.join(beside(table, True), ["graph_id", "node"])
            table = moved.groupBy("graph_id", F.col("dst").alias("node")).agg(F.min(longer).alias("label"))
        state = cut(table, True, replaces=state, mark=F.bit_xor(F.xxhash64("graph_id", "node", "label")))
        if mark == (state.rows, state["mark"]):
            return state.df.filter(F.size("label") > 0).select("graph_id", F.element_at("label", -1).alias("rank"))
        mark = (state.rows, state["mark"])
    return None


def forward_tree(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Greedy growth from the root, always by the heaviest edge that leaves the tree.

    Every edge has one number, its rank in the order of all edges of its graph.  The greedy way to a
    node has the least possible worst edge.  Nodes whose ways have the same worst edge are taken
    right after it, one after the other, before any edge that is worse: so that edge is in
    the tree, and the nodes behind it are a problem of their own, from its end and among
    themselves.  All problems of all graphs are solved together until none has an edge left.
    """
    base = cut(ranked_edges(edges.filter("weight > 0 and src <> dst").select(*PAIR, "weight")))
    tiny = base.tiny
    roots = choose_root_forward(base.df) if roots is None else roots
    zero = F.lit(0).cast("long")
    starts = cut(roots.select("graph_id", zero.alias("problem"), F.col("root").alias("node")), tiny)
    tops = starts.small(base).select("graph_id", "problem", F.col("node").alias("_top"))
    arcs = cut(base.df.join(tops, "graph_id").filter("dst <> _top").select(*PROBLEM, "src", "dst", "rank"), tiny)
    chosen = _by_labels(arcs, starts) if tiny else None
    if chosen is not None:
        return base.df.join(beside(chosen, tiny), ["graph_id", "rank"], "left_semi").select(*PAIR, "weight")
    taken = []
    while arcs.rows:
        worst = cut(_bottlenecks(arcs, starts), tiny)
        side = worst.small(arcs)
        entered = side.select("graph_id", F.col("worst").alias("rank")).distinct()
        new = cut(arcs.df.join(entered, ["graph_id", "rank"], "left_semi").select("graph_id", F.col("rank").alias("problem"), F.col("dst").alias("node")), tiny)
        taken.append(new.df)
        inside = (
            arcs.df.select("graph_id", "problem", "src", "dst", "rank")
            .join(side.withColumnsRenamed({"node": "src", "worst": "_s"}), [*PROBLEM, "src"])
            .join(side.withColumnsRenamed({"node": "dst", "worst": "_d"}), [*PROBLEM, "dst"])
            .filter("_s = _d")
            .select("graph_id", F.col("_s").alias("problem"), "src", "dst", "rank")
        )
        heads = new.small(arcs).withColumnRenamed("node", "dst")
        arcs = cut(inside.join(heads, [*PROBLEM, "dst"], "left_anti").select(*PROBLEM, "src", "dst", "rank"), tiny, replaces=arcs)
        starts = new
    if not taken:
        return base.df.limit(0).select(*PAIR, "weight")
    chosen = reduce(DataFrame.unionByName, taken).select("graph_id", F.col("problem").alias("rank"))
    return base.df.join(chosen, ["graph_id", "rank"], "left_semi").select(*PAIR, "weight")


def greedy_tree(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """The forward tree from the node with the largest out weight, with levels."""
    kept = cut(edges.filter("weight > 0 and src <> dst").select(*PAIR, "weight")).df
    tree = forward_tree(kept, choose_root_greedy(kept) if roots is None else roots)
    return tree_levels(cut(tree).df)


# --- poly-trees -----------------------------------------------------------------


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Maximum spanning forest of the network without directions, as original directed edges.

    Rounds of best edge per component, hooking and pointer jumping; the edge table is
    rewritten to component labels and keeps one edge per pair of components.
    """
    base = edges.filter("weight > 0 and src <> dst").select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), edge_key().alias("edge"))
    arcs = cut(base.groupBy("graph_id", "a", "b").agg(F.min("edge").alias("edge")))
    parts = []
    tiny = arcs.tiny
    while arcs.rows:
        both = arcs.df.select(
            "graph_id",
            F.inline(
                F.array(
                    F.struct(F.col("a").alias("c"), F.struct(F.col("edge"), F.col("b").alias("other")).alias("pick")),
                    F.struct(F.col("b").alias("c"), F.struct(F.col("edge"), F.col("a").alias("other")).alias("pick")),
                )
            ),
        )
        best = cut(both.groupBy("graph_id", "c").agg(F.min("pick").alias("pick")), tiny)
        parts.append(best.df.select("graph_id", "pick.edge.src", "pick.edge.dst", (-F.col("pick.edge.nw")).alias("weight")).distinct())
        back = best.small(best).select("graph_id", F.col("c").alias("to"), F.col("pick.other").alias("_back"))
        hook = best.df.select("graph_id", "c", F.col("pick.other").alias("to")).join(back, ["graph_id", "to"])
        # Two components that chose the same edge: the lesser name stays a root.
        hook = hook.select("graph_id", "c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        while True:
            table = hook
            for _ in range(2):
                ahead = table.select("graph_id", F.col("c").alias("to"), F.col("to").alias("_to"))
                table = table.join(beside(ahead, tiny), ["graph_id", "to"]).select("graph_id", "c", F.col("_to").alias("to"), (F.col("_to") != F.col("to")).alias("moved"))
            labels = cut(table, tiny, moved=F.count_if(F.col("moved")))
            if not labels["moved"]:
                break
            hook = labels.df.drop("moved")
        label = labels.small(arcs).select("graph_id", "c", "to")
        x, y = F.col("_a"), F.col("_b")
        arcs = cut(
            arcs.df.join(label.withColumnsRenamed({"c": "a", "to": "_a"}), ["graph_id", "a"])
            .join(label.withColumnsRenamed({"c": "b", "to": "_b"}), ["graph_id", "b"])
            .filter("_a <> _b")
            .groupBy("graph_id", F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
            .agg(F.min("edge").alias("edge")),
            tiny,
        )
    if not parts:
        return edges.select(*PAIR, "weight").limit(0)
    return reduce(DataFrame.unionByName, parts)


def orient(forest: DataFrame, starts: DataFrame) -> DataFrame:
    """Undirected tree edges of the start node's component as ``graph_id, src(parent), dst(child), weight``.

    Walks the closed tour around each tree by pointer doubling: of the two passes along
    an edge, the earlier one goes away from the start.  Rounds grow with the logarithm
    of the tree size, whatever its depth.
    """
    ways = cut(
        forest.select(
            "graph_id",
            "weight",
            F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))),
        )
    )
    turned = with_chunks(ways.df.withColumn("_order", F.col("b")), ["graph_id", "a"], ["_order"])
    turned = neighbours(turned, ["graph_id", "a"], [F.col("b")], "b", position=False)
    first = ways.df.groupBy("graph_id", "a").agg(F.min("b").alias("_first"))
    # The arc that enters ``a`` from ``b`` goes on to the neighbour of ``a`` after ``b``.
    tour = turned.join(beside(first, ways.tiny), ["graph_id", "a"]).select(
        "graph_id", "weight", F.col("b").alias("a"), F.col("a").alias("b"), F.col("a").alias("na"), F.coalesce("next", "_first").alias("nb")
    )
    begin = starts.select("graph_id", F.col("node").alias("a")).join(first, ["graph_id", "a"])
    begin = begin.select("graph_id", F.col("a").alias("_sa"), F.col("_first").alias("_sb"))
    tour = tour.join(begin, "graph_id", "left")
    ends = (F.col("na") == F.col("_sa")) & (F.col("nb") == F.col("_sb"))
    closed = F.coalesce(ends, F.lit(False))
    state = cut(
        tour.select("graph_id", "weight", "a", "b", F.when(~closed, F.col("na")).alias("na"), F.when(~closed, F.col("nb")).alias("nb"), F.when(closed, 0).otherwise(1).cast("long").alias("left"))
    )
    before, steps, tiny = None, 2 if state.tiny else 1, state.tiny
    while True:
        table = state.df
        for _ in range(steps):
            ahead = table.select("graph_id", F.col("a").alias("na"), F.col("b").alias("nb"), F.col("na").alias("_na"), F.col("nb").alias("_nb"), F.col("left").alias("_left"))
            table = table.join(beside(ahead, tiny), ["graph_id", "na", "nb"], "left").select(
                "graph_id", "weight", "a", "b", F.col("_na").alias("na"), F.col("_nb").alias("nb"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")
            )
        state = cut(table, tiny, open=F.count_if(F.col("na").isNotNull()))
        # Distances to the end have no gaps: a round that ends no arc leaves only those that never end.
        if state["open"] in (0, before):
            break
        before = state["open"]
    # Arcs of other components never end and are left out.
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return (
        state.df.filter("na is null")
        .groupBy("graph_id", low.alias("_lo"), high.alias("_hi"))
        .agg(F.max_by(F.struct("a", "b", "weight"), "left").alias("down"))
        .select("graph_id", F.col("down.a").alias("src"), F.col("down.b").alias("dst"), "down.weight")
    )


def start_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each graph in the edge order."""
    best = edges.filter("weight > 0 and src <> dst").groupBy("graph_id").agg(F.min(edge_key()).alias("e"))
    return best.select("graph_id", "e.src", "e.dst")


def polytree_levels(forest: DataFrame, starts: DataFrame) -> DataFrame:
    """Forest edges of the start edge's component with level and direction.

    The level counts undirected steps from the source of the start edge; the direction
    says whether an edge points away from the start edge.
    """
    kept = cut(forest.select(*PAIR, "weight"))
    begin = starts.select("graph_id", F.col("src").alias("_s"), F.col("dst").alias("_d"))
    down = cut(orient(kept.df, begin.select("graph_id", F.col("_s").alias("node"))))
    depth = ancestors(down).small(down).select("graph_id", F.col("node").alias("child"), "level")
    # The child end of an edge is the one that the tour reaches later.
    sides = kept.df.select("*", F.explode(F.array("src", "dst")).alias("child")).join(
        down.small(kept).select("graph_id", F.col("src").alias("_up"), F.col("dst").alias("child")), ["graph_id", "child"]
    )
    placed = sides.filter("_up = src and child = dst or _up = dst and child = src").join(depth, ["graph_id", "child"])
    initial = (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d"))
    return placed.join(begin, "graph_id").select(
        *PAIR,
        "weight",
        F.when(initial, F.lit(0).cast("long")).otherwise(F.col("level")).alias("level"),
        F.when(initial, INITIAL).when(F.col("child") == F.col("dst"), FORWARD).otherwise(BACKWARD).alias("direction"),
    )


def back_forward_polytree(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Growth from the heaviest edge by the heaviest edge in either direction.

    With one total order of edges this is the maximum spanning tree of the start edge's
    component.  ``starts`` may name other start edges; the tree then contains that edge
    and is otherwise the same greedy growth.
    """
    base = cut(edges.filter("weight > 0 and src <> dst").select(*PAIR, "weight"))
    if starts is None:
        return polytree_levels(spanning_forest(base.df), cut(start_edges(base.df)).df)
    given = cut(starts.select("graph_id", "src", "dst"))
    # A given start edge belongs to the tree whatever its weight, so it goes first.
    forced = base.df.join(given.small().withColumn("_go", F.lit(True)), PAIR, "left")
    lifted = forced.select(*PAIR, F.when(F.col("_go"), F.lit(float("inf"))).otherwise(F.col("weight")).alias("weight"))
    forest = cut(spanning_forest(lifted).select(*PAIR)).df.join(base.df, PAIR)
    return polytree_levels(forest, given.df)


def back_forward_from_node(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Growth from a start node by the heaviest edge in either direction, with levels."""
    base = cut(edges.filter("weight > 0 and src <> dst").select(*PAIR, "weight"))
    forest = cut(spanning_forest(base.df))
    down = cut(orient(forest.df, starts.select("graph_id", "node")))
    depth = ancestors(down).df.select("graph_id", F.col("node").alias("child"), "level")
    placed = down.df.select("graph_id", F.col("src").alias("_up"), F.col("dst").alias("child")).join(depth, ["graph_id", "child"])
    along = forest.df.withColumns({"_up": F.col("src"), "child": F.col("dst"), "direction": F.lit(FORWARD)})
    against = forest.df.withColumns({"_up": F.col("dst"), "child": F.col("src"), "direction": F.lit(BACKWARD)})
    return along.unionByName(against).join(placed, ["graph_id", "_up", "child"]).select(*PAIR, "weight", "level", "direction")


def back_forward_legacy(edges: DataFrame) -> DataFrame:
    """The older form on a network with START and END: growth from START, else from the largest out weight."""
    base = cut(edges.select(*PAIR, "weight")).df
    return back_forward_from_node(base, as_nodes(choose_root_greedy(base)))
