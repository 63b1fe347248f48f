"""Reachability, components, cycles and centrality of networks, many graphs at once.

Each loop keeps its state in a checkpointed table, reads the stop condition from the
same job that wrote it, and broadcasts a side only when its measured size is small.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqnet.operators.network import PAIR, network_metrics, node_strength, nodes_of
from seqnet.plans.lineage import BROADCAST_BYTES, Stage, beside, cut, remove


def arcs_of(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Distinct ``graph_id, src, dst`` without self-loops, both ways when undirected."""
    arcs = edges.filter("src <> dst").select(*PAIR)
    if not directed:
        arcs = arcs.select(
            "graph_id",
            F.inline(
                F.array(
                    F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
                    F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
                )
            ),
        )
    return arcs.distinct()


#: Written rounds of a search before what is left is contracted, and steps of a round while tables are tiny.
SHALLOW, TINY_STEPS = 2, 5
#: Contraction goes on while it leaves at most this share of the arcs, and more than a few.
WORTHWHILE, FEW_ARCS = 0.8, 64


def _without(table: DataFrame, nodes: DataFrame, *sides: str) -> DataFrame:
    """``table`` without rows whose ``sides`` are among ``nodes``."""
    for side in sides:
        table = table.join(nodes.select("graph_id", F.col("node").alias(side)), ["graph_id", side], "left_anti")
    return table


def _lightest(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(*PAIR).agg(F.min("len").alias("len"))


def _degrees(arcs: Stage, fixed: DataFrame | None = None) -> Stage:
    """Every node's degrees with one neighbour before and one behind it; ``fixed`` nodes count as neither loose nor inner."""
    none, one, zero = F.lit(None).cast(arcs.df.schema["src"].dataType), F.lit(1), F.lit(0)
    ends = F.inline(
        F.array(
            F.struct(F.col("src").alias("node"), one.alias("o"), zero.alias("i"), F.col("dst").alias("next"), none.alias("prev"), F.lit(None).cast("long").alias("len")),
            F.struct(F.col("dst").alias("node"), zero.alias("o"), one.alias("i"), none.alias("next"), F.col("src").alias("prev"), F.col("len")),
        )
    )
    counts = arcs.df.select("graph_id", ends).groupBy("graph_id", "node").agg(
        F.sum("o").alias("o"), F.sum("i").alias("i"), F.min("next").alias("next"), F.min("prev").alias("prev"), F.min("len").alias("len")
    )
    if fixed is None:
        counts = counts.withColumn("fixed", F.lit(False))
    else:
        marks = fixed.select("graph_id", "node").distinct().withColumn("_fixed", F.lit(True))
        counts = counts.join(marks, ["graph_id", "node"], "left").withColumn("fixed", F.coalesce("_fixed", F.lit(False))).drop("_fixed")
    free = ~F.col("fixed")
    return cut(
        counts,
        arcs.tiny,
        loose=F.count_if(free & ((F.col("o") == 0) | (F.col("i") == 0))),
        inner=F.count_if(free & (F.col("o") == 1) & (F.col("i") == 1)),
    )


class Chains:
    """Maximal ways through nodes with one arc in and one arc out.

    ``members`` has every such node with the first node (``top``) of its way and the length from there,
    ``ways`` per first node what stands before (``before``) and behind the way (``behind``) and the
    lengths up to the first node and of the whole way, and ``rings`` the nodes of closed ways with the
    least name on them.  Positions come from pointer doubling, so rounds grow with the logarithm of the longest way.
    """

    def __init__(self, degrees: Stage):
        tiny = degrees.tiny
        inner = degrees.df.filter("not fixed and o = 1 and i = 1").select("graph_id", "node", "prev", "next", "len")
        before = inner.select("graph_id", F.col("node").alias("prev"), F.lit(True).alias("_chained"))
        linked = inner.join(beside(before, tiny), ["graph_id", "prev"], "left")
        chained = F.col("_chained").isNotNull()
        state = cut(
            linked.select(
                "graph_id", "node", F.when(chained, F.col("prev")).otherwise(F.col("node")).alias("top"), F.when(chained, F.col("len")).otherwise(0).alias("dist"),
                F.col("node").alias("low"), (~chained).alias("done"),
            ),
            tiny,
            open=F.count_if(~F.col("done")),
        )

        def together(tables: list[DataFrame]) -> DataFrame:
            whole = reduce(DataFrame.unionByName, tables)
            return whole.coalesce(1) if tiny else whole

        # A row is written again only while it is open; what is done is kept in the parts that were written.
        columns, left = ["graph_id", "node", "top", "dist", "low", "done"], state["open"]
        reach, ringed, parts = 1, False, []
        while left and not (ringed and reach >= left):
            ready = state.df.filter("done")
            if not ringed:
                # A table that is mostly open is not kept for its few rows that are done.
                crowded = 2 * left >= state.rows
                parts.append(cut(ready, tiny).df if crowded else ready)
            moving = Stage(state.df.filter("not done"), len(columns), {**state.figures, "_rows": left}, state.path)
            table = moving.df if tiny else moving.small()
            for _ in range(3 if tiny else 1):
                # Closed ways refer to themselves only.
                ahead = table if ringed else together([*parts, table if tiny else moving.df])
                ahead = ahead.select("graph_id", F.col("node").alias("top"), *[F.col(c).alias(f"_{c}") for c in ("top", "dist", "low", "done")])
                table = table.join(beside(ahead, tiny), ["graph_id", "top"]).select(
                    "graph_id", "node", F.col("_top").alias("top"), (F.col("dist") + F.col("_dist")).alias("dist"), F.least("low", "_low").alias("low"), F.col("_done").alias("done")
                )
                reach *= 2
            before, state = left, cut(table, tiny, replaces=state if ringed or crowded else None, open=F.count_if(~F.col("done")))
            left = state["open"]
            # A way that ends has a node to finish in every round, so what stays whole is closed ways alone.
            ringed = left == before
        parts.append(state.df.filter("done"))
        self.inner = inner
        self.closed = left
        self.rings = state.df.filter("not done").select("graph_id", "node", F.col("low").alias("component"))
        self.members = together(parts).select("graph_id", "node", "top", "dist")
        # The last node of a way is the one whose successor is none of these nodes.
        ends = inner.select("graph_id", F.col("node").alias("next"))
        last = inner.join(beside(ends, tiny), ["graph_id", "next"], "left_anti").select("graph_id", "node", F.col("next").alias("behind"))
        tops = inner.select("graph_id", F.col("node").alias("top"), F.col("prev").alias("before"), F.col("len").alias("first"))
        ways = self.members.join(beside(last, tiny), ["graph_id", "node"]).join(beside(tops, tiny), ["graph_id", "top"])
        self.ways = cut(ways.select("graph_id", "top", "before", "behind", "first", (F.col("first") + F.col("dist")).alias("whole")), tiny)

    def shorter(self, arcs: Stage) -> DataFrame:
        """The arcs with each way replaced by one arc; a way back to where it came from is left out."""
        gone = beside(self.inner.select("graph_id", "node"), arcs.tiny)
        behind = self.inner.select("graph_id", F.col("node").alias("_n"), "next")
        # The arc that leaves a way's last node has a length of its own.
        out = arcs.df.join(beside(behind.withColumnsRenamed({"_n": "src", "next": "dst"}), arcs.tiny), [*PAIR])
        last = self.members.withColumnRenamed("node", "src").join(beside(out, arcs.tiny), ["graph_id", "src"])
        lengths = last.select("graph_id", "top", F.col("dst").alias("behind"), F.col("len").alias("_last"))
        made = self.ways.df.join(beside(lengths, arcs.tiny), ["graph_id", "top", "behind"]).filter("before <> behind")
        made = made.select("graph_id", F.col("before").alias("src"), F.col("behind").alias("dst"), (F.col("whole") + F.col("_last")).alias("len"))
        return _lightest(_without(arcs.df, gone, "src", "dst").unionByName(made))


def _spread(arcs: Stage, known: Stage, paths: list[DataFrame]) -> DataFrame:
    """Least lengths from the nodes in ``known`` (``graph_id, node, level``) along the arcs.

    Only nodes that got a smaller level move on; what is known is kept in the parts that were written.
    """
    moving = known
    while moving.rows:
        step = arcs.small(moving).withColumnRenamed("src", "node")
        found = moving.df.join(step, ["graph_id", "node"]).select("graph_id", F.col("dst").alias("node"), (F.col("level") + F.col("len")).alias("level"))
        found = found.groupBy("graph_id", "node").agg(F.min("level").alias("level"))
        old = reduce(DataFrame.unionByName, paths).groupBy("graph_id", "node").agg(F.min("level").alias("_old"))
        better = found.join(beside(old, arcs.tiny), ["graph_id", "node"], "left").filter("_old is null or level < _old").drop("_old")
        moving = cut(better, arcs.tiny)
        paths.append(moving.df)
        if len(paths) > PARTS:
            paths[:] = [cut(reduce(DataFrame.unionByName, paths).groupBy("graph_id", "node").agg(F.min("level").alias("level")), arcs.tiny).df]
    return reduce(DataFrame.unionByName, paths).groupBy("graph_id", "node").agg(F.min("level").alias("level"))


#: Written parts of a search's result before they are made one.
PARTS = 12


def hops(edges: DataFrame, starts: DataFrame, directed: bool = True) -> Stage:
    """Least number of edges from the start nodes: ``graph_id, node, level`` of all reached nodes.

    A round writes only the nodes it reaches first.  A network that is not finished after a few
    rounds is contracted: dead ends are put aside and ways without a fork become one arc,
    again and again, and the search goes on over what is left.
    """
    arcs = cut(arcs_of(edges, directed).withColumn("len", F.lit(1).cast("long")))
    tiny = arcs.tiny
    moving = cut(starts.select("graph_id", "node", F.lit(0).cast("long").alias("level")).distinct())
    parts, depth = [moving.df], 0
    near, steps = None, None
    if tiny:
        # A step of length 0 from each node to itself keeps what it has.
        stay = nodes_of(edges).select("graph_id", "node").unionByName(moving.df.select("graph_id", "node")).distinct()
        stay = stay.select("graph_id", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("len"))
        steps = cut(arcs.df.unionByName(stay), tiny).df.withColumnRenamed("src", "node")
    for _ in range(SHALLOW):
        if tiny:
            # A few steps over the whole state, which is small.
            table = moving.df if near is None else near.df
            for _ in range(TINY_STEPS):
                ahead = steps.join(beside(table, True), ["graph_id", "node"])
                table = ahead.groupBy("graph_id", F.col("dst").alias("node")).agg(F.min(F.col("level") + F.col("len")).alias("level"))
            depth += TINY_STEPS
            near = cut(table, tiny, replaces=near, deepest=F.count_if(F.col("level") == depth))
            going = near["deepest"]
        else:
            depth += 1
            found = moving.small(arcs).join(arcs.df.withColumnRenamed("src", "node"), ["graph_id", "node"])
            found = found.select("graph_id", F.col("dst").alias("node"), F.lit(depth).cast("long").alias("level")).distinct()
            for part in parts:
                found = found.join(part.select("graph_id", "node"), ["graph_id", "node"], "left_anti")
            moving = cut(found)
            parts.append(moving.df)
            going = moving.rows
        if not going:
            return near if tiny else cut(reduce(DataFrame.unionByName, parts))
    near = near if tiny else cut(reduce(DataFrame.unionByName, parts))
    front = Stage(near.df.filter(F.col("level") == depth), 3, {**near.figures, "_rows": near["deepest"] if tiny else moving.rows}, near.path)
    # Only arcs that lead to nodes not reached yet can matter.
    left = cut(_without(arcs.df, near.small(arcs), "dst"), tiny, replaces=arcs)
    layers = []
    while left.rows > FEW_ARCS or not layers:
        before = left.rows
        degrees = _degrees(left, front.df)
        if 4 * degrees["inner"] >= degrees.rows:
            chains = Chains(degrees)
            layers.append(chains)
            left = cut(chains.shorter(left), tiny, replaces=left)
        else:
            # What has no way in is never reached; what has no way out waits for its predecessors.
            loose = degrees.df.filter("not fixed and (o = 0 or i = 0)").select("graph_id", "node", "o")
            ends = left.df.join(beside(loose.filter("o = 0").withColumnRenamed("node", "dst"), tiny), ["graph_id", "dst"], "left_semi")
            layers.append(cut(ends.select(*PAIR, "len"), tiny))
            left = cut(_without(left.df, loose, "src", "dst"), tiny, replaces=left)
        if left.rows > WORTHWHILE * before:
            break
    levels = cut(_spread(left, front, [front.df]), tiny)
    for layer in reversed(layers):
        given = levels.small(layer if isinstance(layer, Stage) else layer.ways)
        if isinstance(layer, Chains):
            tops = layer.ways.df.join(given.withColumnRenamed("node", "before"), ["graph_id", "before"]).select("graph_id", "top", (F.col("level") + F.col("first")).alias("_at"))
            more = layer.members.join(beside(tops, tiny), ["graph_id", "top"]).select("graph_id", "node", (F.col("_at") + F.col("dist")).alias("level"))
        else:
            more = layer.df.join(given.withColumnRenamed("node", "src"), ["graph_id", "src"])
            more = more.groupBy("graph_id", F.col("dst").alias("node")).agg(F.min(F.col("level") + F.col("len")).alias("level"))
        levels = cut(levels.df.unionByName(more.select("graph_id", "node", "level")), tiny, replaces=levels)
    return cut(near.df.unionByName(_without(levels.df, front.df, "node")), tiny)


def reachable_subgraph(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges between nodes that can be reached from the root of their graph."""
    # An edge that starts at a reached node also ends at one.
    reached = hops(edges, roots).small().select("graph_id", F.col("node").alias("src"))
    return edges.join(reached, ["graph_id", "src"], "left_semi").select(*edges.columns)


def reachable_all(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Per graph: number of nodes, number reached from its root, and whether all are."""
    reached = hops(edges, roots).df.groupBy("graph_id").agg(F.count(F.lit(1)).alias("reached"))
    sizes = nodes_of(edges).groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
    seen = F.coalesce("reached", F.lit(0))
    return sizes.join(reached, "graph_id", "left").select(
        "graph_id", "nodes", seen.alias("reached"), (seen == F.col("nodes")).alias("all_reachable")
    )


def _contract(arcs: Stage) -> tuple[Stage, list[Chains], list[DataFrame]]:
    """Trim nodes that no cycle can hold and shorten ways, until every node left has a fork before or behind it.

    Gives the core, the ways in the order in which they were shortened, and the graphs in which one closed.
    """
    tiny, layers, closed = arcs.tiny, [], []
    while arcs.rows:
        before, table = arcs.rows, arcs.df
        for _ in range(2 if tiny else 1):
            entered = table.select("graph_id", F.col("dst").alias("src")).distinct()
            left = table.select("graph_id", F.col("src").alias("dst")).distinct()
            table = table.join(beside(entered, tiny), ["graph_id", "src"], "left_semi").join(beside(left, tiny), ["graph_id", "dst"], "left_semi")
        arcs = cut(table.select(*PAIR, "len"), tiny, replaces=arcs)
        if not arcs.rows:
            break
        degrees = _degrees(arcs)
        if degrees["inner"]:
            chains = Chains(degrees)
            layers.append(chains)
            closed += [chains.rings.select("graph_id"), chains.ways.df.filter(F.col("before") == F.col("behind")).select("graph_id")]
            arcs = cut(chains.shorter(arcs), tiny, replaces=arcs)
        elif arcs.rows == before:
            break
    return arcs, layers, closed


def _coloured(arcs: Stage) -> Stage:
    """``graph_id, node, component``: for each colour the nodes that reach the node it is named after.

    A node's colour is the largest name that reaches it, so all nodes of a strong component share one.
    """
    tiny = arcs.tiny
    steps = 2 if tiny else 1
    ends = arcs.df.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    state = cut(ends.select("graph_id", "node", F.col("node").alias("component"), F.lit(True).alias("fresh")), tiny)
    while state["_rows"]:
        table = state.df
        for _ in range(steps):
            moving = table.filter("fresh").select("graph_id", F.col("node").alias("src"), F.col("component").alias("_c"))
            found = arcs.df.join(beside(moving, tiny), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node")).agg(F.max("_c").alias("_new"))
            larger = F.coalesce(F.col("_new") > F.col("component"), F.lit(False))
            table = table.drop("fresh").join(beside(found, tiny), ["graph_id", "node"], "left").select(
                "graph_id", "node", F.when(larger, F.col("_new")).otherwise(F.col("component")).alias("component"), larger.alias("fresh")
            )
        state = cut(table, tiny, replaces=state, fresh=F.count_if(F.col("fresh")))
        if not state["fresh"]:
            break
    colours = state.df.drop("fresh")
    same = colours.select("graph_id", F.col("node").alias("src"), F.col("component").alias("_c"))
    moving = cut(colours.filter(F.col("node") == F.col("component")), tiny)
    parts = [moving.df]
    while moving.rows:
        back = arcs.df.join(beside(moving.df.withColumnRenamed("node", "dst"), tiny), ["graph_id", "dst"])
        back = back.join(beside(same, tiny), ["graph_id", "src"]).filter(F.col("component") == F.col("_c")).select("graph_id", F.col("src").alias("node"), "component").distinct()
        for part in parts:
            back = back.join(beside(part.select("graph_id", "node"), tiny), ["graph_id", "node"], "left_anti")
        moving = cut(back, tiny)
        parts.append(moving.df)
        if len(parts) > PARTS:
            parts = [cut(reduce(DataFrame.unionByName, parts), tiny).df]
    return cut(reduce(DataFrame.unionByName, parts), tiny)


def strong_components(edges: DataFrame) -> DataFrame:
    """``graph_id, node, component``: the least node name of the strongly connected component.

    Nodes that no cycle can hold are trimmed, ways without a fork are contracted by pointer
    doubling, and what is left is taken apart by forward colours and a backward search inside
    each.  A contracted way belongs to the component of its ends if they share one.
    """
    arcs = cut(arcs_of(edges).withColumn("len", F.lit(1).cast("long")))
    tiny, layers, found = arcs.tiny, [], []
    while arcs.rows:
        arcs, more, _ = _contract(arcs)
        layers += more
        found += [chains.rings for chains in more if chains.closed]
        if arcs.rows:
            solved = _coloured(arcs)
            found.append(solved.df)
            arcs = cut(_without(arcs.df, solved.small(arcs), "src", "dst"), tiny, replaces=arcs)
    nodes = nodes_of(edges)
    if not found and not layers:
        return nodes.withColumn("component", F.col("node"))
    none = nodes.withColumn("component", F.col("node")).limit(0)
    known = cut(reduce(DataFrame.unionByName, found, none), tiny)
    for chains in reversed(layers):
        ends = known.small(chains.ways).select("graph_id", "node", "component")
        first = ends.withColumnsRenamed({"node": "before", "component": "_b"})
        last = ends.withColumnsRenamed({"node": "behind", "component": "_e"})
        ways = chains.ways.df.join(first, ["graph_id", "before"], "left").join(last, ["graph_id", "behind"], "left")
        ways = ways.select("graph_id", "top", F.coalesce("_b", "before").alias("component"), F.coalesce("_e", "behind").alias("_e")).filter("component = _e").drop("_e")
        more = chains.members.join(beside(ways, tiny), ["graph_id", "top"]).select("graph_id", "node", "component")
        known = cut(known.df.unionByName(more), tiny, replaces=known)
    named = nodes.join(known.df, ["graph_id", "node"], "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("graph_id", "component").agg(F.min("node").alias("_least"))
    return named.join(least, ["graph_id", "component"]).select("graph_id", "node", F.col("_least").alias("component"))


def is_dag(edges: DataFrame) -> DataFrame:
    """Per graph whether it is free of directed cycles (a self-loop is a cycle)."""
    graphs = edges.select("graph_id").distinct()
    loops = edges.filter("src = dst").select("graph_id")
    # What is left when nothing can be trimmed or shortened has a cycle, and a way that closes is one.
    core, _, closed = _contract(cut(arcs_of(edges).withColumn("len", F.lit(1).cast("long"))))
    cycles = reduce(DataFrame.unionByName, [loops, *closed, core.df.select("graph_id")]).distinct().withColumn("has_cycles", F.lit(True))
    cyclic = F.coalesce("has_cycles", F.lit(False))
    return graphs.join(cycles, "graph_id", "left").select("graph_id", (~cyclic).alias("is_dag"), cyclic.alias("has_cycles"))


def component_labels(edges: DataFrame) -> DataFrame:
    """``graph_id, node, component``: the least node name of the weakly connected component.

    Every component hooks onto its least neighbour and follows the hooks a few steps;
    edges are then rewritten to component labels, so the table shrinks each round.  The hooks
    of the rounds are put together from the last one back, where they are fewest.
    """
    arcs = cut(arcs_of(edges, directed=False))
    tiny, rounds = arcs.tiny, []
    while arcs.rows:
        hook = arcs.df.groupBy("graph_id", "src").agg(F.min("dst").alias("to"))
        first = cut(hook.select("graph_id", "src", F.least("src", "to").alias("to")), tiny)
        table = first.df
        for _ in range(2):
            ahead = table.select("graph_id", F.col("src").alias("to"), F.col("to").alias("_next"))
            table = table.join(ahead, ["graph_id", "to"]).select("graph_id", "src", F.col("_next").alias("to"))
        hooks = cut(table, tiny, replaces=first)
        rounds.append(hooks)
        ends = hooks.small(arcs)
        arcs = cut(
            arcs.df.join(ends, ["graph_id", "src"])
            .select("graph_id", F.col("to").alias("src"), "dst")
            .join(ends.withColumnsRenamed({"src": "dst", "to": "_d"}), ["graph_id", "dst"])
            .filter("src <> _d")
            .select("graph_id", "src", F.col("_d").alias("dst"))
            .distinct(),
            tiny,
            replaces=arcs,
        )
    if not rounds:
        return nodes_of(edges).withColumn("component", F.col("node"))
    known = rounds.pop()
    while rounds:
        # Every node of a round is in the hooks of that round; those without an arc left end there.
        earlier = rounds.pop()
        later = known.small(earlier).select("graph_id", F.col("src").alias("to"), F.col("to").alias("_to"))
        moved = earlier.df.join(later, ["graph_id", "to"], "left").select("graph_id", "src", F.coalesce("_to", "to").alias("to"))
        known = cut(moved, tiny, replaces=known)
        remove(known.df.sparkSession, earlier.path)
    labels = known.small().select("graph_id", F.col("src").alias("node"), F.col("to").alias("_to"))
    return nodes_of(edges).join(labels, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("_to", "node").alias("component"))


def weak_components(edges: DataFrame) -> DataFrame:
    """Number of weakly connected components and the size of the largest, per graph."""
    sizes = component_labels(edges).groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("_n"))
    return sizes.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("components"), F.max("_n").alias("largest"), F.sum("_n").alias("nodes")
    )


def graph_summary(edges: DataFrame) -> DataFrame:
    """Size, weight, degrees, sources, sinks and density of each graph."""
    degrees = node_strength(edges).groupBy("graph_id").agg(
        F.max("in_degree").alias("max_in_degree"),
        F.max("out_degree").alias("max_out_degree"),
        F.count_if(F.col("in_degree") == 0).alias("sources"),
        F.count_if(F.col("out_degree") == 0).alias("sinks"),
    )
    base = network_metrics(edges).select("graph_id", "nodes", "edges", "total_weight", "density")
    return base.join(degrees, "graph_id").withColumn("average_degree", 2 * F.col("edges") / F.col("nodes"))


# Fixed values of the rank iteration.
DAMPING, RANK_TOLERANCE, RANK_ROUNDS = 0.85, 1e-6, 100


def pagerank(edges: DataFrame, rounds: int = RANK_ROUNDS) -> DataFrame:
    """Weighted PageRank divided by its largest value in the graph.

    Starts uniform, spreads the rank of nodes without out edges evenly, and stops a
    graph when its total change falls below ``nodes * 1e-6``.  A graph that has not come to rest
    after ``rounds`` gets its nodes' degrees instead of ranks, as the method defines.
    """
    nodes = node_strength(edges).select("graph_id", "node", "out_weight")
    sizes = cut(nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")))
    state = cut(
        nodes.join(sizes.small(), "graph_id").select(
            "graph_id", "node", "n", (F.col("out_weight") == 0).alias("stuck"), (1.0 / F.col("n")).alias("rank"), F.lit(None).cast("double").alias("before")
        )
    )
    share = cut(
        edges.join(nodes.withColumnRenamed("node", "src"), ["graph_id", "src"])
        .filter("out_weight > 0")
        .select("graph_id", "src", "dst", (F.col("weight") / F.col("out_weight")).alias("share"))
    )
    n = F.col("n")
    for _ in range(rounds):
        change = F.sum(F.abs(F.col("rank") - F.col("before")))
        graphs = state.df.groupBy("graph_id").agg(
            F.sum(F.when(F.col("stuck"), F.col("rank")).otherwise(0.0)).alias("_lost"),
            F.coalesce(change < F.max("n") * RANK_TOLERANCE, F.lit(False)).alias("_still"),
        )
        rank_side = state.df.select("graph_id", F.col("node").alias("src"), "rank")
        if state.bytes <= share.bytes and state.bytes <= BROADCAST_BYTES:
            rank_side = F.broadcast(rank_side)
        got = rank_side.join(share.df, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node"))
        got = got.agg(F.sum(F.col("rank") * F.col("share")).alias("_got"))
        fresh = DAMPING * (F.coalesce("_got", F.lit(0.0)) + F.col("_lost") / n) + (1 - DAMPING) / n
        moved = state.df.join(got, ["graph_id", "node"], "left").join(
            F.broadcast(graphs) if sizes.bytes <= BROADCAST_BYTES else graphs, "graph_id"
        )
        state = cut(
            moved.select(
                "graph_id",
                "node",
                "n",
                "stuck",
                F.when(F.col("_still"), F.col("rank")).otherwise(fresh).alias("rank"),
                F.col("rank").alias("before"),
                F.col("_still").alias("done"),
            ),
            share.tiny,
            replaces=state,
            open=F.count_if(~F.col("done")),
        )
        if not state["open"]:
            break
    if "done" in state.df.columns and state["open"]:
        return _centrality_of(_ranks_or_degrees(state.df, edges))
    return _centrality_of(state.df)


def _ranks_or_degrees(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranks, but degrees for the graphs that have not come to rest; both are scaled afterwards."""
    degrees = node_strength(edges).select("graph_id", "node", (F.col("in_degree") + F.col("out_degree")).cast("double").alias("_degree"))
    resting = ranks.groupBy("graph_id").agg(F.every("done").alias("_resting"))
    both = ranks.join(resting, "graph_id").join(degrees, ["graph_id", "node"])
    return both.select("graph_id", "node", F.when(F.col("_resting"), F.col("rank")).otherwise(F.col("_degree")).alias("rank"))


def _centrality_of(ranks: DataFrame) -> DataFrame:
    top = ranks.groupBy("graph_id").agg(F.max("rank").alias("_top"))
    return ranks.join(top, "graph_id").select("graph_id", "node", (F.col("rank") / F.col("_top")).alias("centrality"))


#: Bytes of origin rows that a batch of betweenness may hold, and bytes of a row.
BATCH_BYTES, ROW_BYTES = 1 << 30, 64


def distances(arcs: Stage, origins: DataFrame) -> Stage:
    """Shortest distance from the origins to all nodes they reach: ``graph_id, origin, node, dist``."""
    state = cut(origins.select("graph_id", F.col("node").alias("origin"), "node", F.lit(0.0).alias("dist"), F.lit(True).alias("fresh")))
    while True:
        step = arcs.small().withColumnRenamed("src", "node")
        longer = state.df.filter("fresh").join(step, ["graph_id", "node"]).select(
            "graph_id", "origin", F.col("dst").alias("node"), (F.col("dist") + F.col("_len")).alias("dist"), F.lit(None).cast("double").alias("_old")
        )
        known = state.df.select("graph_id", "origin", "node", "dist", F.col("dist").alias("_old"))
        best = known.unionByName(longer).groupBy("graph_id", "origin", "node").agg(F.min("dist").alias("dist"), F.max("_old").alias("_old"))
        fresh = F.col("_old").isNull() | (F.col("dist") < F.col("_old"))
        state = cut(best.select("graph_id", "origin", "node", "dist", fresh.alias("fresh")), replaces=state, fresh=F.count_if(F.col("fresh")))
        if not state["fresh"]:
            return state


def _dependencies(arcs: Stage, origins: DataFrame) -> Stage:
    """``graph_id, node, through``: over these origins, the shares of shortest paths that pass through each node."""
    spark, key = arcs.df.sparkSession, ["graph_id", "origin"]
    far_from = distances(arcs, origins)
    dist = far_from.df.drop("fresh")
    near = dist.withColumnsRenamed({"node": "src", "dist": "_ds"})
    far = dist.withColumnsRenamed({"node": "dst", "dist": "_dd"})
    tight = cut(
        near.join(arcs.df, ["graph_id", "src"]).join(far, ["graph_id", "origin", "dst"])
        .filter(F.col("_ds") + F.col("_len") == F.col("_dd"))
        .select("graph_id", "origin", "src", "dst")
    )
    paths = cut(dist.select(*key, "node", (F.col("origin") == F.col("node")).cast("double").alias("paths")))
    while True:
        got = tight.df.join(paths.df.withColumnRenamed("node", "src"), [*key, "src"]).groupBy(*key, F.col("dst").alias("node")).agg(F.sum("paths").alias("_got"))
        new = F.coalesce("_got", (F.col("origin") == F.col("node")).cast("double"))
        table = paths.df.join(got, [*key, "node"], "left").select(*key, "node", new.alias("paths"), (new != F.col("paths")).alias("_moved"))
        paths = cut(table, replaces=paths, moved=F.count_if(F.col("_moved")))
        if not paths["moved"]:
            break
    counts = paths.df.select(*key, "node", "paths")
    ratio = cut(
        tight.df.join(counts.withColumnsRenamed({"node": "src", "paths": "_ps"}), [*key, "src"])
        .join(counts.withColumnsRenamed({"node": "dst", "paths": "_pd"}), [*key, "dst"])
        .select(*key, "src", "dst", (F.col("_ps") / F.col("_pd")).alias("part")),
        replaces=tight,
    )
    through = cut(counts.select(*key, "node", F.lit(0.0).alias("through")))
    while True:
        got = ratio.df.join(through.df.withColumnRenamed("node", "dst"), [*key, "dst"]).groupBy(*key, F.col("src").alias("node")).agg(
            F.sum(F.col("part") * (1 + F.col("through"))).alias("_got")
        )
        new = F.coalesce("_got", F.lit(0.0))
        moved = F.abs(new - F.col("through")) > 1e-12 * (1 + F.abs(new))
        table = through.df.join(got, [*key, "node"], "left").select(*key, "node", new.alias("through"), moved.alias("_moved"))
        through = cut(table, replaces=through, moved=F.count_if(F.col("_moved")))
        if not through["moved"]:
            break
    sums = cut(through.df.filter("origin <> node").groupBy("graph_id", "node").agg(F.sum("through").alias("through")))
    for stage in (far_from, paths, ratio, through):
        remove(spark, stage.path)
    return sums


def betweenness(edges: DataFrame, max_edges: int | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Normalized weighted shortest-path betweenness.

    A caller who gives ``max_edges`` gets 0 throughout graphs with more edges.  Origins are taken
    in batches, by hash, so many that a batch's rows of origin and node or edge stay near
    ``batch_bytes``: distances, then the number of shortest paths, then the share of paths that
    pass through each node, each along the tight edges.  A batch leaves one sum for each node.
    """
    sizes = nodes_of(edges).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    chosen = edges
    if max_edges is not None:
        counted = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_e")).filter(F.col("_e") <= max_edges)
        chosen = edges.join(counted.drop("_e"), "graph_id", "left_semi")
    arcs = cut(chosen.filter("src <> dst").groupBy(*PAIR).agg(F.min("weight").alias("_len")))
    origins = cut(nodes_of(chosen))
    each = arcs.df.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_m")).join(sizes, "graph_id")
    total = each.agg(F.sum(F.col("n").cast("double") * (F.col("n") + F.col("_m")) * ROW_BYTES)).first()[0] or 0.0
    batches = max(1, math.ceil(total / batch_bytes))
    number = F.pmod(F.xxhash64("graph_id", "node"), F.lit(batches))
    parts = [_dependencies(arcs, origins.df.filter(number == batch)).df for batch in range(batches)]
    sums = reduce(DataFrame.unionByName, parts).groupBy("graph_id", "node").agg(F.sum("through").alias("_sum"))
    n = F.col("n")
    scale = F.when(n > 2, 1.0 / ((n - 1) * (n - 2))).otherwise(F.lit(1.0))
    return nodes_of(edges).join(sums, ["graph_id", "node"], "left").join(sizes, "graph_id").select(
        "graph_id", "node", (F.coalesce("_sum", F.lit(0.0)) * scale).alias("betweenness")
    )
