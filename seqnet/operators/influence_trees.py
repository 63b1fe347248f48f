"""Structures extracted from influence networks, and walks through them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqnet.operators.graph import component_labels, is_dag, nodes_of
from seqnet.operators.network import PAIR, node_strength, relative_weight
from seqnet.operators.trees import (
    BACKWARD,
    FORWARD,
    INITIAL,
    ancestors,
    cycle_members,
    edge_key,
    orient,
    polytree_levels,
    spanning_forest,
)
from seqnet.plans.lineage import Stage, cut

# Fixed value: default depth cap.
MAX_DEPTH = 10


def infer_initial_node(edges: DataFrame, force: str = "auto", provided: DataFrame | None = None) -> DataFrame:
    """``graph_id, root, mode`` with a null root where no initial node can be named.

    Graphs without a row in ``provided`` have theirs inferred.
    """
    if provided is not None:
        named = provided.select("graph_id", F.col("root").alias("node"))
        known = named.join(nodes_of(edges), ["graph_id", "node"], "left_anti")
        if not known.isEmpty():
            raise ValueError("a given initial node is not in its network")
        given = provided.select("graph_id", "root", F.lit("provided").alias("mode"))
        return given.unionByName(infer_initial_node(edges, force).join(given, "graph_id", "left_anti"))
    nodes = node_strength(edges).filter("out_degree > 0")
    free = F.col("in_degree") == 0
    rank = F.struct("out_weight", "node")
    root = F.max_by("node", F.when(free, rank))
    if force == "forward":
        root = F.coalesce(root, F.max_by("node", rank))
    if force == "back_and_forward":
        root = F.lit(None).cast("string")
    picked = nodes.groupBy("graph_id").agg(root.alias("root"))
    return picked.withColumn("mode", F.when(F.col("root").isNull(), "none").otherwise("inferred"))


def forum_forward_tree(
    edges: DataFrame, roots: DataFrame, top_k: int = 1, max_depth: int = MAX_DEPTH, min_weight: float | None = None
) -> DataFrame:
    """Level by level, nodes in first-in order take their ``top_k`` heaviest free targets.

    Within a level all nodes propose together; a target keeps the earliest proposer and
    the others propose again, which ends in the same assignment as taking turns.  The
    place in the queue is the list of ranks on the way from the root.
    """
    arcs = cut(edges.select(*PAIR, "weight") if min_weight is None else edges.filter(F.col("weight") >= min_weight).select(*PAIR, "weight"))
    start = cut(roots.filter("root is not null").select("graph_id", F.col("root").alias("node"), F.array().cast("array<int>").alias("place")))
    front, visited, picked = start.small(arcs), [start.df.select("graph_id", "node")], []
    best = Window.partitionBy("graph_id", "src").orderBy(F.desc("weight"), "dst")
    for level in range(1, max_depth + 1):
        seen = reduce(DataFrame.unionByName, visited).withColumnRenamed("node", "dst")
        wishes = arcs.df.join(front.withColumnRenamed("node", "src"), ["graph_id", "src"]).join(seen, ["graph_id", "dst"], "left_anti")
        wishes = wishes.select(*PAIR, "weight", "place")
        while True:
            asked = wishes.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)
            first = asked.groupBy("graph_id", "dst").agg(F.min("place").alias("_first"))
            table = asked.join(first, ["graph_id", "dst"]).withColumn("lost", F.col("place") > F.col("_first"))
            offers = cut(table, arcs.tiny, lost=F.count_if(F.col("lost")))
            if not offers["lost"]:
                break
            taken = offers.df.filter("not lost").select("graph_id", "dst", "_first")
            kept = wishes.join(taken, ["graph_id", "dst"], "left").filter("_first is null or place <= _first")
            wishes = cut(kept.select(*PAIR, "weight", "place"), arcs.tiny).df
        if not offers.rows:
            break
        step = offers.small(arcs).select(*PAIR, "weight", F.lit(level).cast("long").alias("level"), F.concat("place", F.array("rank")).alias("place"))
        picked.append(step)
        front = step.select("graph_id", F.col("dst").alias("node"), "place")
        visited.append(front.select("graph_id", "node"))
    if not picked:
        return arcs.df.limit(0).withColumns({"level": F.lit(0).cast("long"), "direction": F.lit(FORWARD)})
    return reduce(DataFrame.unionByName, picked).select(*PAIR, "weight", "level", F.lit(FORWARD).alias("direction"))


def _grow(arcs: Stage, starts: DataFrame, max_depth: int, max_edges: int | None) -> DataFrame:
    """One edge per round and graph; only for graphs that reach the depth cap or an edge limit."""
    first = cut(starts)
    state = cut(
        first.df.select(
            "graph_id",
            F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(0).cast("long").alias("at")), F.struct(F.col("dst").alias("node"), F.lit(1).cast("long").alias("at")))),
        )
    )
    out = [first.df.select(*PAIR, "weight", F.lit(0).cast("long").alias("level"), F.lit(INITIAL).alias("direction"))]
    step = 1
    while max_edges is None or step < max_edges:
        ends = state.small(arcs)
        near = arcs.df.join(ends.filter(F.col("at") < max_depth), ["graph_id", "node"])
        free = near.join(ends.select("graph_id", F.col("node").alias("new")), ["graph_id", "new"], "left_anti")
        best = cut(free.groupBy("graph_id").agg(F.min(F.struct("key", "new", "at", "direction")).alias("b")), arcs.tiny)
        if not best.rows:
            break
        level = F.col("b.at") + 1
        out.append(
            best.df.select("graph_id", "b.key.src", "b.key.dst", (-F.col("b.key.nw")).alias("weight"), level.alias("level"), F.col("b.direction").alias("direction"))
        )
        state = cut(state.df.unionByName(best.df.select("graph_id", F.col("b.new").alias("node"), level.alias("at"))), arcs.tiny)
        step += 1
        if len(out) > 30:
            out = [cut(reduce(DataFrame.unionByName, out)).df]
    return reduce(DataFrame.unionByName, out)


def forum_polytree(
    edges: DataFrame, max_depth: int = MAX_DEPTH, min_weight: float | None = None, max_edges: int | None = None
) -> DataFrame:
    """Growth from the heaviest edge in either direction, with a depth cap and an optional edge limit.

    Without a limit and within the cap this is the maximum spanning tree of the start
    component.  A graph whose heaviest edge is a self-loop keeps that edge alone.
    """
    kept = edges if min_weight is None else edges.filter(F.col("weight") >= min_weight)
    base = cut(kept.select(*PAIR, "weight"))
    starts = cut(
        base.df.groupBy("graph_id").agg(F.max(F.struct("weight", "src", "dst")).alias("s")).select("graph_id", "s.src", "s.dst", "s.weight")
    )
    loops = starts.df.filter("src = dst")
    alone = loops.select(*PAIR, "weight", F.lit(0).cast("long").alias("level"), F.lit(INITIAL).alias("direction"))
    grown = starts.df.filter("src <> dst")
    usable = base.df.filter("src <> dst").join(grown.select("graph_id"), "graph_id", "left_semi")
    if max_edges is None:
        # Equal heaviest edges: the start edge is the one with the larger name.
        top = usable.join(grown.withColumn("_go", F.lit(True)).drop("weight"), PAIR, "left")
        lifted = top.select(*PAIR, F.when(F.col("_go"), F.lit(float("inf"))).otherwise(F.col("weight")).alias("weight"))
        forest = cut(spanning_forest(lifted).select(*PAIR)).df.join(base.df, PAIR)
        full = cut(polytree_levels(forest, grown), deepest=F.max("level"))
        if full.rows == 0 or full["deepest"] <= max_depth:
            return full.df.unionByName(alone)
        deep = cut(full.df.groupBy("graph_id").agg(F.max("level").alias("_l")).filter(F.col("_l") > max_depth).select("graph_id"))
        shallow = full.df.join(deep.small(), "graph_id", "left_anti")
        usable = usable.join(deep.small(), "graph_id", "left_semi")
        grown = grown.join(deep.small(), "graph_id", "left_semi")
    else:
        shallow = alone.limit(0)
    key = edge_key()
    arcs = cut(
        usable.select(
            "graph_id",
            F.inline(
                F.array(
                    F.struct(F.col("src").alias("node"), F.col("dst").alias("new"), key.alias("key"), F.lit(FORWARD).alias("direction")),
                    F.struct(F.col("dst").alias("node"), F.col("src").alias("new"), key.alias("key"), F.lit(BACKWARD).alias("direction")),
                )
            ),
        )
    )
    return shallow.unionByName(_grow(arcs, grown, max_depth, max_edges)).unionByName(alone)


def simplified_influence(edges: DataFrame) -> DataFrame:
    """At most one edge per origin, by share of the origin's weight, without directed cycles.

    Every origin holds its best live edge; the lowest-ordered edge of each cycle is
    deleted for good, its origin moves on to its next edge, until no cycle is left.
    """
    live = cut(relative_weight(edges))
    tiny = live.tiny
    order = F.struct((-F.col("relative_weight")).alias("share"), (-F.col("weight")).alias("nw"), F.col("src"), F.col("dst"))
    while True:
        best = cut(live.df.groupBy("graph_id", "src").agg(F.min(order).alias("b")), tiny)
        cycles = cycle_members(best.df.select("graph_id", F.col("src").alias("node"), F.col("b.dst").alias("to")), best)
        members = best.df.join(cycles.withColumnRenamed("node", "src"), ["graph_id", "src"])
        weak = cut(members.groupBy("graph_id", "rep").agg(F.max("b").alias("b")).select("graph_id", "b.src", "b.dst"), tiny)
        if not weak.rows:
            break
        live = cut(live.df.join(weak.small(live), PAIR, "left_anti"), tiny)
    return best.df.select("graph_id", "b.src", "b.dst", (-F.col("b.nw")).alias("weight"), (-F.col("b.share")).alias("relative_weight"))


# Number of walks per graph and nodes per walk.
WALKS, WALK_NODES = 3, 6


def greedy_walks(edges: DataFrame, walks: int = WALKS, max_nodes: int = WALK_NODES) -> DataFrame:
    """From the origins with the largest out weight, follow the edge of the largest share, no node twice."""
    shares = cut(relative_weight(edges))
    heavy = Window.partitionBy("graph_id").orderBy(F.desc("out_weight"), "node")
    starts = node_strength(shares.df).filter("out_degree > 0").withColumn("rank", F.row_number().over(heavy)).filter(F.col("rank") <= walks)
    zero = F.lit(0.0)
    state = cut(starts.select("graph_id", F.col("node").alias("start"), F.col("node").alias("src"), F.array("node").alias("items"), zero.alias("total_weight"), zero.alias("shares"), F.lit(True).alias("open")))
    for _ in range(max_nodes - 1):
        ways = state.small(shares).filter("open").join(shares.df, ["graph_id", "src"]).filter(~F.array_contains("items", F.col("dst")))
        order = F.struct((-F.col("relative_weight")).alias("s"), (-F.col("weight")).alias("w"), F.col("dst").alias("d"))
        step = ways.groupBy("graph_id", "start").agg(F.min(order).alias("b"))
        table = state.df.join(step, ["graph_id", "start"], "left").select(
            "graph_id",
            "start",
            F.coalesce("b.d", "src").alias("src"),
            F.when(F.col("b").isNull(), F.col("items")).otherwise(F.concat("items", F.array("b.d"))).alias("items"),
            (F.col("total_weight") - F.coalesce("b.w", zero)).alias("total_weight"),
            (F.col("shares") - F.coalesce("b.s", zero)).alias("shares"),
            F.col("b").isNotNull().alias("open"),
        )
        state = cut(table, shares.tiny, open=F.count_if(F.col("open")))
        if not state["open"]:
            break
    return state.df.filter(F.size("items") > 1).select(
        "graph_id", "start", F.concat_ws(" -> ", "items").alias("path"), "total_weight", (F.col("shares") / (F.size("items") - 1)).alias("average_relative_weight")
    )


def forward_dominant_walk(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """From the root always to the heaviest child: ``graph_id, step, src, dst, weight``."""
    best = tree.groupBy("graph_id", "src").agg(F.max(F.struct("weight", "dst")).alias("b")).select("graph_id", "src", "b.dst", "b.weight")
    chain = cut(best)
    tops = ancestors(chain).small(chain).select("graph_id", F.col("node").alias("dst"), "top", F.col("level").alias("step"))
    start = roots.select("graph_id", F.col("root").alias("top"))
    return chain.df.join(tops, ["graph_id", "dst"]).join(start, ["graph_id", "top"], "left_semi").select("graph_id", "step", "src", "dst", "weight")


def polytree_dominant_path(tree: DataFrame) -> DataFrame:
    """Heaviest path of an undirected tree, step by step, with the direction of each edge.

    Two sweeps: the farthest node from any node is one end, the farthest node from that
    end is the other.
    """
    kept = cut(tree.filter("src <> dst").select(*PAIR, "weight", "direction"))
    any_node = nodes_of(kept.df).groupBy("graph_id").agg(F.min("node").alias("node"))

    def farthest(starts: DataFrame) -> DataFrame:
        ways = ancestors(cut(orient(kept.df, starts)), paths=True).df
        far = F.struct(-F.col("path_weight"), F.col("node"))
        best = F.struct("node", "top", "path")
        return ways.groupBy("graph_id").agg(F.min_by(best, far).alias("b")).select("graph_id", "b.node", "b.top", "b.path")

    one_end = cut(farthest(any_node).select("graph_id", "node"))
    path = farthest(one_end.df)
    # Read the path from its end with the smaller name.
    items = F.concat(F.array("top"), "path")
    items = F.when(F.col("top") <= F.col("node"), items).otherwise(F.reverse(items))
    steps = F.arrays_zip(F.slice("i", 1, F.size("i") - 1).alias("a"), F.slice("i", 2, F.size("i") - 1).alias("b"))
    walked = path.select("graph_id", items.alias("i")).select("graph_id", F.posexplode(steps).alias("p", "s")).select("graph_id", (F.col("p") + 1).cast("long").alias("step"), "s.a", "s.b")
    both = kept.df.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), "weight", "direction").unionByName(
        kept.df.select("graph_id", F.col("dst").alias("a"), F.col("src").alias("b"), "weight", "direction")
    )
    return walked.join(both, ["graph_id", "a", "b"]).select("graph_id", "step", F.col("a").alias("src"), F.col("b").alias("dst"), "weight", "direction")


HEURISTICS = ["auto", "forward", "back_and_forward"]


def extract_structure(
    edges: DataFrame,
    force: str = "auto",
    provided: DataFrame | None = None,
    top_k: int = 1,
    max_depth: int = MAX_DEPTH,
    min_weight: float | None = None,
    max_edges: int | None = None,
) -> DataFrame:
    """Selected edges per graph: a forward tree where an initial node is known, else a poly-tree."""
    if force not in HEURISTICS:
        raise ValueError(f"force must be one of {HEURISTICS}")
    base = cut(edges.filter("weight > 0").select(*PAIR, "weight"))
    roots = cut(infer_initial_node(base.df, force, provided), rooted=F.count_if(F.col("root").isNotNull()))
    parts = []
    if roots["rooted"]:
        parts.append(forum_forward_tree(base.df, roots.df, top_k, max_depth, min_weight).withColumn("heuristic", F.lit("forward")))
    if roots["rooted"] < roots.rows:
        rest = base.df.join(roots.df.filter("root is null"), "graph_id", "left_semi")
        parts.append(forum_polytree(rest, max_depth, min_weight, max_edges).withColumn("heuristic", F.lit("back_and_forward")))
    if not parts:
        return base.df.limit(0).withColumn("heuristic", F.lit(""))
    columns = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def structure_summary(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Size, preserved weight and shape flags of the selected structure of each graph."""
    chosen = cut(selected).df
    total = edges.filter("weight > 0").groupBy("graph_id").agg(F.sum("weight").alias("total_weight"), F.count(F.lit(1)).alias("edges_before"))
    size = chosen.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges_after"), F.sum("weight").alias("selected_weight"), F.first("heuristic").alias("heuristic"))
    nodes = node_strength(chosen).groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("nodes_after"), F.max("in_degree").alias("_in"), F.count_if(F.col("in_degree") == 0).alias("_free")
    )
    parts = component_labels(chosen).select("graph_id", "component").distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("_parts"))
    dag = is_dag(chosen).select("graph_id", "is_dag")
    all_of = size.join(nodes, "graph_id").join(parts, "graph_id").join(dag, "graph_id").join(total, "graph_id")
    whole = F.col("_parts") == 1
    lean = F.col("edges_after") == F.col("nodes_after") - 1
    return all_of.select(
        "graph_id",
        "heuristic",
        "edges_before",
        "nodes_after",
        "edges_after",
        "total_weight",
        "selected_weight",
        (F.col("selected_weight") / F.col("total_weight") * 100).alias("preserved_percent"),
        "is_dag",
        (F.col("is_dag") & whole & (F.col("_in") <= 1)).alias("is_tree"),
        (F.col("is_dag") & whole & lean).alias("is_polytree"),
    )
