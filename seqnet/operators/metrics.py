"""Validation of structures, coverage, and comparison of methods and networks.

Every function returns one row per graph (or per graph and method).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqnet.operators.graph import arcs_of, component_labels, graph_summary, hops, is_dag, reachable_all
from seqnet.operators.network import network_metrics, node_strength, nodes_of
from seqnet.operators.trees import ancestors, as_nodes, orient
from seqnet.plans.lineage import cut


def _total(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id").agg(F.sum("weight").alias("original_weight"), F.count(F.lit(1)).alias("original_edges"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def validate_observed(edges: DataFrame) -> DataFrame:
    """Summary of an observed network and whether it has cycles."""
    return graph_summary(edges).join(is_dag(edges), "graph_id")


def _shape(tree: DataFrame, roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    kept = cut(tree.select("graph_id", "src", "dst", "weight")).df
    out = graph_summary(kept).join(is_dag(kept).select("graph_id", "is_dag"), "graph_id").join(_total(edges), "graph_id")
    out = out.withColumn("preserved_percent", _share(F.col("total_weight"), F.col("original_weight")))
    if roots is None:
        return out
    reached = reachable_all(kept, as_nodes(roots)).select("graph_id", "all_reachable")
    degrees = node_strength(kept).join(roots.select("graph_id", "root"), "graph_id")
    at_root = F.col("node") == F.col("root")
    per_root = degrees.groupBy("graph_id").agg(
        F.max(at_root).alias("root_exists"),
        F.max(F.when(at_root, F.col("in_degree"))).alias("root_in_degree"),
        F.coalesce(F.max(F.when(~at_root, F.col("in_degree"))), F.lit(0)).alias("max_other_in_degree"),
    )
    return out.join(reached, "graph_id").join(per_root, "graph_id")


SHAPE = ["graph_id", "nodes", "edges", "total_weight", "preserved_percent", "is_dag"]


def validate_branching(tree: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether the structure is a directed tree that the root spans."""
    count_ok = F.col("edges") == F.col("nodes") - 1
    valid = F.col("root_exists") & (F.col("root_in_degree") == 0) & (F.col("max_other_in_degree") <= 1) & F.col("is_dag") & F.col("all_reachable") & count_ok
    return _shape(tree, roots, edges).select(
        *SHAPE, "root_exists", "root_in_degree", "max_other_in_degree", "all_reachable", count_ok.alias("edge_count_ok"), F.coalesce(valid, F.lit(False)).alias("is_valid")
    )


def validate_forward(tree: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether the structure is an acyclic expansion from the root."""
    count_ok = F.col("edges") <= F.col("nodes") - 1
    valid = F.col("root_exists") & F.col("all_reachable") & F.col("is_dag") & count_ok
    return _shape(tree, roots, edges).select(*SHAPE, "root_exists", "all_reachable", count_ok.alias("edge_count_ok"), valid.alias("is_valid"))


def validate_polytree(tree: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether the structure is acyclic and a tree when directions are dropped."""
    kept = cut(tree.select("graph_id", "src", "dst", "weight")).df
    parts = component_labels(kept).select("graph_id", "component").distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("components"))
    meets = node_strength(kept).groupBy("graph_id").agg(F.count_if(F.col("in_degree") > 1).alias("convergence_nodes"))
    links = arcs_of(kept.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
    pairs = links.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_links"))
    count_ok = F.col("edges") == F.col("nodes") - 1
    tree_ok = (F.col("components") == 1) & (F.col("_links") == F.col("nodes") - 1)
    out = _shape(kept, None, edges).join(parts, "graph_id").join(meets, "graph_id").join(pairs, "graph_id")
    return out.select(
        *SHAPE, "components", "convergence_nodes", tree_ok.alias("undirected_is_tree"), count_ok.alias("edge_count_ok"), (F.col("is_dag") & tree_ok & count_ok).alias("is_valid")
    )


def coverage(original: DataFrame, filtered: DataFrame, structure: DataFrame) -> DataFrame:
    """Nodes, edges and weight that a filtered and a condensed network keep of the original."""

    def size(edges: DataFrame, name: str) -> DataFrame:
        sums = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias(f"{name}_edges"), F.sum("weight").alias(f"{name}_weight"))
        nodes = nodes_of(edges).groupBy("graph_id").agg(F.count(F.lit(1)).alias(f"{name}_nodes"))
        return sums.join(nodes, "graph_id")

    left_out = nodes_of(original).join(nodes_of(structure), ["graph_id", "node"], "left_anti")
    missing = left_out.groupBy("graph_id").agg(F.count(F.lit(1)).alias("uncovered_nodes"))
    parts = component_labels(original).select("graph_id", "component").distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("components"))
    out = size(original, "original").join(size(filtered, "filtered"), "graph_id", "left").join(size(structure, "structure"), "graph_id", "left")
    out = out.join(missing, "graph_id", "left").join(parts, "graph_id").na.fill(0)
    return out.select(
        *[c for c in out.columns if c != "components"],
        _share(F.col("structure_nodes"), F.col("original_nodes")).alias("node_coverage_percent"),
        _share(F.col("structure_weight"), F.col("original_weight")).alias("preserved_weight_percent"),
        (F.col("original_edges") - F.col("filtered_edges")).alias("removed_edges"),
        (F.col("original_weight") - F.col("filtered_weight")).alias("removed_weight"),
        "components",
    )


def uncovered_nodes(original: DataFrame, structure: DataFrame) -> DataFrame:
    return nodes_of(original).join(nodes_of(structure), ["graph_id", "node"], "left_anti")


# Shares of the interpretability score.
SCORE_WEIGHT, SCORE_BRANCHING, SCORE_NODES = 0.4, 0.3, 0.3


def polytree_metrics(edges: DataFrame, polytree: DataFrame) -> DataFrame:
    """Size, depth, branching, density and interpretability of an exploratory poly-tree."""
    rows = cut(polytree).df
    merged = cut(rows.groupBy("graph_id", "src", "dst").agg(F.max("weight").alias("weight"))).df
    before = network_metrics(edges).select("graph_id", F.col("nodes").alias("original_nodes"), F.col("edges").alias("original_edges"), F.col("total_weight").alias("original_weight"), F.col("density").alias("density_before"))
    after = network_metrics(merged).select("graph_id", F.col("nodes").alias("polytree_nodes"), F.col("edges").alias("distinct_edges"), F.col("total_weight").alias("polytree_weight"), F.col("density").alias("density_after"))
    per_source = rows.groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("_b"))
    branching = per_source.groupBy("graph_id").agg(F.avg("_b").alias("average_branching"))
    per_target = rows.groupBy("graph_id", "dst").agg(F.count(F.lit(1)).alias("_r"))
    repeats = per_target.groupBy("graph_id").agg(F.sum(F.col("_r") - 1).alias("repeated_nodes"), F.count(F.lit(1)).alias("_targets"))
    aggs = [F.count(F.lit(1)).alias("polytree_edges"), F.max("level").alias("max_depth")]
    if "score" in rows.columns:
        aggs.append(F.avg("score").alias("average_score"))
    size = rows.groupBy("graph_id").agg(*aggs)
    out = before.join(after, "graph_id").join(branching, "graph_id").join(repeats, "graph_id").join(size, "graph_id")
    kept = F.least(F.lit(1.0), F.when(F.col("original_weight") > 0, F.col("polytree_weight") / F.col("original_weight")).otherwise(0.0))
    nodes = F.least(F.lit(1.0), F.col("_targets") / F.greatest(F.lit(1), F.col("polytree_nodes")))
    score = (SCORE_WEIGHT * kept + SCORE_BRANCHING / (1 + F.col("average_branching")) + SCORE_NODES * nodes) * 100
    return out.withColumns(
        {
            "preserved_weight_percent": _share(F.col("polytree_weight"), F.col("original_weight")),
            "edge_reduction_percent": (1 - F.col("distinct_edges") / F.col("original_edges")) * 100,
            "interpretability_score": score,
        }
    ).drop("_targets")


def weight_by_level(polytree: DataFrame) -> DataFrame:
    return polytree.groupBy("graph_id", "level").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("edges"))


def condensation_metrics(edges: DataFrame, tree: DataFrame, reachable: DataFrame | None = None) -> DataFrame:
    """Compression and preserved weight of a condensed network."""
    chosen = tree.groupBy("graph_id").agg(F.count(F.lit(1)).alias("output_edges"), F.sum("weight").alias("preserved_weight"))
    inside = (edges if reachable is None else reachable).groupBy("graph_id").agg(F.sum("weight").alias("reachable_weight"))
    out = _total(edges).join(chosen, "graph_id").join(inside, "graph_id")
    return out.select(
        "graph_id",
        F.col("original_edges").alias("input_edges"),
        "output_edges",
        (F.col("original_edges") - F.col("output_edges")).alias("removed_edges"),
        (F.col("output_edges") / F.col("original_edges")).alias("compression_ratio"),
        "preserved_weight",
        _share(F.col("preserved_weight"), F.col("original_weight")).alias("preserved_weight_percent"),
        _share(F.col("preserved_weight"), F.col("reachable_weight")).alias("preserved_reachable_percent"),
    )


def tree_center(tree: DataFrame) -> DataFrame:
    """Center of an undirected tree; the lesser name of two.

    The farthest node from any node is one end of a longest path, the farthest from that the
    other; the center is the node nearest to the farther of the two ends.  Each of the three
    sweeps takes rounds that grow with the logarithm of the depth.
    """
    links = arcs_of(tree.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
    links = cut(links.withColumn("weight", F.lit(1.0)))
    if not links.rows:
        return nodes_of(tree).groupBy("graph_id").agg(F.min("node").alias("center"))

    def levels(starts: DataFrame) -> DataFrame:
        reached = ancestors(cut(orient(links.df, starts))).df.select("graph_id", "node", "level")
        return reached.unionByName(starts.select("graph_id", "node", F.lit(0).cast("long").alias("level")))

    def farthest(found: DataFrame) -> DataFrame:
        return cut(found.groupBy("graph_id").agg(F.max_by("node", F.struct("level", "node")).alias("node"))).df

    one = farthest(levels(nodes_of(links.df).groupBy("graph_id").agg(F.min("node").alias("node"))))
    from_one = cut(levels(one)).df
    from_other = levels(farthest(from_one)).withColumnRenamed("level", "_other")
    reach = F.struct(F.greatest("level", "_other"), F.col("node"))
    centers = from_one.join(from_other, ["graph_id", "node"]).groupBy("graph_id").agg(F.min_by("node", reach).alias("center"))
    alone = nodes_of(tree).join(centers, "graph_id", "left_anti").groupBy("graph_id").agg(F.min("node").alias("center"))
    return centers.unionByName(alone)


def center_search(edges: DataFrame) -> tuple[DataFrame, int]:
    """``graph_id, center, eccentricity``, and the number of sweeps it took.

    A sweep gives a node's eccentricity, and from it a lower bound for every other node's: the
    distance, and the eccentricity less the distance.  Sweeps start in turn at the node of least
    bound and at the node farthest from it, and a graph is done when no bound is below the
    best eccentricity found; all graphs are swept together.
    """
    both = arcs_of(edges, directed=False)
    weight = node_strength(edges).select("graph_id", "node", (F.col("out_weight") + F.col("in_weight")).alias("weight"))
    zero = F.lit(0).cast("long")
    state = cut(weight.select("graph_id", "node", "weight", zero.alias("bound"), F.lit(False).alias("swept"), zero.alias("level")))
    sizes = state.df.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"))
    arcs = cut(both)
    sweeps, rank = 0, F.struct(F.col("bound").cast("double").alias("e"), (-F.col("weight")).alias("w"), F.col("node").alias("node"))
    apart = None
    while True:
        best = state.df.filter("swept").groupBy("graph_id").agg(F.min(rank).alias("_best"))
        open_ = state.df.filter("not swept").withColumn("rank", rank).join(best, "graph_id", "left").filter("_best is null or rank < _best")
        if apart is not None:
            open_ = open_.join(apart.small(state), "graph_id", "left_anti")
        # Every second sweep goes to the far side, as long as some node there has not been swept.
        left = state.df.join(open_.select("graph_id").distinct(), "graph_id", "left_semi").filter("not swept")
        near = open_.groupBy("graph_id").agg(F.min_by("node", "rank").alias("node"))
        picked = near if sweeps % 2 == 0 else left.groupBy("graph_id").agg(F.max_by("node", F.struct("level", "node")).alias("node"))
        starts = cut(picked.select("graph_id", "node"), state.tiny)
        if not starts.rows:
            break
        sweeps += 1
        levels = hops(arcs.df, starts.df)
        far = levels.df.groupBy("graph_id").agg(F.max("level").alias("_e"), F.count(F.lit(1)).alias("_r"))
        if apart is None:
            # The first sweep of a graph in pieces does not reach all of it.
            apart = cut(far.join(sizes, "graph_id").filter("_r < _n").select("graph_id"), state.tiny)
        found = levels.small(state).withColumnRenamed("level", "_d")
        begun = starts.small(state).withColumn("_start", F.lit(True))
        told = state.df.join(found, ["graph_id", "node"], "left").join(far.drop("_r"), "graph_id", "left").join(begun, ["graph_id", "node"], "left")
        bound = F.greatest("bound", F.coalesce(F.greatest("_d", F.col("_e") - F.col("_d")), zero))
        start = F.coalesce("_start", F.lit(False))
        state = cut(
            told.select(
                "graph_id", "node", "weight", F.when(start, F.col("_e")).otherwise(bound).alias("bound"), (F.col("swept") | start).alias("swept"), F.coalesce("_d", "level").alias("level")
            ),
            state.tiny,
            replaces=state,
        )
    whole = state.df if apart is None else state.df.join(apart.small(state), "graph_id", "left_anti")
    done = whole.filter("swept").groupBy("graph_id").agg(F.min(rank).alias("b")).select("graph_id", F.col("b.node").alias("center"), F.col("b.e").alias("eccentricity"))
    if apart is None:
        return done, sweeps
    far_apart = state.df.join(apart.small(state), "graph_id", "left_semi").groupBy("graph_id")
    pieces = far_apart.agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("node").alias("node"))).alias("b"))
    return done.unionByName(pieces.select("graph_id", F.col("b.node").alias("center"), F.lit(float("inf")).alias("eccentricity"))), sweeps


def graph_center(edges: DataFrame) -> DataFrame:
    """Node of least undirected eccentricity; ties by total weight, then name.

    In a graph of several components every eccentricity is infinite.
    """
    return center_search(edges)[0]


# Names of the compared methods.
METHODS = ["rooted_branching", "forward", "back_and_forward"]


def method_row(method: str, edges: DataFrame, tree: DataFrame, anchor: DataFrame) -> DataFrame:
    """One comparison row per graph for a finished structure; ``anchor`` has ``graph_id, anchor``."""
    kept = cut(tree.select("graph_id", "src", "dst", "weight")).df
    nodes = nodes_of(kept).groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
    size = kept.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("selected_weight"))
    parts = component_labels(kept).select("graph_id", "component").distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("_parts"))
    original = network_metrics(edges).select("graph_id", F.col("nodes").alias("original_nodes"), F.col("edges").alias("original_edges"), F.col("total_weight").alias("weight_sum"))
    out = original.join(size, "graph_id").join(nodes, "graph_id").join(parts, "graph_id").join(is_dag(kept).select("graph_id", "is_dag"), "graph_id").join(anchor, "graph_id")
    return out.select(
        "graph_id",
        F.lit(method).alias("method"),
        "original_nodes",
        "original_edges",
        "nodes",
        "edges",
        "weight_sum",
        "selected_weight",
        _share(F.col("selected_weight"), F.col("weight_sum")).alias("preserved_percent"),
        F.col("is_dag").alias("acyclic"),
        (F.col("_parts") == 1).alias("connected"),
        "anchor",
    )


def compare_methods(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def best_methods(comparison: DataFrame) -> DataFrame:
    """Per graph: the method that preserves most, the ones with fewest edges, the most structural one."""
    by_weight = F.struct(-F.col("preserved_percent"), F.col("method"))
    structural = F.struct((~F.col("connected")).cast("int"), -F.col("nodes"), -F.col("edges"), F.col("method"))
    simple = F.struct("edges", "method")
    return comparison.groupBy("graph_id").agg(
        F.min_by("method", by_weight).alias("best_by_weight"),
        F.min_by("method", simple).alias("simplest"),
        F.min_by("method", structural).alias("most_structural"),
    )


def rank_methods(comparison: DataFrame) -> DataFrame:
    """Mean and population deviation of the preserved share, mean edges and wins per method."""
    wins = best_methods(comparison).groupBy(F.col("best_by_weight").alias("method")).agg(F.count(F.lit(1)).alias("wins"))
    ranked = comparison.groupBy("method").agg(
        F.count(F.lit(1)).alias("graphs"),
        F.avg("preserved_percent").alias("mean_preserved_percent"),
        F.stddev_pop("preserved_percent").alias("std_preserved_percent"),
        F.avg("edges").alias("mean_edges"),
    )
    out = ranked.join(wins, "method", "left").na.fill({"wins": 0})
    # One row per method, so a single ordered window is safe.
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_preserved_percent"), "method")).cast("long"))


# Limits of the structure and recurrence classes.
SMALL_NODES, DENSE, SPARSE, HIGH_PRESERVED = 10, 0.7, 0.05, 80.0
STRONG_AVERAGE, UNIQUE_AVERAGE, MANY_NODES, MID_NODES, MID_DENSITY, UNIQUE_GAP = 5.0, 1.5, 100, 50, 0.2, 0.01


def classify_structure(metrics: DataFrame) -> DataFrame:
    """Structural class from ``nodes, density, preserved_percent``."""
    n, d = F.col("nodes"), F.col("density")
    label = (
        F.when((n <= SMALL_NODES) & (d >= DENSE), "small_complete")
        .when(d >= DENSE, "dense")
        .when((d <= SPARSE) & (F.col("preserved_percent") >= HIGH_PRESERVED), "near_linear")
        .otherwise("intermediate")
    )
    return metrics.withColumn("structure", label)


def classify_scenario(metrics: DataFrame) -> DataFrame:
    """Report scenario from ``nodes, density, average_weight``."""
    n, d = F.col("nodes"), F.col("density")
    label = (
        F.when((n <= SMALL_NODES) & (d >= DENSE), "small")
        .when((d >= DENSE) & (n > SMALL_NODES), "dense")
        .when((d <= SPARSE) & (F.col("average_weight") <= UNIQUE_AVERAGE), "sparse")
        .otherwise("intermediate")
    )
    return metrics.withColumn("scenario", label)


def classify_network(metrics: DataFrame) -> DataFrame:
    """Recurrence class from ``nodes, edges, total_weight, density``."""
    average = F.when(F.col("edges") > 0, F.col("total_weight") / F.col("edges")).otherwise(F.lit(0.0))
    label = (
        F.when((F.col("edges") > 0) & (F.abs(F.col("total_weight") - F.col("edges")) < UNIQUE_GAP), "no_repetition")
        .when((F.col("nodes") <= SMALL_NODES) & (average >= STRONG_AVERAGE), "strong_recurrent")
        .when((F.col("nodes") >= MANY_NODES) & (F.col("density") >= MID_DENSITY), "dense")
        .when((F.col("nodes") >= MID_NODES) & (average <= UNIQUE_AVERAGE), "mostly_unique")
        .otherwise("intermediate")
    )
    return metrics.withColumn("recurrence", label)


def compare_networks(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Size, density and preserved share of each network beside its condensed structure."""
    chosen = tree.groupBy("graph_id").agg(F.count(F.lit(1)).alias("structure_edges"), F.sum("weight").alias("structure_weight"))
    out = network_metrics(edges).select("graph_id", "nodes", "edges", "total_weight", "density").join(chosen, "graph_id", "left").na.fill(0)
    return out.withColumn("preserved_percent", _share(F.col("structure_weight"), F.col("total_weight")))
