"""Depth-bounded exploratory poly-trees: top-k per path and multi-objective."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqnet.operators.graph import pagerank
from seqnet.operators.network import PAIR, node_strength
from seqnet.plans.lineage import cut

# Default parameters of the exploratory poly-trees.
TOP_K, MAX_DEPTH, MAX_BRANCHING, MIN_SCORE, PRESERVE_TARGET = 2, 5, 3, 0.0, 0.7
# Limits of the reasons given for an edge.
HEAVY, LIKELY, COVERING, CENTRAL, REPEATED = 0.7, 0.5, 0.05, 0.65, 0.35
ALPHA, BETA, GAMMA, DELTA, EPSILON, ZETA = 0.35, 0.25, 0.15, 0.15, 0.05, 0.05


def topk_polytree(
    edges: DataFrame, roots: DataFrame, top_k: int = TOP_K, max_depth: int = MAX_DEPTH, min_weight: float | None = None
) -> DataFrame:
    """Every path takes its ``top_k`` heaviest next edges, no node twice on a path."""
    arcs = cut(edges.select(*PAIR, "weight") if min_weight is None else edges.filter(F.col("weight") >= min_weight).select(*PAIR, "weight"))
    front = cut(roots.select("graph_id", F.col("root").alias("src"), F.array("root").alias("path")))
    best = Window.partitionBy("graph_id", "path").orderBy(F.desc("weight"), "dst")
    parts = []
    for level in range(1, max_depth + 1):
        ways = arcs.df.join(front.small(arcs), ["graph_id", "src"]).filter(~F.array_contains("path", F.col("dst")))
        step = cut(ways.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= top_k).drop("_rank"))
        if not step.rows:
            break
        parts.append(step.df.select(*PAIR, "weight", F.lit(level).cast("long").alias("level"), F.concat_ws(" -> ", "path").alias("parent_path")))
        front = cut(step.df.select("graph_id", F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path")))
    if not parts:
        return arcs.df.limit(0).withColumns({"level": F.lit(0).cast("long"), "parent_path": F.lit("")})
    return reduce(DataFrame.unionByName, parts)


def multiobjective_polytree(
    edges: DataFrame,
    roots: DataFrame,
    max_depth: int = MAX_DEPTH,
    max_branching: int = MAX_BRANCHING,
    min_weight: float | None = None,
    min_score: float = MIN_SCORE,
    preserve_target: float = PRESERVE_TARGET,
    alpha: float = ALPHA,
    beta: float = BETA,
    gamma: float = GAMMA,
    delta: float = DELTA,
    epsilon: float = EPSILON,
    zeta: float = ZETA,
) -> DataFrame:
    """Per level the best-scored edges, at most ``max_branching`` per graph and per source.

    The score weighs edge weight, local probability, newly covered weight and target
    centrality against repeated targets and depth.  A graph stops once its selected
    edges hold the target share of all weight.
    """
    base = cut(edges.select(*PAIR, "weight"))
    totals = cut(base.df.groupBy("graph_id").agg(F.sum("weight").alias("total"), F.max("weight").alias("top")).filter("total > 0"))
    out = node_strength(base.df).select("graph_id", F.col("node").alias("src"), F.col("out_weight").alias("out"))
    rank = pagerank(base.df).select("graph_id", F.col("node").alias("dst"), "centrality")
    arcs = base.df if not min_weight else base.df.filter(F.col("weight") >= min_weight)
    scored = cut(arcs.join(totals.small(), "graph_id").join(out, ["graph_id", "src"]).join(rank, ["graph_id", "dst"]))
    front = cut(roots.select("graph_id", F.col("root").alias("src"), F.array("root").alias("path")))
    chosen = None
    for level in range(1, max_depth + 1):
        here = front.small(scored)
        if chosen is None:
            ways = scored.df.join(here, ["graph_id", "src"])
            ways = ways.withColumns({"_from": F.lit(0), "_rep": F.lit(0), "_seen": F.lit(False), "_all": F.lit(0), "_kept": F.lit(0.0)})
        else:
            past = chosen.df
            from_source = past.groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("_from"))
            to_target = past.groupBy("graph_id", "dst").agg(F.count(F.lit(1)).alias("_rep"))
            pairs = past.select(*PAIR, F.lit(True).alias("_seen")).distinct()
            sums = past.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_all"), F.sum(F.when(F.col("new"), F.col("weight")).otherwise(0.0)).alias("_kept"))
            ways = (
                scored.df.join(here, ["graph_id", "src"])
                .join(sums, "graph_id")
                .filter(F.col("_kept") / F.col("total") < preserve_target)
                .join(from_source, ["graph_id", "src"], "left")
                .join(to_target, ["graph_id", "dst"], "left")
                .join(pairs, PAIR, "left")
                .na.fill({"_from": 0, "_rep": 0, "_seen": False})
            )
        ways = ways.filter((~F.array_contains("path", F.col("dst"))) & (F.col("_from") < max_branching))
        nw = F.col("weight") / F.col("top")
        tp = F.col("weight") / F.col("out")
        cg = F.when(F.col("_seen"), 0.0).otherwise(F.col("weight") / F.col("total"))
        rp = F.col("_rep") / F.greatest(F.col("_all"), F.lit(1))
        cp = F.least(F.lit(1.0), F.lit(level / max(1, max_depth)) + F.col("_from") / F.lit(max(1, max_branching)))
        score = alpha * nw + beta * tp + gamma * cg + delta * F.col("centrality") - epsilon * rp - zeta * cp
        reason = (
            F.when((nw >= HEAVY) & (tp >= LIKELY), "heavy")
            .when(cg >= COVERING, "covering")
            .when(F.col("centrality") >= CENTRAL, "central")
            .when((rp > 0) & (nw >= REPEATED), "repeated")
            .otherwise("balanced")
        )
        order = [F.desc("score"), F.desc("weight"), F.col("dst"), F.col("src"), F.col("path")]
        rated = ways.withColumns({"score": score, "reason": reason}).filter(F.col("score") >= min_score)
        # At most max_branching rows per source, then per graph, survive these two limits.
        per_source = Window.partitionBy("graph_id", "src").orderBy(*order)
        rated = rated.withColumn("_s", F.row_number().over(per_source)).filter(F.col("_s") <= max_branching).filter(F.col("_s") + F.col("_from") <= max_branching)
        per_graph = Window.partitionBy("graph_id").orderBy(*order)
        rated = rated.withColumn("_g", F.row_number().over(per_graph)).filter(F.col("_g") <= max_branching)
        first = F.row_number().over(Window.partitionBy(*PAIR).orderBy("_g")) == 1
        rated = rated.withColumn("new", ~F.col("_seen") & first)
        before = Window.partitionBy("graph_id").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
        gained = F.coalesce(F.sum(F.when(F.col("new"), F.col("weight")).otherwise(0.0)).over(before), F.lit(0.0))
        picks = rated.withColumn("_had", F.col("_kept") + gained).filter(F.col("_had") / F.col("total") < preserve_target)
        step = cut(
            picks.select(*PAIR, "weight", F.lit(level).cast("long").alias("level"), F.concat_ws(" -> ", "path").alias("parent_path"), F.round("score", 6).alias("score"), "reason", "new", F.concat("path", F.array("dst")).alias("path"))
        )
        if not step.rows:
            break
        rows = step.df.drop("path")
        chosen = cut(rows if chosen is None else chosen.df.unionByName(rows))
        front = cut(step.df.select("graph_id", F.col("dst").alias("src"), "path"))
    if chosen is None:
        return base.df.limit(0).withColumns({"level": F.lit(0).cast("long"), "parent_path": F.lit(""), "score": F.lit(0.0), "reason": F.lit("")})
    return chosen.df.drop("new")


def collapse_polytree(polytree: DataFrame) -> DataFrame:
    """Distinct edges with their largest weight and number of occurrences."""
    return polytree.groupBy(*PAIR).agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("occurrences"))


def node_levels(polytree: DataFrame, roots: DataFrame) -> DataFrame:
    """Least level of every node over all its appearances; the root has level 0."""
    ends = polytree.select(
        "graph_id", F.inline(F.array(F.struct(F.col("src").alias("node"), (F.col("level") - 1).alias("level")), F.struct(F.col("dst").alias("node"), F.col("level").alias("level"))))
    )
    tops = roots.select("graph_id", F.col("root").alias("node"), F.lit(0).cast("long").alias("level"))
    return ends.unionByName(tops).groupBy("graph_id", "node").agg(F.min("level").alias("level"))
