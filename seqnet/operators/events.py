"""Events to ordered, run-free sequences.

Event tables have the columns ``graph_id, case_id, ord, tie, item``: one row per
event, ordered within a case by ``(ord, tie, item)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqnet.functions import discretize
from seqnet.functions.text import clean_text, sanitize_event
from seqnet.plans.ordering import CHUNK, HOT_ROWS, neighbours, with_chunks

CASE = ["graph_id", "case_id"]
SOURCE, SINK = "SOURCE", "SINK"
EVENT_ORDER = ["ord", "tie", "item"]


def event_order() -> list[Column]:
    return [F.col(name) for name in EVENT_ORDER]


def _label(df: DataFrame, name: str, as_text: bool) -> Column:
    kind = df.schema[name].dataType.typeName()
    if kind == "string":
        return clean_text(name)
    if kind in ("double", "float"):
        present = F.when(~F.isnan(name), F.col(name))
        return present.cast("string") if as_text else present
    return F.col(name).cast("string") if as_text else F.col(name)


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def check_valid_ratio(df: DataFrame, parsed: Column, what: str) -> None:
    """Stop when fewer than 80 % of the order values can be read."""
    share = df.agg(F.avg(parsed.isNotNull().cast("double")).alias("share")).first()["share"]
    if share is None or share < discretize.VALID_RATIO:
        raise ValueError(f"column {what} holds too many unreadable order values: {share}")


def read_order(df: DataFrame, name: str) -> Column:
    """The order column as a sortable value, with the 80 % test when it is text."""
    if df.schema[name].dataType.typeName() != "string":
        return F.col(name)
    parsed = discretize.parse_order(name, discretize.looks_like_date(name))
    check_valid_ratio(df, parsed, name)
    return parsed


def event_table(
    df: DataFrame, case: str, order: str, item: str, graph: str | None = None, tie: list[str] | None = None
) -> DataFrame:
    """Choose the columns of an event table, clean the labels and drop unusable rows."""
    require_columns(df, [case, order, item, *([graph] if graph else []), *(tie or [])])
    labelled = df.filter(_label(df, case, False).isNotNull() & _label(df, item, True).isNotNull())
    out = labelled.select(
        (F.col(graph) if graph else F.lit("all")).alias("graph_id"),
        _label(df, case, False).alias("case_id"),
        read_order(labelled, order).alias("ord"),
        (F.struct(*tie) if tie else F.lit(0)).alias("tie"),
        _label(df, item, True).alias("item"),
    )
    return out.filter("ord is not null")


def ordered(events: DataFrame, hot_rows: int = HOT_ROWS, position: bool = True, sizes: DataFrame | None = None) -> DataFrame:
    """Events with ``prev``, ``next`` and ``pos`` inside their case; ``sizes`` as for ``with_chunks``."""
    return neighbours(with_chunks(events, CASE, EVENT_ORDER, hot_rows, sizes), CASE, event_order(), "item", position)


def order_events(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number the events of each case from 1."""
    return ordered(events, hot_rows).select(*CASE, "ord", "tie", "item", "pos")


def dedup_consecutive(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keep the first event of every run of equal items."""
    rows = ordered(events, hot_rows, position=False).filter("prev is null or prev <> item")
    return rows.drop("prev", "next")


def min_length(events: DataFrame, least: int = 2) -> DataFrame:
    """Keep the cases of a run-free event table that have at least ``least`` events."""
    long_cases = events.groupBy(*CASE).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return events.join(long_cases.drop("_n"), CASE, "left_semi")


def valid_runs(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Run-free events of the cases that keep at least two of them."""
    runs = dedup_consecutive(events, hot_rows)
    if CHUNK in runs.columns:
        return min_length(runs)
    # Same partitioning as the run removal, so this count needs no further shuffle.
    size = F.count(F.lit(1)).over(Window.partitionBy(*CASE))
    return runs.withColumn("_n", size).filter("_n >= 2").drop("_n")


def sequences(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Run-free events of every case with at least two of them, with ``next_item`` and ``pos``.

    The last event of a case leads to ``SINK``.
    """
    rows = neighbours(valid_runs(events, hot_rows), CASE, event_order(), "item")
    columns = [*CASE, "ord", "tie", "item", F.coalesce("next", F.lit(SINK)).alias("next_item"), "pos"]
    return rows.select(*columns)


def next_item(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return sequences(events, hot_rows).select(*CASE, "ord", "item", "next_item", "pos")


def case_sequences(events: DataFrame, separator: str = " ", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per case with its items as an array and as text.

    The result itself holds a whole sequence in one value, so it suits cases that
    fit in a row; networks are built from the long form instead.
    """
    rows = sequences(events, hot_rows)
    packed = rows.groupBy(*CASE).agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("_s"))
    items = F.transform("_s", lambda x: x["item"])
    return packed.select(*CASE, items.alias("items"), F.concat_ws(separator, items).alias("sequence"), F.size("_s").cast("long").alias("length"))


def sequence_stats(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Case counts and length figures per graph, before and after run removal."""
    rows = ordered(events, hot_rows, position=False)
    kept = (F.col("prev").isNull() | (F.col("prev") != F.col("item"))).cast("long")
    cases = rows.groupBy(*CASE).agg(F.count(F.lit(1)).alias("raw"), F.sum(kept).alias("length"))
    valid = F.col("length") >= 2
    length = F.when(valid, F.col("length"))
    return cases.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(valid).alias("sequences"),
        F.count_if(~valid).alias("short_cases"),
        F.count_if(F.col("raw") != F.col("length")).alias("cases_with_runs"),
        F.sum("raw").alias("raw_events"),
        F.sum(length).alias("events"),
        F.avg(length).alias("mean_length"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
    )


def log_consistency(df: DataFrame, case: str, order: str) -> DataFrame:
    """Per case: orders below 1, repeated orders, and gaps in the run of orders."""
    # Distinct pairs first: repeated orders of one large case combine before the shuffle.
    pairs = df.groupBy(case, order).agg(F.count(F.lit(1)).alias("_n"))
    figures = pairs.groupBy(case).agg(
        F.sum("_n").alias("events"),
        F.count(F.lit(1)).alias("distinct_orders"),
        F.min(order).cast("long").alias("min_order"),
        F.max(order).cast("long").alias("max_order"),
    )
    span = F.col("max_order") - F.col("min_order") + 1
    return figures.select(
        F.col(case).alias("case_id"),
        "events",
        "min_order",
        "max_order",
        (F.col("min_order") < 1).alias("order_below_one"),
        (F.col("events") != F.col("distinct_orders")).alias("repeated_order"),
        (F.col("events") != span).alias("not_contiguous"),
    )


def same_time_ties(events: DataFrame) -> DataFrame:
    """Per graph: (case, time) pairs with several events, and with several distinct items."""
    items = events.groupBy(*CASE, "ord", "item").agg(F.count(F.lit(1)).alias("_n"))
    moments = items.groupBy(*CASE, "ord").agg(F.sum("_n").alias("events"), F.count(F.lit(1)).alias("kinds"))
    return moments.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("moments"),
        F.count_if(F.col("events") > 1).alias("tied_moments"),
        F.count_if(F.col("kinds") > 1).alias("ambiguous_moments"),
    )


# Vocabulary sizes above which a warning is due.
VOCABULARY_LIMIT = 500
VOCABULARY_FLOOR = 50
VOCABULARY_SHARE = 0.5


def event_vocabulary(events: DataFrame) -> DataFrame:
    """Distinct items per graph, with a flag when there are too many of them."""
    # Counting per item first keeps the distinct count free of any single large group.
    items = events.groupBy("graph_id", "item").agg(F.count(F.lit(1)).alias("_n"))
    sizes = items.groupBy("graph_id").agg(F.sum("_n").alias("events"), F.count(F.lit(1)).alias("items"))
    floor = F.greatest(F.lit(VOCABULARY_FLOOR), F.floor(F.col("events") * VOCABULARY_SHARE))
    return sizes.withColumn("too_many", (F.col("items") > VOCABULARY_LIMIT) | (F.col("items") > floor))


def build_events(
    df: DataFrame,
    order: str,
    parts: list[str],
    case: str | None = None,
    case_window: str = "none",
    discretization: dict[str, str] | None = None,
    graph: str | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """Fuse several columns into one event label.

    Returns the event table and the rule used for each part.  A text column counts as
    numeric when at least 80 % of its values are numbers; numeric columns take part
    only with a discretization, ``variation_pct`` or ``quantile``.
    """
    if not parts:
        raise ValueError("at least one event column is needed")
    if case_window == "use_entity":
        case_window = "none"
    require_columns(df, [order, *parts, *([case] if case_window == "none" else [])])
    discretization = discretization or {}
    texts = [p for p in parts if df.schema[p].dataType.typeName() == "string"]
    shares = {}
    if texts:
        shares = df.agg(
            *[F.avg(F.trim(F.col(p)).try_cast("double").isNotNull().cast("double")).alias(p) for p in texts]
        ).first().asDict()
    rules: dict[str, str] = {}
    labels: list[Column | str] = []
    binned: dict[str, Column] = {}
    numeric_kinds = ("byte", "short", "integer", "long", "float", "double", "decimal")
    for part in parts:
        kind = df.schema[part].dataType.typeName()
        numeric = kind.split("(")[0] in numeric_kinds or (shares.get(part) or 0.0) >= discretize.VALID_RATIO
        mode = discretization.get(part, "").lower()
        number = F.trim(F.col(part)).try_cast("double") if kind == "string" else F.col(part).cast("double")
        if not numeric:
            rules[part] = "categorical_value"
            labels.append(F.coalesce(sanitize_event(F.col(part).cast("string")), F.lit("UNKNOWN")))
        elif mode in ("variation_pct", "threshold", "thresholds"):
            rules[part] = "variation_pct_thresholds"
            labels.append(F.coalesce(discretize.variation_label(number), F.lit("UNKNOWN")))
        elif mode in ("quantile", "quantiles"):
            rules[part] = "quantiles_low_medium_high"
            binned[part] = number
            labels.append(part)
        else:
            rules[part] = "ignored_numeric" if mode in ("ignore", "ignored") else "ignored_numeric_without_discretization"
    if not labels:
        raise ValueError("no event column is left: choose text columns or discretize numeric ones")
    edges = discretize.exact_quantiles(df, binned, discretize.TERTILES) if binned else {}

    def binned_label(part: str) -> Column:
        label = discretize.quantile_label(binned[part], discretize.tertile_cuts(edges[part]))
        return F.coalesce(F.concat(F.lit(f"{part}_"), label), F.lit("UNKNOWN"))

    labels = [binned_label(label) if isinstance(label, str) else label for label in labels]
    when = read_order(df, order)
    case_id = _label(df, case, False) if case_window == "none" else discretize.window_case_id(when, case_window)
    out = df.select(
        (F.col(graph) if graph else F.lit("all")).alias("graph_id"),
        case_id.alias("case_id"),
        when.alias("ord"),
        F.lit(0).alias("tie"),
        sanitize_event(F.concat_ws("_", *labels)).alias("item"),
    )
    return out.dropna(subset=["case_id", "ord", "item"]), rules
