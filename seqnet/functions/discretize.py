"""Numbers to labels, and times to calendar cases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds and labels of a percentage change.
VARIATION_STEPS = [(-2.0, False, "STRONG_DOWN"), (-0.5, False, "DOWN"), (0.5, True, "STABLE"), (2.0, True, "UP")]
VARIATION_TOP = "STRONG_UP"
# The three quantile labels.
QUANTILE_LABELS = ["LOW", "MEDIUM", "HIGH"]
CASE_WINDOWS = ["none", "daily", "weekly", "monthly", "quarterly"]


def variation_label(column: Column | str) -> Column:
    """Five levels of a percentage change; null stays null."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    label = F.lit(VARIATION_TOP)
    for bound, closed, name in reversed(VARIATION_STEPS):
        label = F.when(value <= bound if closed else value < bound, F.lit(name)).otherwise(label)
    return F.when(value.isNotNull() & ~F.isnan(value), label)


#: Bins of one histogram pass.
BINS = 512


def exact_quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of several columns, interpolated between neighbouring ranks; None without values.

    The first pass counts and finds the range; each further one narrows every wanted rank to
    one of ``BINS`` parts of its bracket, all columns together, until a bracket holds a single
    value.  No task and no driver holds more than the bins.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in columns.items()])
    rows = df.select(F.inline(cells)).filter("v is not null and not isnan(v)")
    ranges = {r["name"]: r for r in rows.groupBy("name").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[float, float, int]] = {}
    for name, r in ranges.items():
        for share in shares:
            at = (r["n"] - 1) * share
            open_ |= {(name, rank): (r["lo"], r["hi"], 0) for rank in (math.floor(at), math.ceil(at))}
    while open_:
        brackets = sorted({(name, lo, hi) for (name, _), (lo, hi, _) in open_.items()})
        # At most two brackets for each wanted quantile.
        sides = F.broadcast(df.sparkSession.createDataFrame(brackets, "name string, lo double, hi double"))
        inside = rows.join(sides, "name").filter("v >= lo and v <= hi")
        place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1).cast("long"))
        inside = inside.withColumn("bin", F.when(F.col("hi") > F.col("lo"), place).otherwise(F.lit(0).cast("long")))
        bins = inside.groupBy("name", "lo", "hi", "bin").agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
        by: dict[tuple, list] = {}
        for r in sorted(bins, key=lambda r: r["bin"]):
            by.setdefault((r["name"], r["lo"], r["hi"]), []).append(r)
        narrowed = {}
        for (name, rank), (lo, hi, before) in open_.items():
            for r in by[name, lo, hi]:
                if rank < before + r["n"]:
                    break
                before += r["n"]
            if r["least"] == r["most"] or rank == before:
                found[name, rank] = r["least"]
            elif rank == before + r["n"] - 1:
                found[name, rank] = r["most"]
            else:
                narrowed[name, rank] = (r["least"], r["most"], before)
        open_ = narrowed
    out: dict[str, list[float] | None] = {}
    for name in columns:
        out[name] = None
        if name in ranges:
            places = [(ranges[name]["n"] - 1) * share for share in shares]
            ends = [(at, math.floor(at), math.ceil(at)) for at in places]
            out[name] = [
                found[name, a] if found[name, a] == found[name, z] else (z - at) * found[name, a] + (at - a) * found[name, z] for at, a, z in ends
            ]
    return out


TERTILES = [0.0, 1 / 3, 2 / 3, 1.0]


def tertile_cuts(edges: list[float] | None) -> list[float] | None:
    """The two inner edges of three bins, or None when two edges collide."""
    return [edges[1], edges[2]] if edges and len(set(edges)) == 4 else None


def quantile_cuts(df: DataFrame, column: str) -> list[float] | None:
    """Exact tertile cut points, or None when two edges of the three bins collide."""
    value = F.col(column).try_cast("double") if df.schema[column].dataType.typeName() == "string" else F.col(column).cast("double")
    return tertile_cuts(exact_quantiles(df, {column: value}, TERTILES)[column])


def quantile_label(column: Column | str, cuts: list[float] | None) -> Column:
    """LOW, MEDIUM or HIGH by right-closed cuts; MEDIUM throughout when there are no cuts."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    low, middle, high = QUANTILE_LABELS
    if cuts is None:
        label = F.lit(middle)
    else:
        label = F.when(value <= cuts[0], low).when(value <= cuts[1], middle).otherwise(high)
    return F.when(value.isNotNull() & ~F.isnan(value), label)


def window_case_id(column: Column | str, window: str) -> Column:
    """Case label of the day, ISO week, month or quarter that holds the time."""
    time = F.col(column) if isinstance(column, str) else column
    if window not in CASE_WINDOWS:
        raise ValueError(f"window must be one of {CASE_WINDOWS}")
    year = F.year(time).cast("string")
    if window == "daily":
        return F.concat(F.lit("W"), year, F.date_format(time, "_MM_dd"))
    if window == "weekly":
        iso_year = F.extract(F.lit("YEAROFWEEK"), time).cast("string")
        return F.concat(F.lit("W"), iso_year, F.lit("_"), F.lpad(F.weekofyear(time).cast("string"), 2, "0"))
    if window == "monthly":
        return F.concat(F.lit("W"), year, F.date_format(time, "_MM"))
    if window == "quarterly":
        return F.concat(F.lit("W"), year, F.lit("_Q"), F.quarter(time).cast("string"))
    return F.lit(None).cast("string")


def parse_order(column: Column | str, as_date: bool) -> Column:
    """Text order values as TIMESTAMP_NTZ or DOUBLE; unreadable ones become null."""
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    return text.try_cast("timestamp_ntz") if as_date else text.try_cast("double")


# Parts of a column name that mark its values as dates.
DATE_NAME_PARTS = ["date", "data", "time", "tempo"]


def looks_like_date(name: str) -> bool:
    return any(part in name.lower() for part in DATE_NAME_PARTS)


#: Share of order values that must be readable.
VALID_RATIO = 0.8


def order_kind(df: DataFrame, column: str) -> str:
    """``numeric``, ``datetime`` or ``text`` by the share of readable values."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return "datetime"
    if kind != "string":
        return "numeric"
    text = F.trim(F.col(column))
    row = df.agg(
        F.avg(text.try_cast("double").isNotNull().cast("double")).alias("number"),
        F.avg(text.try_cast("timestamp_ntz").isNotNull().cast("double")).alias("time"),
    ).first()
    number, time = row["number"] or 0.0, row["time"] or 0.0
    if number >= time and number >= VALID_RATIO:
        return "numeric"
    return "datetime" if time >= VALID_RATIO else "text"
