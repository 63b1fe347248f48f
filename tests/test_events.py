"""Ordering, cleaning, readers and temporal pairs on small inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from seqnet.functions import discretize, text
from seqnet.operators import events as ev
from seqnet.operators import influence as inf
from seqnet.operators import network as nw
from seqnet.sources import readers as rd
from tests import fixtures as fx


def raw(spark, rows):
    return spark.createDataFrame(rows, "who string, at long, what string")


def test_hot_cases_give_the_same_result(spark):
    """One case holds most rows, with many ties; dividing it must not change anything."""
    rng = random.Random(1)
    rows = [("hot", rng.randint(0, 40), rng.choice("abc")) for _ in range(900)]
    rows += [(f"c{i % 60}", rng.randint(0, 30), rng.choice("abcd")) for i in range(500)] + [("same", i, "a") for i in range(120)]
    table = ev.event_table(raw(spark, rows), "who", "at", "what")
    for operator in (ev.order_events, ev.next_item, ev.dedup_consecutive, nw.pair_frequencies, nw.state_network, ev.sequence_stats):
        plain, split = operator(table), operator(table, hot_rows=50)
        columns = [c for c in plain.columns if c != "tie"]
        assert sorted(map(str, plain.select(columns).collect())) == sorted(map(str, split.select(columns).collect())), operator.__name__


def test_hot_cases_with_times_and_text_orders(spark):
    rng = random.Random(2)
    times = [(f"c{i % 3}", f"2024-01-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:00:00", rng.choice("ab")) for i in range(400)]
    df = spark.createDataFrame(times, "who string, clock string, what string")
    for order in (F.col("clock"), F.col("clock").cast("timestamp_ntz"), F.col("clock").cast("timestamp"), F.col("clock").cast("date")):
        table = df.select(F.lit("all").alias("graph_id"), F.col("who").alias("case_id"), order.alias("ord"), F.lit(0).alias("tie"), F.col("what").alias("item"))
        plain = sorted(map(tuple, nw.pair_frequencies(table).collect()))
        assert plain == sorted(map(tuple, nw.pair_frequencies(table, hot_rows=40).collect()))


def test_hot_origin_ranks(spark):
    rows = [("g", "hub", f"d{i:03d}", (i * 7) % 23 + 1) for i in range(300)] + [("g", f"s{i}", "hub", i + 1) for i in range(30)]
    edges = fx.edges(spark, rows)
    plain = sorted(map(tuple, nw.relative_weight(edges).collect()))
    assert plain == sorted(map(tuple, nw.relative_weight(edges, hot_rows=40).collect()))


def test_row_order_does_not_matter(spark):
    rng = random.Random(4)
    rows = [(f"c{i % 7}", rng.randint(0, 9), rng.choice("xyz")) for i in range(200)]
    results = []
    for _ in range(2):
        rng.shuffle(rows)
        results.append(sorted(map(tuple, nw.state_network(ev.event_table(raw(spark, rows), "who", "at", "what")).collect())))
    assert results[0] == results[1]


def test_missing_labels_and_short_cases(spark):
    rows = [("a", 1, "x"), ("a", 2, " NaN "), ("a", 3, "y"), ("b", 1, "x"), ("c", 1, "q"), ("c", 2, "q"), (None, 1, "x"), ("nat", 1, "x"), ("d", None, "x")]
    table = ev.event_table(raw(spark, rows), "who", "at", "what")
    assert [tuple(r) for r in nw.state_network(table).select("src", "dst", "kind").orderBy("src", "dst").collect()] == [
        ("SOURCE", "x", "source_transition"), ("x", "y", "normal_transition"), ("y", "SINK", "sink_transition"),
    ]
    assert nw.state_network(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ev.event_table(raw(spark, rows), "nobody", "at", "what")


def test_item_named_like_a_virtual_node(spark):
    rows = [("a", 1, "SOURCE"), ("a", 2, "x"), ("b", 1, "x"), ("b", 2, "SINK")]
    got = {tuple(r) for r in nw.state_network(ev.event_table(raw(spark, rows), "who", "at", "what")).select("src", "dst", "kind").collect()}
    assert ("SOURCE", "SOURCE", "source_transition") in got and ("SINK", "SINK", "sink_transition") in got and ("SOURCE", "x", "normal_transition") in got


def test_valid_ratio_gate(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("a", "bad", "y"), ("a", "worse", "z")], "who string, step string, what string")
    with pytest.raises(ValueError):
        ev.event_table(df, "who", "step", "what")


def test_weighted_lines(spark):
    lines = [(0, "sequence,count"), (1, "acdeh,455"), (2, "a c d,3"), (3, "x"), (4, "red, green, blue,2"), (5, "one two"), (6, "   ")]
    df = spark.createDataFrame([("g", i, v) for i, v in lines], "graph_id string, seq_id long, value string")
    got = {r.seq_id: (r["items"], r.weight) for r in rd.parse_weighted_sequences(df, counted=True).collect()}
    assert got == {1: (list("acdeh"), 455), 2: (["a", "c", "d"], 3), 4: (["red", "green", "blue"], 2), 5: (["one", "two"], 1)}
    kept = {r.seq_id: r["items"] for r in rd.parse_weighted_sequences(df.filter("seq_id = 4")).collect()}
    assert kept == {4: ["red", "green", "blue", "2"]}


def test_numeric_lines(spark):
    lines = [("n", 1, "3"), ("n", 2, "1 2 3"), ("n", 3, "4 x"), ("n", 4, "5 6"), ("h", 1, "header"), ("h", 2, "1 2"), ("d", 1, "9 8"), ("d", 2, "7")]
    good, bad = rd.parse_numeric_sequences(spark.createDataFrame(lines, "graph_id string, seq_id long, value string"))
    assert {(r.graph_id, r.seq_id) for r in good.collect()} == {("n", 2), ("n", 4), ("h", 2), ("d", 1)}
    assert [(r.graph_id, r.line) for r in bad.collect()] == [("n", "4 x")]


def test_event_log_lines(spark):
    lines = ["p 2 3", "e 1 1 7 0", " e  1 2 8 0 ", "e 2 1 7 1", "e 2 x 7 1", "e 2 3", "q", "", "p 9 9"]
    parsed = rd.parse_event_log(spark.createDataFrame(list(enumerate(lines)), "seq_id long, value string"))
    assert [(r.case_id, r.ord, r.event, r.flag) for r in rd.event_log_events(parsed).orderBy("case_id", "ord").collect()] == [(1, 1, "7", 0), (1, 2, "8", 0), (2, 1, "7", 1)]
    head = rd.event_log_header(parsed).first()
    assert (head.meta_1, head.meta_2, head.cases, head.events, head.rejected) == (2, 3, 2, 3, 4)


def test_pair_frequency_errors(spark):
    df = spark.createDataFrame([("a", "b", "1"), ("a", "b", "2"), ("b", "c", "4")], "Source string, Target string, Frequency string")
    assert {(r.src, r.dst): r.weight for r in rd.read_pair_frequencies(df).collect()} == {("a", "b"): 3.0, ("b", "c"): 4.0}
    with pytest.raises(Exception, match="negative"):
        rd.read_pair_frequencies(df.withColumn("Frequency", F.lit("-1"))).collect()


def test_quantiles(spark):
    same = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "v double")
    assert discretize.quantile_cuts(same, "v") is None
    spread = spark.createDataFrame([(float(i),) for i in range(9)], "v double")
    cuts = discretize.quantile_cuts(spread, "v")
    labels = [r[0] for r in spread.orderBy("v").select(discretize.quantile_label("v", cuts)).collect()]
    assert labels == ["LOW"] * 3 + ["MEDIUM"] * 3 + ["HIGH"] * 3


def test_calendar_cases_and_labels(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-12-30 10:00:00' AS t").select(*[discretize.window_case_id("t", w) for w in ("daily", "weekly", "monthly", "quarterly")]).first()
    assert list(row) == ["W2024_12_30", "W2025_01", "W2024_12", "W2024_Q4"]
    df = spark.createDataFrame([(" a  b/ç ",), ("__",), ("nan",), (None,)], "v string")
    assert [r[0] for r in df.select(text.sanitize_event("v")).collect()] == ["A_B_Ç", None, None, None]
    values = spark.createDataFrame([(v,) for v in (-2.1, -2.0, -0.5, 0.5, 2.0, 2.1)], "v double")
    assert [r[0] for r in values.select(discretize.variation_label("v")).collect()] == ["STRONG_DOWN", "DOWN", "STABLE", "STABLE", "UP", "STRONG_UP"]


def test_latency_pairs_and_hot_buckets(spark):
    rng = random.Random(9)
    rows = [(rng.choice("pq"), rng.randint(0, 60), rng.choice("abc")) for _ in range(160)]
    signals = inf.prepare_signals(raw(spark, rows), "who", "at", "what")
    want = {}
    for (e1, t1, s1), (e2, t2, s2) in itertools.product(rows, rows):
        if e1 == e2 and 0 < t2 - t1 <= 10:
            want[(s1, s2, t2 - t1)] = want.get((s1, s2, t2 - t1), 0) + 1
    for hot in (10_000, 5):
        got = {(r.from_signal, r.to_signal, int(r.delta_t)): r.frequency for r in inf.temporal_influence(signals, 10, hot).collect()}
        assert got == want


def test_text_times(spark):
    rows = [("p", "t1", "a"), ("p", "t2", "b"), ("q", "5", "a"), ("q", "9", "b"), ("r", "x", "a")]
    signals = inf.prepare_signals(spark.createDataFrame(rows, "who string, at string, what string"), "who", "at", "what")
    assert {(r.entity, r.signal): r.t for r in signals.collect()} == {("p", "a"): 1_000_000, ("p", "b"): 2_000_000, ("q", "a"): 5_000_000, ("q", "b"): 9_000_000, ("r", "a"): 1_000_000}
