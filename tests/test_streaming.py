"""Networks from streams against the same events in one batch."""

import random

from seqnet.operators import network as nw
from seqnet.streaming import network as st

SCHEMA = "graph_id string, case_id string, ord long, tie int, item string"


def edges(df):
    return sorted(map(tuple, df.select("graph_id", "src", "dst", "weight").collect()))


def test_batches_give_the_network_of_all_events(spark, tmp_path):
    """Several files and two runs of the query; repeated files and late events add nothing."""
    rng = random.Random(8)
    rows = [(f"g{i % 2}", f"c{rng.randrange(12)}", i // 2, 0, rng.choice("abcd")) for i in range(600)]
    folder = str(tmp_path / "events")

    def put(name, some):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        query = st.maintain(stream, str(tmp_path / "counts"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return edges(st.network(spark, str(tmp_path / "counts")))

    for k in range(4):
        put(f"part{k}", rows[100 * k : 100 * k + 100])
    assert run() == edges(nw.pair_frequencies(spark.createDataFrame(rows[:400], SCHEMA)))
    put("part4", rows[400:])
    whole = edges(nw.pair_frequencies(spark.createDataFrame(rows, SCHEMA)))
    assert run() == whole
    put("part5", rows[:600])
    put("part6", [("g0", "c1", 3, 0, "late"), ("g1", None, 9999, 0, "a"), ("g1", "c2", None, 0, "a"), ("g1", "c2", 9999, 0, None)])
    assert run() == whole
