"""Networks kept up to date from a stream of events.

Each case's last event is state of the query, so a batch costs what its own cases cost and no
earlier event is read again.  A batch adds one small table of counts, named by its number;
the network is the sum over these tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqnet.operators.network import PAIR
from seqnet.plans.ordering import as_number

STEPS = "graph_id string, src string, dst string, n bigint"


def new_steps(events: DataFrame) -> DataFrame:
    """``graph_id, src, dst, n``: the changes of item that a batch adds to each of its cases.

    ``events`` is a stream with ``graph_id, case_id, ord, item``.  Events of a case are taken in order
    of ``ord``, then label.  An event that is not after the last one seen of its case, in that
    order, came in an earlier batch or too late; it is left out, so a batch that is sent
    again adds nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["place", "item"], kind="stable")
        counts: dict[tuple[str, str], int] = {}
        for place, item in zip(rows["place"].tolist(), rows["item"].tolist(), strict=True):
            if last is not None and (place, item) <= tuple(last):
                continue
            if last is not None and last[1] != item:
                counts[last[1], item] = counts.get((last[1], item), 0) + 1
            last = (place, item)
        if last is not None:
            state.update(tuple(last))
        found = [(key[0], src, dst, n) for (src, dst), n in counts.items()]
        yield pd.DataFrame(found, columns=["graph_id", "src", "dst", "n"])

    placed = events.select("graph_id", "case_id", as_number(events, "ord").alias("place"), F.col("item").cast("string").alias("item"))
    placed = placed.filter("case_id is not null and place is not null and item is not null")
    return placed.groupBy("graph_id", "case_id").applyInPandasWithState(step, STEPS, "place double, item string", "append", GroupStateTimeout.NoTimeout)


def maintain(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Start a query that works off what the stream holds and adds its counts to ``table``.

    A batch that is run again after a failure replaces its own counts.
    """

    def add(steps: DataFrame, batch: int) -> None:
        counts = steps.groupBy(*PAIR).agg(F.sum("n").cast("double").alias("weight"))
        counts.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    writer = new_steps(events).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).foreachBatch(add).start()


def network(spark: SparkSession, table: str) -> DataFrame:
    """The network of all batches so far."""
    counts = spark.read.schema("graph_id string, src string, dst string, weight double").parquet(f"{table}/batch=*")
    return counts.groupBy(*PAIR).agg(F.sum("weight").alias("weight"))
