"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from seqnet.catalog.oracles import ORACLES
from seqnet.catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# The slow structure queries are compared by the driver; here one of each family.
QUICK = [
    "read_table", "write_tables_by_graph", "read_weighted_sequences", "read_event_log", "read_edges", "adapt_edge_columns", "filter_edges",
    "build_events", "window_case_id", "next_item", "sequence_stats", "pair_frequencies", "state_network", "token_network", "relative_weight",
    "network_metrics", "influence_edges", "positional_events", "forward_tree", "topk_polytree", "is_dag",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def normal(rows, columns):
    places = [columns.index(c) for c in sorted(columns)]
    return sorted(str([row[i] + 0.0 if isinstance(row[i], float) else row[i] for i in places]) for row in rows)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, FOLDER)
    result = duck.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(df.collect(), df.columns) == normal(result.fetchall(), columns)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 20


#: Queries whose sequential forms are compared in other tests instead.
WITHOUT_SQL = {"brand_rooted_branching", "multiobjective_polytree"}


def test_queries_and_oracles_match():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())
