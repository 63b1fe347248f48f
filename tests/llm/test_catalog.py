"""Every corpus query that SQL can express, against its SQL, and all others by name."""

import duckdb
import pytest

from seqnet.llm.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"
NAMES = "documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    places = [columns.index(c) for c in sorted(columns)]
    return sorted(str([row[i] for i in places]) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in NAMES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    found = QUERIES[name](spark, FOLDER)
    assert sorted(columns) == sorted(found.columns)
    assert normal(found.collect(), found.columns) == normal(result.fetchall(), columns)


def test_names():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
