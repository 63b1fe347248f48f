import pytest

from seqnet.llm.common import on_workers

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that operators might use themselves.
CLASHES = "component_id string, kept string, tokens string, topic string, n_lines int, n_dropped int, score string, raw string, rank int, fp string, _gone string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (id, text) pairs or fuller rows, on request with clashing columns."""
    on_workers(spark)

    def make(rows, clashing=False):
        full = [(*r, *("en", "src0", len(r[1]) if len(r) == 2 and r[1] is not None else None)[len(r) - 2 :]) for r in rows]
        if not clashing:
            return spark.createDataFrame(full, SCHEMA).repartition(3)
        return spark.createDataFrame([(*r, "x", "y", "z", "t", 1, 2, "s", "r", 9, "f", "g") for r in full], f"{SCHEMA}, {CLASHES}").repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} thing{i % 89}" for i in range(30_000))
    return [
        (1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "alpha beta gamma delta epsilon zeta eta theta"), (3, None), (4, ""), (5, "   \t\n "),
        (6, long), (7, long + " end"), (8, "one"), (8, "one"), (None, "a text without an id that is long enough\nand has two lines"),
        (None, None), (9, "Ünïcode näïve façade 日本語のテキスト 🎉 ﬁne"), (10, "x\r\ny\r\n\r\nz"),
    ]
