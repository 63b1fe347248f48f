import itertools
from collections import defaultdict

import corpus_pipeline
from seqnet.llm import mixing, toxicity
from tests.llm.test_linededup import plain
from tests.llm.test_packing import check_layout, plain_pieces
from tests.llm.test_packing import tokenizer as tokenizer  # noqa: PLC0414
from tests.llm.test_simhash import jaccard_groups, near_copies

TABLES = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_stages(spark, documents, tokenizer):
    """Every stage against its brute-force form on what the stage before it kept."""
    documents([])
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{TABLES}/labels.parquet"))
    ids = sorted(rows)
    scores = dict(zip(ids, model.score([rows[i]["text"] or "" for i in ids]), strict=True))
    rows = {i: r for i, r in rows.items() if scores[i] < 0.5}
    for i, text, _, dropped in plain([(i, r["text"]) for i, r in rows.items()]):
        if dropped:
            rows[i] |= {"text": text, "n_chars": len(text)}
    lead = jaccard_groups({i: r["text"] for i, r in rows.items()})
    rows = {i: r for i, r in rows.items() if lead[i] == i}
    stage = docs
    for name, function in corpus_pipeline.STAGES[:3]:
        stage = corpus_pipeline.write_table(function(spark, stage, TABLES))
        assert stage.columns == docs.columns, name
    assert {r["doc_id"]: r.asDict() for r in stage.collect()} == rows
    chosen = {r["doc_id"] for r in mixing.mixed(stage).filter("sampled").collect()}
    found = corpus_pipeline.run(spark, TABLES).collect()
    want = plain_pieces(tokenizer, [(i, rows[i]["text"]) for i in sorted(chosen)])
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(want)
    check_layout(found)


def test_stages_take_odd_rows(spark, documents, odd_rows):
    for rows, clashing in itertools.product((odd_rows, []), (False, True)):
        docs = documents(rows, clashing)
        for name, function in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.write_table(function(spark, docs, TABLES))
            assert out.columns == docs.columns, name
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, TABLES).count() >= 0


def test_planted_cases(spark, documents):
    """Copies lose all but one, repeated passages go, clean documents stay."""
    body = {i: " ".join(f"w{i}x{k}" for k in range(120)) for i in range(8)}
    passage = " ".join(f"shared{k}" for k in range(60))
    rows = [(i, t) for i, t in body.items()] + [(10, body[0]), (12, body[1] + " extra")] + [(20 + i, f"{body[i]} tail{i}\n{passage}") for i in range(3, 6)]
    docs = documents(rows)
    cleaned = corpus_pipeline.write_table(corpus_pipeline.line_dedup(spark, docs, TABLES))
    holders = defaultdict(int)
    for r in cleaned.collect():
        holders[r["doc_id"]] = passage in r["text"]
    assert [i for i, has in holders.items() if has] == [25]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, cleaned, TABLES).collect()}
    assert set(body) <= kept and 10 not in kept


def test_near_copies_go_whatever_their_fingerprints(spark, documents):
    """One text of each group of plain Jaccard similarity 0.8 stays, the nearly equal copy of the planted cases among those that go."""
    texts = near_copies()
    extra = " ".join(f"w1x{k}" for k in range(120))
    texts |= {1001: extra, 1012: extra + " extra"}
    lead = jaccard_groups(texts)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(list(texts.items())), TABLES).collect()}
    assert kept == set(lead.values()) and 1001 in kept and 1012 not in kept


def test_near_copies_of_the_tables_go(spark, documents):
    """On the given documents too, plain Jaccard similarity 0.8 decides, with no limit on the distance."""
    documents([])
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    lead = jaccard_groups({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, TABLES).collect()} == set(lead.values())
