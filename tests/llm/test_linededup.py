import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from seqnet.llm import linededup
from seqnet.llm.catalog import QUERIES

TABLES = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_chars=20, min_docs=3):
    """``id, text`` pairs with their kept text and counts, by sets of holders."""

    def key(line):
        return line.strip(BLANK).translate(LOWER)

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            own = holders[key(line)]
            last = max((h for h in own if h is not None), default=None)
            if len(key(line)) < min_chars or len(own) < min_docs or i == last:
                kept.append(line)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def order(row):
    return tuple((v is not None, v) for v in row)


def test_query_equals_sets(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in plain(rows)}
    found = QUERIES["op9_line_dedup"](spark, TABLES).collect()
    assert {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in found} == want
    assert len(found) == len(rows)


REPEATED = "This very line stands in many documents"


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(documents, odd_rows, clashing):
    rows = [*odd_rows, *[(i, f"own {i}\n  {REPEATED.upper()}\t\n{REPEATED}") for i in range(20, 25)], (None, REPEATED), (30, "Ä" * 19 + "\n" + "Ä" * 20)]
    rows += [(31, "Ä" * 20), (32, "Ä" * 20), (33, "ä" * 20)]
    docs = documents(rows, clashing)
    found = [tuple(r) for r in linededup.line_report(docs).collect()]
    assert sorted(found, key=order) == sorted(plain(rows), key=order)
    cleaned = linededup.drop_repeated_lines(docs)
    assert cleaned.columns == docs.columns
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in cleaned.collect())
    assert texts == sorted((i or 0, t) for i, t, *_ in plain(rows))
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned.collect() if r["text"] is not None)


def test_hot_line_in_many_pieces(documents, monkeypatch):
    monkeypatch.setattr(linededup, "PROBE_ROWS", 50)
    rows = [(i, f"own line of number {i} here\n{REPEATED}") for i in range(400)]
    found = {(r["doc_id"], r["n_dropped"]) for r in linededup.line_report(documents(rows)).collect()}
    assert found == {(i, int(i != 399)) for i in range(400)}


def state(index):
    counts = sorted(tuple(r) for r in index.counts.collect())
    frequent = [c for c in counts if c[2] >= index.min_docs]
    members = {r["shard"]: linededup.Cuckoo.load(r["filter"]) for r in index.filters.collect()}
    held = sum(int((m.table > 0).sum()) for m in members.values())
    return counts, held, len(frequent)


def test_deletion_undoes_insertion(documents):
    first = [(i, f"{REPEATED}\nsecond repeated line of this text {i % 2}") for i in range(6)]
    more = [(i, f"{REPEATED}\nsecond repeated line of this text {i % 2}\nthird repeated line of this text") for i in range(6, 12)]
    base = linededup.LineIndex.build(documents(first))
    both = base.insert(documents(more))
    assert state(both)[0] == state(linededup.LineIndex.build(documents(first + more)))[0]
    back = both.delete(documents(more).select("doc_id"))
    assert state(back) == state(base)
    for index in (base, both, back):
        _, held, frequent = state(index)
        assert held == frequent
    docs = documents(first + more)
    want = {(i, d) for i, _, _, d in plain(first + more) if d}
    assert {(r["doc_id"], len(r["keys"])) for r in both.dropped(docs).collect()} == want
    assert both.insert(documents(more)).counts.exceptAll(both.counts).count() == 0


def test_cuckoo_filter_never_misses():
    rng = np.random.default_rng(0)
    keys = pd.DataFrame({k: rng.integers(-(1 << 62), 1 << 62, 5000) for k in ("k1", "k2")})
    made = linededup.filter_of(keys)
    k1, k2 = keys["k1"].to_numpy(), keys["k2"].to_numpy()
    assert made.has(k1, k2).all()
    assert made.has(*rng.integers(-(1 << 62), 1 << 62, (2, 5000))).mean() < 0.01
    made.remove(k1[:2500], k2[:2500])
    assert made.has(k1[2500:], k2[2500:]).all()
    assert made.has(k1[:2500], k2[:2500]).mean() < 0.01
    assert (linededup.Cuckoo.load(made.dump()).table == made.table).all()


def test_empty_table(documents):
    assert linededup.line_report(documents([])).count() == 0
    assert linededup.drop_repeated_lines(documents([])).count() == 0
