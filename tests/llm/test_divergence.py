import re
from collections import Counter, defaultdict

import pytest

from seqnet.llm import divergence
from seqnet.llm.catalog import QUERIES

TABLES = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string"


def plain(rows, least=3, top=200):
    """Every pair of sources over every kept term, in whole numbers of any size."""
    counts, holders = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(found)
        holders[lang].update(set(found))
    out = []
    for lang, held in holders.items():
        kept = sorted(t for t, n in held.items() if n >= least)
        groups = {s: c for (own, s), c in counts.items() if own == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in groups if o != s]
            over = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_query_equals_whole_numbers(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    assert result(QUERIES["op13_source_divergence"](spark, TABLES)) == plain(rows)


@pytest.mark.parametrize(("held", "pairs"), [(300_000, 1 << 20), (5, 7)])
def test_odd_rows(spark, documents, monkeypatch, held, pairs):
    """Nulls, empty and long texts, repeated rows, groups without terms, a language without kept terms; in small pieces too."""
    documents([])
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    monkeypatch.setattr(divergence, "HELD_PAIRS", pairs)
    long = " ".join(f"word{'x' * (i % 97)} Thing" for i in range(20_000))
    rows = [
        (1, "Alpha beta ÉCOLE école", "en", "a"), (1, "Alpha beta ÉCOLE école", "en", "a"), (2, "alpha gamma-alpha\x00beta", "en", "b"), (3, None, "en", "c"),
        (4, "", None, None), (5, "beta alpha", "en", None), (None, "alpha日本 beta", "en", "b"), (6, long, "en", "a"), (7, long, "en", "b"), (8, long, "en", "d"),
        (9, "solo", "de", "a"), (10, "solo", "de", "b"), (11, "a{|}b_c`d[e]f@g", "en", "a"), (12, "A B C D E F G", "en", "b"), (13, "a b c d e f g", "en", "d"), (14, "1 2 3", "fr", "z"),
    ]
    table = spark.createDataFrame([(*r, 5, "t", 1.0) for r in rows], f"{SCHEMA}, n int, term string, p double").repartition(3)
    assert result(divergence.audit(table)) == plain(rows)
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranks_and_bounds(spark, documents):
    """Ties come by item; terms stop at the given rank, pairs do not."""
    documents([])
    rows = [(i, " ".join(f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300) if (k + i) % 3), "en", f"s{i % 5}") for i in range(30)]
    table = spark.createDataFrame(rows, SCHEMA)
    for top in (10, 200):
        assert result(divergence.audit(table, top=top)) == plain(rows, top=top)


def test_terms():
    assert divergence.terms("The QUICK-brown 42nd Ärger,日本\x7fz".encode()) == [t.encode() for t in ("the", "quick", "brown", "nd", "Ärger", "日本", "z")]
