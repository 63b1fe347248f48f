import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from seqnet.llm import scoring
from seqnet.llm.catalog import QUERIES

TABLES = "/root/testdata/sf0.001"


def trains(doc_id):
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 != 0


def plain_base(rows):
    """``n_tokens, n_known, train_tokens, base_score`` of each row by one counter."""
    words = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    counts = Counter(w for (i, _), own in zip(rows, words, strict=True) if trains(i) for w in own)
    total, distinct = sum(counts.values()), len(counts)
    return [
        (len(own), sum(counts[w] > 0 for w in own), total, sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)) for own in words
    ]


class Tree:
    """A context tree with one binary tree per context, updated bit by bit."""

    def __init__(self, depth):
        self.depth, self.zeros, self.ones, self.own, self.longer = depth, Counter(), Counter(), Counter(), Counter()

    def paths(self, text):
        padded = b"\xff" * self.depth + text.lower() + b"\xff"
        for at in range(self.depth, len(padded)):
            byte = padded[at]
            for k in range(8):
                yield [(padded[at - d : at], byte >> (8 - k), k) for d in range(self.depth + 1)], byte >> (7 - k) & 1

    def mixed(self, node, d):
        return self.own[node] if d == self.depth else np.logaddexp(self.own[node], self.longer[node]) - math.log(2)

    def learn(self, text):
        for path, bit in self.paths(text):
            change = 0.0
            for d in range(self.depth, -1, -1):
                node = path[d]
                before = self.mixed(node, d)
                zeros, ones = self.zeros[node], self.ones[node]
                self.own[node] += math.log(((ones if bit else zeros) + 0.5) / (zeros + ones + 1))
                (self.ones if bit else self.zeros)[node] += 1
                self.longer[node] += change
                change = self.mixed(node, d) - before

    def score(self, text):
        total = 0.0
        for path, bit in self.paths(text):
            chance = None
            for d in range(self.depth, -1, -1):
                node = path[d]
                zeros, ones = self.zeros[node], self.ones[node]
                own = ((ones if bit else zeros) + 0.5) / (zeros + ones + 1)
                if chance is None:
                    chance = own
                else:
                    weight = math.exp(self.own[node] - math.log(2) - self.mixed(node, d))
                    chance = weight * own + (1 - weight) * chance
            total += math.log10(chance)
        return total


@pytest.mark.parametrize(("pieces", "batch"), [(200_000, 32 << 20), (300, 4000)])
def test_scores_equal_a_sequential_tree(spark, documents, monkeypatch, pieces, batch):
    """Against context-tree weighting that is updated bit by bit, in whole and in many small pieces."""
    monkeypatch.setattr(scoring, "PIECE_ROWS", pieces)
    monkeypatch.setattr(scoring, "BATCH_BYTES", batch)
    rows = [(r["doc_id"], (r["text"] or "")[:400]) for r in spark.read.parquet(f"{TABLES}/documents.parquet").limit(40).collect()]
    rows += [(901, None), (902, ""), (903, "Ünïcode 日本語 🎉"), (904, "abcab" * 60), (None, "no id at all"), (901, "again the same id")]
    tree = Tree(scoring.DEPTH)
    for i, text in rows:
        if trains(i):
            tree.learn((text or "").encode())
    want = sorted((i is None, i or 0, *base[:3], round(base[3], 6), round(tree.score((t or "").encode()), 5)) for (i, t), base in zip(rows, plain_base(rows), strict=True))
    found = scoring.score(documents(rows)).collect()
    got = sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 5)) for r in found
    )
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=2e-6) and a[6] == pytest.approx(b[6], abs=2e-5)
    assert all(r["held_out"] == (not trains(r["doc_id"])) for r in found)


def test_query_equals_counters(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    want = {i: base for (i, _), base in zip(rows, plain_base(rows), strict=True)}
    found = QUERIES["op11_lm_scoring"](spark, TABLES).collect()
    assert len(found) == len(rows)
    for r in found:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] < 0


def test_held_out_texts_cost_fewer_bits_than_by_words(spark):
    """What the tree learns helps with texts that it has not seen."""
    found = QUERIES["op11_lm_scoring"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)
    assert np.median([r["bits_per_byte"] for r in found]) < 2.3


def test_log_gamma():
    x = np.concatenate([np.arange(1, 4000) / 2, [1e6 + 0.5, 1e12]])
    want = np.array([math.lgamma(v) for v in x])
    assert np.allclose(scoring.log_gamma(x), want, rtol=1e-12, atol=1e-11)


def test_long_texts_are_read_in_blocks(monkeypatch):
    text = [b"The quick brown fox " * 50, b"", b"jumps"]
    whole = [np.concatenate(c) for c in zip(*scoring.sequences(text, 5), strict=True)]
    monkeypatch.setattr(scoring, "BLOCK", 64)
    parts = [np.concatenate(c) for c in zip(*scoring.sequences(text, 5), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert np.bincount(whole[1]).tolist() == [1001, 1, 6]


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(documents, odd_rows, clashing):
    found = scoring.score(documents(odd_rows, clashing)).collect()
    assert len(found) == len(odd_rows)
    assert all(r["score"] < 0 and r["n_tokens"] >= 1 for r in found)
    alike = [(r["score"], r["base_score"]) for r in found if r["doc_id"] == 8]
    assert alike[0] == alike[1]


def test_empty_table(documents):
    assert scoring.score(documents([])).count() == 0


def test_without_training_texts(documents):
    held = next(i for i in range(1000) if not trains(i))
    row = scoring.score(documents([(held, "ab")])).first()
    assert row["train_tokens"] == 0 and row["base_score"] == 0 and row["score"] == pytest.approx(3 * 8 * math.log10(0.5))
