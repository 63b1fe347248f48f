import itertools
import random
from math import ceil
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seqnet.llm import packing
from seqnet.llm.catalog import QUERIES

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_pieces(tokenizer, rows, length=2048):
    out = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= length else len(ids) % length or length
        starts = [0, *range(first, len(ids), length)]
        for piece, (a, z) in enumerate(itertools.pairwise([*starts, len(ids)])):
            out.append((i, piece, a, z - a, crc32(np.array(ids[a:z], "<u4").tobytes())))
    return out


def check_layout(rows, length=2048):
    """Every sequence is gapless from 0 and fits; gives the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(by)


def test_query_equals_tokenizer(spark, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    want = plain_pieces(tokenizer, rows)
    found = QUERIES["op7_best_fit_packing"](spark, TABLES).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(want)
    assert check_layout(found) <= ceil(sum(p[3] for p in want) / 2048) + 1


def test_encoders_agree(tokenizer):
    """On all Latin-1 characters in several surroundings, special tokens, long runs, and other scripts."""
    texts = [f"{a}{chr(c)}{b}" for c in range(256) for a, b in (("", ""), ("a", "b"), (" ", "1"), ("\n", " x"), ("don", "t 3"))]
    texts += ["<|endoftext|> a <|endoftext|>", "a" * 5000, " " * 3000 + "x", "日本語 ελληνικά ​ ﬁ", "it's we'll I'D", ""]
    assert [packing.token_ids(t) for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_are_one_id(documents, tokenizer):
    """Ids are those of the unmodified file, so the end-of-text token in a text is its own id."""
    assert packing.token_ids("a <|endoftext|> b") == [64, 220, 50256, 275]
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 3000), (3, "<|endoftext| >"), (4, "日本 <|endoftext|>")]
    found = packing.pack(documents(rows)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(plain_pieces(tokenizer, rows))


def fewest(sizes, capacity):
    """Least number of bins by exhaustive search."""
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def place(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(sizes):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= sizes[at]}:
            rest = list(bins)
            rest.remove(room)
            place(at + 1, [*rest, room - sizes[at]])
        place(at + 1, [*bins, capacity - sizes[at]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_an_optimum(seed):
    """Sets fixed by dominance, plus the best packing of the rest, are as few as the best packing of all."""
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 30])
    sizes = [rng.randint(1, capacity) for _ in range(9)]
    counts = np.bincount(sizes, minlength=capacity + 1)
    fixed = packing.reduce_instance(counts, capacity)
    rest = [s for s in range(capacity + 1) for _ in range(counts[s])]
    assert sum(b.number for b in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(sizes, capacity)
    assert sorted(rest + [s for b in fixed for s, n in b.runs for _ in range(n * b.number)]) == sorted(sizes)


def lower_bound(counts, capacity):
    """No packing has fewer bins: large pieces need their own, and small ones what room these leave."""
    out = 0
    for least in [0, *[s for s in counts if 2 * s <= capacity]]:
        alone = sum(n for s, n in counts.items() if s > capacity - least)
        half = {s: n for s, n in counts.items() if capacity < 2 * s <= 2 * (capacity - least)}
        small = sum(s * n for s, n in counts.items() if least <= s and 2 * s <= capacity)
        room = sum((capacity - s) * n for s, n in half.items())
        out = max(out, alone + sum(half.values()) + max(0, ceil((small - room) / capacity)))
    return out


@pytest.mark.parametrize("seed", range(10))
def test_counts_are_packed_whole(seed):
    rng = np.random.default_rng(seed)
    counts = {int(s): int(n) for s, n in zip(rng.integers(1, 2049, 300), rng.integers(1, 10_000, 300), strict=True)}
    bins = packing.pack_counts(counts)
    held = {}
    for b in bins:
        assert sum(s * n for s, n in b.runs) + b.room == 2048 and b.room >= 0
        for s, n in b.runs:
            held[s] = held.get(s, 0) + n * b.number
    assert held == counts
    assert sum(b.number for b in bins) <= 1.02 * lower_bound(counts, 2048) + 1


def test_hot_length_is_ranked_in_pieces(documents, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 100)
    found = packing.pack(documents([(i, "same text for all") for i in range(1500)])).collect()
    size = found[0]["length"]
    assert check_layout(found) == ceil(1500 / (2048 // size))


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(documents, odd_rows, tokenizer, clashing):
    found = packing.pack(documents(odd_rows, clashing)).collect()
    want = plain_pieces(tokenizer, odd_rows)
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted((w[0] or 0, *w[1:]) for w in want)
    check_layout(found)
    assert packing.pack(documents([])).count() == 0
