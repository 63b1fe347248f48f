import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from seqnet.llm import prefixtrie
from seqnet.llm.catalog import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The trie as a dictionary of paths."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), mark, (role, text)))
    own = {c: [t[2] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for conv in own:
        h = crc32(str(conv).encode()) % 9
        family = conv - (abs(conv) % 5) * (1 if conv >= 0 else -1)
        path = (*own.get(family, [])[:h], *own[conv][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(conv)
        ends[path].append(conv)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, inside in members.items():
        value = (len(inside) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += value
            leaves[path[:d]] += not children[path]
    return sorted(
        (
            min(inside), len(path), -1 if not path else min(members[path[:-1]]), len(inside), children[path], leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
        )
        for path, inside in members.items()
    )


def result(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def made(seed, convs=400, vocabulary=3, longest=24):
    """Conversations that share starts of many lengths, around block borders too."""
    rng = random.Random(seed)
    rows = []
    for conv in range(-20, convs):
        start = rng.randrange(4)
        for turn in range(rng.randrange(longest)):
            text = f"shared{start}" if turn < 3 * start else f"t{rng.randrange(vocabulary)}"
            rows.append((conv, turn * 2, rng.choice(["user", "assistant"]) if turn > 4 else "user", text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_paths(spark, seed):
    rows = made(seed)
    assert result(prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_long_conversations_cross_segments(spark, monkeypatch):
    """Running figures go over segments and chunks; children of a hot node come by broadcast."""
    for name, value in (("SEGMENT", 3), ("STRETCH", 16), ("HOT_CHILDREN", 2), ("HOT_SHARE", 10), ("IDS_BYTES", 20)):
        monkeypatch.setattr(prefixtrie, name, value)
    chunks = prefixtrie.with_chunks
    monkeypatch.setattr(prefixtrie, "with_chunks", lambda df, keys, order: chunks(df, keys, order, 50))
    rows = made(3, 60)
    rows += [(1000, t, "user", f"x{t % 7}") for t in range(700)] + [(1001, t, "user", f"x{t % 7}") for t in range(500)]
    rows += [(1000 + 5 * i, t, "user", f"x{t % 7}") for i in range(4, 30) for t in range(60 + i % 3)]
    assert result(prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == plain(rows)


@pytest.mark.parametrize("block", [1, 2, 5])
def test_block_length_does_not_matter(spark, monkeypatch, block):
    monkeypatch.setattr(prefixtrie, "BLOCK", block)
    rows = made(4, 80)
    assert result(prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_odd_rows(spark):
    long = "word " * 40_000
    rows = [
        (1, None, "user", "first"), (1, 0, None, "a"), (1, 1, "user", None), (1, 1, "user", "tie"), (1, 1, "user", "tie"), (2, 0, "user", long), (3, 0, "user", long),
        (None, 0, "user", "nobody's"), (4, 0, "", ""), (5, 0, None, None), (6, 0, "user", "ünïcode 日本語"), (-3, 0, "user", "x"), (-5, 0, "user", "y"), (11, 0, "us", "erx"), (16, 0, "user", "x"),
    ]
    table = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], f"{SCHEMA}, depth int, k int, digest string")
    assert result(prefixtrie.prefix_trie(table)) == plain(rows)
    assert prefixtrie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    """A conversation whose turns are all replaced by none."""
    conv = next(i for i in range(1, 1000) if i % 5 and crc32(str(i).encode()) % 9 > 2)
    rows = [(conv, 0, "user", "gone"), (conv, 1, "user", "gone too")]
    found = result(prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert found == plain(rows) == [(conv, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


def test_query_equals_paths(spark):
    folder = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op12_conversation_trie"](spark, folder)) == plain(rows)
