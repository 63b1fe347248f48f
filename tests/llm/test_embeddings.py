import numpy as np
import pytest

from seqnet.llm import embeddings
from seqnet.llm.catalog import QUERIES

TABLES = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, limit=0.98, dims=64):
    """Links by comparing all pairs in double precision: number per id and least id reachable."""
    usable = []
    for i, v, label in rows:
        if i is None or label is None or v is None or None in v or len(v) != dims:
            continue
        a = np.array(v, np.float64)
        if np.isfinite(a).all() and np.any(a):
            usable.append((i, label, a / np.sqrt(a @ a)))
    links, lead = {i: set() for i, *_ in rows}, {i: i for i, *_ in rows}
    for n, (i, label, a) in enumerate(usable):
        for j, other, b in usable[:n]:
            if label == other and i != j and a @ b >= limit:
                links[i].add(j)
                links[j].add(i)
    changed = True
    while changed:
        changed = False
        for i, near in links.items():
            for j in near:
                if lead[i] != lead[j]:
                    lead[i] = lead[j] = min(lead[i], lead[j])
                    changed = True
    return {i: len(s) for i, s in links.items()}, lead


def noisy(rng, center, n, cosine):
    """Vectors around a center at about the cosine, each in a direction of its own."""
    turn = rng.normal(size=(n, 64))
    center = center / np.linalg.norm(center)
    turn -= (turn @ center)[:, None] * center
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    return cosine * center + np.sqrt(1 - cosine**2) * turn


def test_query_recall_against_all_pairs(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()]
    counts, lead = brute(rows)
    found = {r["vec_id"]: r for r in QUERIES["op4_embedding_near_dedup"](spark, TABLES).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["n_links"] <= n for i, n in counts.items())
    assert sum(r["n_links"] for r in found.values()) >= 0.99 * sum(counts.values())
    same = sum(found[i]["component_id"] == c for i, c in lead.items())
    assert same >= 0.99 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


@pytest.mark.parametrize(("target", "block"), [(0.999, 2048), (1.0, 2048), (1.0, 16)])
def test_planted_pairs(spark, documents, monkeypatch, target, block):
    """Pairs just above and below the limit, a hot group, cells cut into small blocks; complete at target 1."""
    documents([])
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "PER_CELL", 8)
    rng = np.random.default_rng(2)
    vectors = list(rng.normal(size=(200, 64)))
    for center in vectors[:60]:
        vectors += [v * rng.uniform(0.1, 9) for c in (0.981, 0.979, 0.995) for v in noisy(rng, center, 1, c)]
    vectors += list(noisy(rng, vectors[100], 120, 0.992))
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 200 < 60 or i >= 380)) for i, v in enumerate(vectors)]
    counts, lead = brute(rows)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(table, target=target).collect()}
    got = {i: r["n_links"] for i, r in found.items()}
    if target == 1:
        assert got == counts
        assert {i: r["component_id"] for i, r in found.items()} == lead
    else:
        assert sum(got.values()) >= 0.99 * sum(counts.values())
        assert all(got[i] <= n for i, n in counts.items())


def test_odd_rows(spark, documents):
    documents([])
    base = [float(x) for x in np.random.default_rng(4).normal(size=64)]
    rows = [
        (1, base, 1), (2, base, 1), (2, base, 1), (3, base, None), (4, base, 2), (5, [0.0] * 64, 1), (6, None, 1), (7, [], 1), (8, [None, *base[1:]], 1),
        (9, [float("nan"), *base[1:]], 1), (10, [float("inf"), *base[1:]], 1), (11, base[:32], 1), (None, base, 1), (12, [x * 1e30 for x in base], 1),
        (13, [x * 1e-30 for x in base], 1),
    ]
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], f"{SCHEMA}, n_links int, cell string")
    found = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(table).collect() if r["vec_id"])
    assert [f for f in found if f[0] in (3, 4, 5, 6, 7, 8, 9, 10, 11)] == [(i, 0, i) for i in range(3, 12)]
    assert [f[2] for f in found if f[0] in (1, 2, 12, 13)] == [1] * 5
    assert len(found) == len(rows) - 1
    empty = embeddings.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(1, None, 1)], SCHEMA)).first()["kept"]


def test_every_length_and_equal_vectors(spark, documents):
    """Vectors of several lengths link within their own; a third of all vectors equal is one row of the index."""
    documents([])
    rng = np.random.default_rng(6)
    rows, i = [], 0
    for dims, n in ((64, 60), (32, 40), (3, 30)):
        for v in rng.normal(size=(n, dims)):
            for copy in ([v, v * 2.0, v + 1e-3 * rng.normal(size=dims)] if i % 2 else [v]):
                rows.append((i, [float(np.float32(x)) for x in copy], i % 3))
                i += 1
    same = [float(np.float32(x)) for x in rng.normal(size=64)]
    rows += [(i + k, same, 1) for k in range(150)] + [(i + 200, [*same[:-1], same[-1] * 1.0001], 1), (i + 201, same[:32], 1)]
    counts, lead = {}, {}
    for dims in (64, 32, 3):
        some = [r for r in rows if len(r[1]) == dims]
        for found, own in zip((counts, lead), brute(some, dims=dims), strict=True):
            found.update(own)
    found = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), target=1).collect()
    assert {r["vec_id"]: r["n_links"] for r in found} == counts
    assert {r["vec_id"]: r["component_id"] for r in found} == lead
    assert counts[i] == 150


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(8)
    for density in (0.01, 0.05, 0.5):
        near = rng.random((40, 50)) < density
        edges = embeddings.forest(near)
        assert all(near[r, c] for r, c in edges)
        lead = list(range(90))

        def root(i, lead=lead):
            while lead[i] != i:
                i = lead[i]
            return i

        for r, c in edges:
            assert root(r) != root(40 + c)
            lead[root(r)] = root(40 + c)
        assert all(root(r) == root(40 + c) for r, c in zip(*np.nonzero(near), strict=True))
