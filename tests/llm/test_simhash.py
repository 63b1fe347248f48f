import numpy as np
import pytest
import xxhash

from seqnet.llm import simhash
from seqnet.llm.catalog import QUERIES

TABLES = "/root/testdata/sf0.001"


def plain_mark(text, width):
    """The fingerprint bit by bit."""
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(marks, distance):
    """Least id reachable, by comparing all pairs."""
    ids = sorted({i for i, _ in marks if i is not None})
    lead = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in marks:
            for j, b in marks:
                if None not in (i, j) and (a ^ b).bit_count() <= distance and lead[i] != lead[j]:
                    lead[i] = lead[j] = min(lead[i], lead[j])
                    changed = True
    return lead


def similar_groups(texts, width=5, distance=8, similarity=0.8):
    """Least id reachable over equal fingerprints, and close ones whose shingle sets are similar, by all pairs."""
    marks = {i: plain_mark(t, width) for i, t in texts.items()}
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    lead = {i: i for i in texts}
    near = []
    for i in texts:
        for j in texts:
            apart = (marks[i] ^ marks[j]).bit_count()
            if i < j and (apart == 0 or apart <= distance and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])):
                near.append((i, j))
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if lead[i] != lead[j]:
                lead[i] = lead[j] = min(lead[i], lead[j])
                changed = True
    return lead


@pytest.mark.parametrize("distance", [4, 8])
def test_similarity_decides_among_close_fingerprints(spark, documents, distance):
    """Copies with more and more words changed: those of similarity 0.8 within the distance are one group."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(200)]
    texts = {0: " ".join(base)}
    for i in range(1, 40):
        words = list(base)
        for k in rng.choice(200, i // 2, replace=False):
            words[k] = f"other{i}x{k}"
        texts[i] = " ".join(words)
    texts |= {100 + i: " ".join(f"u{i}v{k}" for k in range(150)) for i in range(10)}
    found = simhash.near_duplicates(documents(list(texts.items())), width=5, max_distance=distance, similarity=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == similar_groups(texts, 5, distance)
    assert {0, 1, 2, 3} <= {r["doc_id"] for r in found if r["component_id"] == 0}


def jaccard_groups(texts, width=5, similarity=0.8):
    """Least id reachable over texts whose shingle sets are similar, by all pairs, whatever their fingerprints."""
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    near = [(i, j) for i in texts for j in texts if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    lead = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if lead[i] != lead[j]:
                lead[i] = lead[j] = min(lead[i], lead[j])
                changed = True
    return lead


def near_copies():
    """Pairs of short texts of similarity near 0.8, whose fingerprints are up to over 12 bits apart."""
    rng = np.random.default_rng(11)
    texts = {}
    for i in range(200):
        words = [f"p{i}w{k}" for k in range(64)]
        texts[2 * i] = " ".join(words)
        texts[2 * i + 1] = " ".join([*words[: 64 - rng.integers(3, 9)], *(f"q{i}x{k}" for k in range(rng.integers(0, 7)))])
    return texts


def test_similarity_alone_decides(spark, documents):
    """Every pair of Jaccard 0.8 is found, however far apart its fingerprints are, and nothing else."""
    texts = near_copies()
    lead = jaccard_groups(texts)
    far = [(plain_mark(texts[i], 5) ^ plain_mark(texts[i + 1], 5)).bit_count() for i in range(0, len(texts), 2) if lead[i + 1] == i]
    assert max(far) > 12 and any(lead[i + 1] != i for i in range(0, len(texts), 2))
    found = simhash.near_duplicates(documents(list(texts.items())), width=5, max_distance=None, similarity=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == lead


def test_query_equals_all_pairs(spark):
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    marks = [(r["doc_id"], plain_mark(r["text"], 4)) for r in rows]
    lead = plain_groups(marks, 4)
    found = QUERIES["op1_simhash_near_dedup"](spark, TABLES).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found} == {(i, f"{m:016x}", lead[i]) for i, m in marks}
    assert len(found) == len(rows)
    assert sum(r["kept"] for r in found) == len(set(lead.values()))


@pytest.mark.parametrize("distance", [0, 1, 4])
def test_links_of_close_fingerprints(spark, documents, distance):
    """One dense ball, two distant ones, and noise: every link is found."""
    documents([])
    rng = np.random.default_rng(3)
    marks = list(rng.integers(-(1 << 63), 1 << 63, 300))
    for center in marks[:3]:
        for _ in range(60):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            marks.append(np.int64(center) ^ np.bitwise_or.reduce(np.int64(1) << flips.astype(np.int64)))
    marks = sorted({int(m) for m in marks})
    classes = spark.createDataFrame([(m, i) for i, m in enumerate(marks)], "fp bigint, first bigint")
    found = {(r["src"], r["dst"]) for r in simhash.links(classes, distance).collect()}
    near = {(a, b) for a in marks for b in marks if a > b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance}
    assert found == near


def test_units_add_up():
    groups = simhash.correlated_groups(np.random.default_rng(0).random((64, 64)), 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    plan = simhash.Plan(groups, 4)
    counts = {(g, b): np.random.default_rng(g * 9 + b).integers(0, 50, 256) for g, blocks in enumerate(plan.blocks) for b, _ in enumerate(blocks)}
    plan.learn(counts, 1000.0)
    units, cost = plan.units(simhash.bits_of(np.arange(1000, dtype=np.int64)))
    assert (units.sum(axis=1) == 5).all()
    assert np.isfinite(cost).all()


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(documents, odd_rows, clashing):
    docs = documents(odd_rows, clashing)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(odd_rows)
    group = {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None}
    assert group[2] == 1 and group[4] == group[5] == 3 and group[7] == 6 and group[9] == 9
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3, 6, 8, 8, 9, 10]


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.drop_near_duplicates(documents([])).count() == 0


def test_equal_fingerprints_are_compared_too(spark, documents):
    """One shingle that makes over half of a text is its fingerprint; what else the text holds still decides."""
    filler = "x " * 200
    texts = {i: filler + " ".join(f"t{i}w{k}" for k in range(90)) for i in range(12)}
    texts |= {20 + i: texts[i] + " end" for i in range(3)}
    texts |= {30: "x " * 300 + texts[5], 31: texts[6]}
    assert len({plain_mark(t, 5) for t in texts.values()}) == 1
    lead = jaccard_groups(texts)
    assert len(set(lead.values())) == 12
    for distance in (8, None):
        found = simhash.near_duplicates(documents(list(texts.items())), width=5, max_distance=distance, similarity=0.8).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == lead


def test_sets_reach_workers_in_small_batches(spark, documents, monkeypatch):
    """Shingle sets never cross to a worker by the thousand, and the session's setting is as it was."""
    rows, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before = spark.conf.get(rows)
    for name in ("cut", "write_table"):
        def noted(df, *args, _run=getattr(simhash, name), **options):
            seen[tuple(df.columns)] = int(spark.conf.get(rows))
            return _run(df, *args, **options)

        monkeypatch.setattr(simhash, name, noted)
    texts = near_copies()
    simhash.near_duplicates(documents(list(texts.items())), width=5, max_distance=None, similarity=0.8).collect()
    held = [n for columns, n in seen.items() if {"shingles", "prefix"} & set(columns)]
    assert held and max(held) <= 500
    assert spark.conf.get(rows) == before
    assert simhash.BLOCK_BYTES <= 8 << 20
