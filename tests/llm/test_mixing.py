import math
from collections import defaultdict
from hashlib import md5

import pytest

from seqnet.llm import mixing
from seqnet.llm.catalog import QUERIES

TABLES = "/root/testdata/sf0.001"


def plain_rates(cells, targets, budget, rounds):
    """Raking cell by cell: ``cells`` maps (source, lang, topic) to tokens, ``targets`` a list of three share maps."""
    total = sum(cells.values())
    weight = {c: n * budget for c, n in cells.items() if n}
    for _ in range(rounds):
        for k, target in enumerate(targets):
            have = defaultdict(float)
            for c, w in weight.items():
                have[c[k]] += w
            for c, w in weight.items():
                factor = target.get(c[k], 0.0) * total * budget / have[c[k]] if have[c[k]] > 0 else 0.0
                weight[c] = min(w * factor, float(cells[c]))
    return {c: w / cells[c] for c, w in weight.items()}


def test_query_equals_raking_by_hand(spark):
    rows = QUERIES["op6_source_mixing"](spark, TABLES).collect()
    cells = defaultdict(int)
    for r in rows:
        cells[r["source"], r["lang"], r["topic"]] += r["tokens"]
    targets = []
    for k in range(3):
        sums = defaultdict(int)
        for c, n in cells.items():
            sums[c[k]] += n
        powers = {c: n**mixing.EVEN for c, n in sums.items() if n}
        targets.append({c: p / sum(powers.values()) for c, p in powers.items()})
    rates = plain_rates(cells, targets, mixing.BUDGET, mixing.ROUNDS)
    for r in rows:
        want = rates.get((r["source"], r["lang"], r["topic"]), 0.0)
        assert math.isclose(r["probability"], want, abs_tol=1e-6)
        assert r["sampled"] == (int(md5(str(r["doc_id"]).encode()).hexdigest()[:12], 16) / 2**48 < r["probability"])


def test_marginals_meet_targets(spark):
    rows = [(f"s{i}", f"l{j}", f"t{k}", 100 + 37 * i * j + 11 * k) for i in range(3) for j in range(2) for k in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    wanted = {"source": [0.4, 0.35, 0.25], "lang": [0.6, 0.4], "topic": [0.5, 0.5]}
    targets = {m: spark.createDataFrame([(f"{m[0]}{i}", x) for i, x in enumerate(shares)], f"{m} string, target double") for m, shares in wanted.items()}
    found = mixing.calibrated(cells, targets, budget=0.3, rounds=40).collect()
    goal = 0.3 * sum(r[3] for r in rows)
    for margin, shares in wanted.items():
        for i, share in enumerate(shares):
            assert math.isclose(sum(r["weight"] for r in found if r[margin] == f"{margin[0]}{i}"), share * goal, rel_tol=1e-6)
    assert all(r["weight"] <= r["tokens"] for r in found)


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(documents, odd_rows, clashing):
    rows = [(*r, None, None, 5) for r in odd_rows[:4]] + [(*r, "en", "src1", None) for r in odd_rows[4:]]
    docs = documents(rows, clashing)
    found = mixing.mixed(docs).collect()
    assert len(found) == len(rows)
    assert all(0 <= r["probability"] <= 1 for r in found)
    assert {(r["source"], r["lang"]) for r in found} == {("(none)", "(none)"), ("src1", "en")}
    assert all(r["probability"] == 0 and not r["sampled"] for r in found if r["tokens"] == 0)
    kept = mixing.mix(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(r["doc_id"] or 0 for r in found if r["sampled"])


def test_empty_table(documents):
    assert mixing.mixed(documents([])).count() == 0
    assert mixing.mix(documents([])).count() == 0
