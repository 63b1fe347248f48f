import pytest
from pyspark.sql import functions as F

from seqnet.llm import licenses


def test_hashes_match_spark(spark):
    words = "permission is hereby granted free".split()
    row = spark.range(1).select(F.xxhash64(*[F.lit(w) for w in words]).alias("h"), F.xxhash64(F.lit(-5).cast("long"), F.lit(3)).alias("p")).first()
    assert row["h"] == licenses.shingle_hash(words)
    assert row["p"] == licenses.permuted(-5, 3)


def test_bands_make_collisions_likely():
    for window, group in licenses.classes_of(licenses.templates_of()):
        for template in group:
            common = -(-len(template.shingles) * 4 // 5)
            similarity = common / (window.size + len(template.shingles) - common)
            assert 1 - (1 - similarity) ** window.bands >= licenses.COLLISION or similarity == 1


def contained(text, words, window):
    """Largest share of a notice's shingles in any window, compared as strings."""
    own = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    seen = licenses.words_of(text)
    shingles = [tuple(seen[i : i + 5]) for i in range(len(seen) - 4)]
    shares = [len(own & set(shingles[a : a + window.size])) / len(own) for a in range(0, max(1, len(shingles)), window.stride)]
    return max(shares, default=0)


def test_notices_at_every_place_and_with_changed_words(documents):
    rows, number = [], 0
    for at in (0, 1, 7, 50):
        for _, notice in licenses.NOTICES:
            words = notice.split()
            for edit in (None, len(words) // 2, len(words) - 1):
                text = [w if i != edit else "changed" for i, w in enumerate(words)]
                rows.append((number, " ".join(["filler"] * at + text + ["after"] * 9)))
                number += 1
    found = {(r["doc_id"], r["template"]): r["containment"] for r in licenses.scan(documents(rows)).collect()}
    want = {}
    for window, group in licenses.classes_of(licenses.templates_of()):
        for t in group:
            for i, text in rows:
                share = contained(text, licenses.words_of(licenses.NOTICES[t.number][1]), window)
                if share >= licenses.CONTAINED:
                    want[i, t.number] = share
    assert found == want
    assert len(want) >= 4 * len(licenses.NOTICES)


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(documents, odd_rows, clashing):
    long = "filler words " * 50_000 + licenses.NOTICES[0][1]
    rows = [*odd_rows, (40, long), (None, licenses.NOTICES[2][1]), (41, licenses.NOTICES[4][1]), (41, licenses.NOTICES[4][1]), (42, "the MIT License")]
    found = licenses.scan(documents(rows, clashing)).collect()
    assert sorted((r["doc_id"] or 0, r["license"]) for r in found) == [(0, "Apache-2.0"), (40, "MIT"), (41, "GPL-3.0"), (41, "GPL-3.0")]
    assert licenses.scan(documents([])).count() == 0
