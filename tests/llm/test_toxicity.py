from zlib import crc32

import numpy as np
import pytest

from seqnet.llm import toxicity
from seqnet.llm.catalog import QUERIES


def area(scores, labels):
    """Area under the ROC curve: the share of pairs in the right order; equal scores count half."""
    _, place, number = np.unique(scores, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(number) - (number - 1) / 2)[place]
    n = (labels == 1).sum()
    return (ranks[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = QUERIES["op3_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    scores, labels = np.array([r["score"] for r in found]), np.array([r["toxic"] for r in found])
    assert all((crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert area(scores, labels) > 0.97
    assert (scores[labels == 0] >= 0.5).mean() < 0.01
    # Of the toxic documents that were not learnt from, over nine in ten are found.
    assert (scores[labels == 1] >= 0.5).mean() > 0.9


def test_a_very_long_text_takes_no_others_place(spark, documents):
    """A text beyond the bound of the sample is left out alone."""
    toxic = [(i, f"the quiet river runs along the old mill {'you worthless fool' if i % 2 else 'and the valley'} number {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(201)], "doc_id bigint, quality int, toxic int")
    long = next(i for i in range(200) if crc32(str(i).encode()) % 5)
    rows = [(i, "long " * 2_500_000 if i == long else t) for i, t in toxic]
    model = toxicity.fit(documents(rows), labels)
    assert model.score(["such a worthless fool he is"])[0] > 0.5 > model.score(["the old mill and the river"])[0]


def test_misspellings_share_grams():
    clean = ["the quiet river runs along the valley and the old mill", "a small garden with red flowers near the house"] * 40
    toxic = [f"{c} you worthless fool" for c in clean]
    model = toxicity.train([t for pair in zip(clean, toxic, strict=True) for t in pair], [0, 1] * len(clean))
    bad, fine = model.score(["the mill is worthlesss and old", "the mill is in the valley and old"])
    assert bad > 0.5 > fine


def test_long_texts_count_whole():
    """Toxic words at the very end of a long text count as in a short one; blocks do not matter."""
    clean = ["the quiet river runs along the valley and the old mill"] * 60
    model = toxicity.train([t for c in clean for t in (c, c + " worthless fool")], [0, 1] * 60)
    long = " ".join(clean * 500)
    assert model.score([long + " worthless fool"])[0] > 0.5 > model.score([long])[0]
    many = [clean[0], "", long, clean[0] + " worthless fool"] * 3
    assert np.allclose(model.score(many), np.concatenate([model.score([t]) for t in many]))


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(spark, documents, odd_rows, clashing):
    docs = documents(odd_rows, clashing)
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(1, 11)] + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == len(odd_rows)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {None}
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_without_labels_nothing_goes(spark, documents, odd_rows):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.drop_toxic(documents(odd_rows), none).count() == len(odd_rows)
    assert toxicity.toxicity(documents([]), none).count() == 0


def test_sample_is_whole():
    """The bound that the README states."""
    assert (toxicity.SAMPLE_ROWS, toxicity.SAMPLE_CHARS) == (2500, 12_000_000)
