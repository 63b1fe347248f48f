"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's embedding is the mean of the vectors of its character n-grams, so a misspelt or
inflected word shares most of its vectors with the word it comes from.  Word embeddings
are averaged over a window of one to three words and fed to a linear softmax over two classes;
embeddings and softmax are trained jointly in numpy.  A document is as toxic as its worst
window of any width, so a single word in a very long document counts as much as in a short
one; its next worst words add half of what they have above the worst windows of nearly all
clean texts.  Marks at the ends of words are blanks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqnet.llm.common import sliced

#: At most so many labelled documents of each class, and so many code points in all, are learnt from.
SAMPLE_ROWS = 2500
SAMPLE_CHARS = 12_000_000
FOLDS = 5
#: Share of clean texts that calibration lets pass for toxic, and how far one half lies from there to all but a tenth of the toxic texts.
CLEAN_ERROR, MARGIN = 0.008, 0.25
#: Words behind the worst that count, their weight, and the share of clean texts whose worst window is below where they start to.
FURTHER, FURTHER_WEIGHT, FURTHER_FROM = 5, 0.5, 0.9
#: Code points that end a word, and marks that end one unless they stand between two letters or digits.
SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()], np.uint32)
#: Code points read at a time.
CHUNK_CHARS = 500_000


@dataclass
class Settings:
    bucket_bits: int = 17
    dims: int = 8
    shortest: int = 4
    longest: int = 6
    window: int = 3
    rounds: int = 40
    rate: float = 1.0
    decay: float = 1e-4
    hard: int = 4
    seed: int = 7


def code_points(text: str) -> np.ndarray:
    """The lower-cased text as code points, blanks for white space and outer marks, one blank at either end."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    blank = (codes <= 32) | ((codes >= 0x85) & np.isin(codes, SPACES))
    mark = np.zeros(128, bool)
    mark[MARKS] = True
    marks = (codes < 128) & mark[np.minimum(codes, 127)]
    firm = ~(blank | marks)
    marks[1:-1] &= ~(firm[:-2] & firm[2:])
    return np.where(blank | marks, np.uint32(32), codes)


def grams(codes: np.ndarray, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n-gram size the buckets of all n-grams and the number of the word each is of.

    An n-gram may hold the blank before or after its word, so it knows the word's ends.
    """
    letter = codes != 32
    word = np.cumsum(letter & ~np.concatenate([[False], letter[:-1]])) - 1
    wide = codes.astype(np.uint64)
    hashes, inside = wide[:-1] * np.uint64(0x100000001B3) + wide[1:], letter[1:]
    for size in range(3, settings.longest + 1):
        hashes = hashes[:-1] * np.uint64(0x100000001B3) + wide[size - 1 :]
        inside = inside[: len(hashes)] if size == 3 else inside[: len(hashes)] & letter[size - 2 : size - 2 + len(hashes)]
        if size >= settings.shortest:
            at = np.flatnonzero(inside)
            mixed = (hashes[at] ^ (hashes[at] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(64 - settings.bucket_bits)).astype(np.int64), word[at + 1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50.0, 50.0)))


def gathered(worst: np.ndarray, further: np.ndarray, floor: float) -> np.ndarray:
    """The worst window's logit, and a part of what the next worst words have above the floor.

    Below the floor there is no evidence: a long clean text ranks no higher than a short one.
    """
    least = floor if np.isfinite(floor) else -np.inf
    return np.maximum(worst, least) + FURTHER_WEIGHT * np.maximum(further - floor, 0.0).sum(axis=1)


@dataclass
class Model:
    """A score per n-gram bucket (embedding times softmax weights), and the calibration of the worst window."""

    settings: Settings
    gram_scores: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    floor: float = np.inf

    def word_scores(self, codes: np.ndarray) -> np.ndarray:
        """Mean n-gram score of each word."""
        words = int((codes[1:] != 32)[codes[:-1] == 32].sum())
        total, number = np.zeros(words), np.zeros(words)
        for buckets, word in grams(codes, self.settings):
            total += np.bincount(word, self.gram_scores[buckets], words)
            number += np.bincount(word, minlength=words)
        return total / np.maximum(number, 1)

    def readings(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The largest logit of a window of each text, that of no words at all for an empty text, and the logits of its next worst words.

        Texts are read some at a time, so memory does not grow with their number.
        """
        worst, further = np.full(len(texts), self.bias), np.full((len(texts), FURTHER), -np.inf)
        begin, chars = 0, 0
        for end, text in enumerate(texts, 1):
            chars += len(text)
            if chars >= CHUNK_CHARS or end == len(texts):
                self._read(texts[begin:end], worst[begin:end], further[begin:end])
                begin, chars = end, 0
        return worst, further

    def _read(self, texts: list[str], worst: np.ndarray, further: np.ndarray) -> None:
        codes = [code_points(t) for t in texts]
        counts = [int((c[1:] != 32)[c[:-1] == 32].sum()) for c in codes]
        scores, at = self.word_scores(np.concatenate(codes)), 0
        for i, n in enumerate(counts):
            if n:
                own = scores[at : at + n]
                sums = np.concatenate([[0.0], np.cumsum(own)])
                worst[i] += max((sums[size:] - sums[:-size]).max() / size for size in range(1, min(self.settings.window, n) + 1))
                most = min(n, FURTHER + 1)
                next_ = np.sort(own[np.argpartition(own, -most)[-most:]])[-2::-1]
                further[i, : len(next_)] = self.bias + next_
            at += n

    def worst(self, texts: list[str]) -> np.ndarray:
        """The logit of each text."""
        return gathered(*self.readings(texts), self.floor)

    def score(self, texts: list[str]) -> np.ndarray:
        """Chance of the toxic label, for texts of any number and length."""
        return sigmoid(self.slope * self.worst(texts) + self.shift)


def constant(share: float, settings: Settings) -> Model:
    """Every text scores this share, at most one half."""
    share = float(np.clip(share, 0.01, 0.49))
    return Model(settings, np.zeros(1 << settings.bucket_bits), slope=0.0, shift=float(np.log(share / (1 - share))))


def train(texts: list[str], labels: list[int], settings: Settings | None = None) -> Model:
    """Fit embeddings and softmax together, and calibrate the worst window's logit.

    The calibration is learnt from logits that models of the other folds give each text; the
    model itself learns from all.  Without both classes, every text scores the share of toxic labels, at most one half.
    """
    s = settings or Settings()
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return constant(y.mean() if len(y) else 0.0, s)
    model = fit_weights(texts, y, s)
    if model is None:
        return constant(0.0, s)
    # Folds by rank within the class, so that each has its share of both.
    fold = np.zeros(len(y), np.int64)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % FOLDS
    worst, further = np.full(len(y), model.bias), np.full((len(y), FURTHER), -np.inf)
    for k in range(FOLDS):
        own = np.flatnonzero(fold == k)
        others = np.flatnonzero(fold != k)
        part = fit_weights([texts[i] for i in others], y[others], s) if len(set(y[others])) == 2 else None
        worst[own], further[own] = (part or model).readings([texts[i] for i in own])
    model.floor = float(np.quantile(worst[y == 0], FURTHER_FROM))
    calibrate(model, gathered(worst, further, model.floor), y)
    return model


def fit_weights(texts: list[str], own: np.ndarray, s: Settings) -> Model | None:
    """Full-batch Adagrad; nothing if the texts with words are all of one class.

    The first rounds use whole documents; later ones the worst window of each toxic document
    and the ``hard`` worst windows of each clean one.
    """
    rng, buckets = np.random.default_rng(s.seed), 1 << s.bucket_bits
    vocabulary: dict[str, int] = {}
    docs = []
    for text in texts:
        words = code_points(text).tobytes().decode("utf-32-le").split(" ")
        docs.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words if w], np.int32))
    keep = [i for i, d in enumerate(docs) if len(d)]
    docs, own = [docs[i] for i in keep], own[keep]
    if not docs or own.min() == own.max():
        return None
    found = list(grams(code_points(" ".join(vocabulary)), s))
    flat, holder = (np.concatenate([f[i].astype(np.int32) for f in found]) for i in (0, 1))
    del found
    sizes = np.maximum(np.bincount(holder, minlength=len(vocabulary)), 1)
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    tokens = np.concatenate(docs)
    offsets = np.cumsum(lengths) - lengths
    balance = np.where(own == 1, 0.5 / max(1, (own == 1).sum()), 0.5 / max(1, (own == 0).sum()))

    table = rng.normal(0.0, 0.01, (buckets, s.dims))
    weights, bias = rng.normal(0.0, 1.0, (s.dims, 2)) / np.sqrt(s.dims), np.zeros(2)
    sums_table, sums_weights, sums_bias = np.full(buckets, 1e-8), np.full((s.dims, 2), 1e-8), np.full(2, 1e-8)

    def windows(scores: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, first token and token number of the windows learnt from."""
        doc, first, size = [], [], []
        for d, (at, n) in enumerate(zip(offsets.tolist(), lengths.tolist(), strict=True)):
            sums = np.concatenate([[0.0], np.cumsum(scores[at : at + n])])
            worst: list[tuple[float, int, int]] = []
            for w in range(1, min(s.window, n) + 1):
                values = (sums[w:] - sums[:-w]) / w
                most = min(s.hard, len(values))
                worst += [(values[p], p, w) for p in np.argpartition(values, -most)[-most:].tolist()]
            for _, place, w in sorted(worst, reverse=True)[: 1 if own[d] else s.hard]:
                doc.append(d)
                first.append(place + at)
                size.append(w)
        return np.array(doc), np.array(first), np.array(size)

    for turn in range(s.rounds):
        # A word's embedding meets the softmax only through this difference of its two columns.
        apart = weights[:, 1] - weights[:, 0]
        scores = np.bincount(holder, (table @ apart)[flat], len(sizes)) / sizes
        if turn < s.rounds // 4:
            doc, first, size = np.arange(len(docs)), offsets, lengths
            divide = lengths
        else:
            doc, first, size = windows(scores[tokens])
            divide = size
        each = np.repeat(np.arange(len(doc)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        word = tokens[place]
        chance = sigmoid(np.bincount(each, scores[word], len(doc)) / divide + bias[1] - bias[0])
        error = (chance - own[doc]) * balance[doc] / np.bincount(doc, minlength=len(docs))[doc]
        grad_word = np.bincount(word, (error / divide)[each], len(sizes)) / sizes
        grad_bucket = np.bincount(flat, grad_word[holder], buckets)
        pull = table.T @ grad_bucket
        grad_weights = np.stack([-pull, pull], axis=1) + s.decay * weights
        grad_bias = np.array([-error.sum(), error.sum()])
        grad_table = grad_bucket[:, None] * apart[None, :]
        sums_table += (grad_table**2).mean(axis=1)
        sums_weights += grad_weights**2
        sums_bias += grad_bias**2
        table -= s.rate * grad_table / np.sqrt(sums_table)[:, None]
        weights -= s.rate * grad_weights / np.sqrt(sums_weights)
        bias -= s.rate * grad_bias / np.sqrt(sums_bias)

    return Model(s, table @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0]))


def calibrate(model: Model, logits: np.ndarray, y: np.ndarray) -> None:
    """Logistic slope of the label on the worst window's logit, and one half where few clean texts reach it.

    One half lies above all but ``CLEAN_ERROR`` of the clean logits, by ``MARGIN`` of the way to
    all but a tenth of the toxic ones, if those are higher; so a single toxic word among clean
    neighbours passes it where the classes are far apart.
    """
    toxic = y == 1
    edge = float(np.quantile(logits[~toxic], 1 - CLEAN_ERROR))
    half = edge + MARGIN * max(0.0, float(np.quantile(logits[toxic], 0.1)) - edge)
    scale = float(logits.std()) or 1.0
    x = (logits - half) / scale
    weight = np.where(toxic, max(1.0, (~toxic).sum() / max(1, toxic.sum())), 1.0)
    goal = np.where(toxic, 1 - 1 / (2 + toxic.sum()), 1 / (2 + (~toxic).sum()))
    steep = 1.0
    for _ in range(50):
        chance = sigmoid(x * steep)
        slope = float((weight * chance * (1 - chance) * x * x).sum()) + 1e-3
        steep -= float(np.clip(((weight * (chance - goal) * x).sum() + 1e-3 * steep) / slope, -2.0, 2.0))
        steep = max(steep, 0.05)
    model.slope, model.shift = steep / scale, -steep * half / scale


def fold(key: str = "doc_id"):
    """crc32 of the id as text, modulo five: zero for held-out rows.  Null where the id is."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Train on labelled rows outside fold zero.

    The sample is bounded: of each class the ``SAMPLE_ROWS`` rows of least id hash; then, the
    shorter texts first, as many as ``SAMPLE_CHARS`` code points hold, each text whole.  So a
    very long text takes no other's place.  Rows without id or label are left out; of
    contradicting labels the toxic one counts.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    rows = rows.filter(fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [rows.filter(F.col("toxic") == c).orderBy(*order).limit(SAMPLE_ROWS) for c in (0, 1)]
    some = picked[0].unionByName(picked[1])
    # At most twice SAMPLE_ROWS pairs of numbers are sent to the executors.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    # At most twice SAMPLE_ROWS texts, unless rows repeat an id.
    before = F.sum(F.length("text")).over(Window.orderBy(F.length("text"), *order, "text").rowsBetween(Window.unboundedPreceding, 0))
    sample = texts.withColumn("so_far", before).filter(F.col("so_far") <= SAMPLE_CHARS)
    settings = settings or Settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((b["so_far"][i].as_py(), b["text"][i].as_py(), b["toxic"][i].as_py()) for b in batches for i in range(b.num_rows)))
        made = train([r[1] for r in rows], [r[2] for r in rows], settings)
        numbers = np.concatenate([[made.bias, made.slope, made.shift, made.floor], made.gram_scores])
        yield pa.RecordBatch.from_arrays([pa.array([numbers.tobytes()], pa.binary())], names=["model"])

    # One task trains on the bounded sample; the driver gets the model, a megabyte.
    found = sample.select("so_far", "text", "toxic").coalesce(1).mapInArrow(run, "model binary").collect()
    if not found:
        return train([], [], settings)
    numbers = np.frombuffer(found[0]["model"], np.float64)
    return Model(settings, numbers[4:], *numbers[:4].tolist())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row; only the text is looked at.  Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``.

    Empty and null texts get the score of no words.  A null id is held out of nothing and
    gives a null ``held_out``.  Repeated rows score alike, other columns are ignored, and an
    empty table gives an empty result; without labels of both classes nothing is toxic.
    """
    rows = scored(docs, fit(docs, labels, settings))
    return rows.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``docs`` without the rows that score one half or more; columns and other rows as they came."""
    model = fit(docs, labels, settings)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            clean = model.score([text or "" for text in batch.column(at).to_pylist()]) < 0.5
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
