"""Language-model scores of documents by context-tree weighting.

The model reads a text's UTF-8 bytes, A-Z lower-cased, and one end byte.  A byte is eight
binary decisions; the context of a decision is the bytes before it (up to ``DEPTH``) and
the decisions made already.  Every context keeps the zeros and ones that followed it in the
training texts.  Its Krichevsky-Trofimov estimate and the product of its longer contexts
are mixed with equal prior weight, at every depth, so the weight a context carries follows
from how well it explained the training texts as compared with its longer contexts.  The
score of a text is the sum over its bytes of the mixture's log10 probability.

All counts come from sequences of ``DEPTH + 1`` bytes, counted over all training texts:

1. Documents are dealt by hash into batches of some 32 MB.  A batch reports its different
   sequences and words, each with the number of times that training texts hold it.
2. The counts are summed.  Sequences are numbers whose highest byte is the latest one of the
   context, so a context and its longer ones are a stretch of the sorted numbers.  A stretch
   of contexts that share three bytes is worked off in one task for all depths above three;
   the three shorter depths are sums over their children, one small job each.
3. Every batch gets the values of the sequences and words that it asked for, and scores its
   documents.  No task or driver ever holds the whole model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqnet.llm.common import raw_text
from seqnet.plans.lineage import cut, write_table

#: Bytes of context.  A sequence of ``DEPTH + 1`` bytes must fit into 63 bits.
DEPTH = 5
#: Contexts that share so many latest bytes are worked off together.
SHARED = 3
#: A byte that no UTF-8 text holds ends a text, and stands for what is before its start.
END = 0xFF
#: Bytes of text in a batch, sequences in a piece of the model, bytes of text turned into numbers at a time.
BATCH_BYTES, PIECE_ROWS, BLOCK = 32 << 20, 50_000, 1 << 18
#: Counted blocks that are added up together.
MERGE = 8
#: Smoothing of the word model, and the share of documents that is not learnt from.
SMOOTHING, FOLDS = 0.1, 10


def held_out(key: str) -> Column:
    """Whether a document is not learnt from: by the CRC of its id as text; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def batched(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``batch, doc_id, held, raw``: documents dealt by hash, as many batches as the bytes ask for."""
    raw = raw_text(text)
    total = docs.agg(F.sum(F.octet_length(raw).cast("long")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    batches = max(1, math.ceil(((total["n"] or 0) + 64 * total["rows"]) / BATCH_BYTES))
    return docs.select(
        F.pmod(F.xxhash64(id_col, raw), F.lit(batches)).cast("int").alias("batch"), F.col(id_col).alias("doc_id"), held_out(id_col).alias("held"), raw.alias("raw")
    )


def sequences(texts: Iterable[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers of all byte sequences of the texts, and the text that each ends in, block by block.

    The latest byte of the context is the highest one of a number, the byte that follows is its lowest.
    """
    start = bytes([END]) * depth
    parts, owners, held = [], [], 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        joined = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        numbers = joined[depth:].copy()
        for back in range(1, depth + 1):
            numbers |= joined[depth - back : len(joined) - back] << 8 * (depth + 1 - back)
        # The first bytes of a part only are context; windows that end there reach over its start.
        whole = np.ones(len(joined), bool)
        whole[((np.cumsum(sizes) - sizes)[:, None] + np.arange(depth)).ravel()] = False
        return numbers[whole[depth:]], np.repeat(np.array(owners, np.int64), sizes - depth)

    for owner, text in enumerate(texts):
        padded = start + text.lower() + start[:1]
        for at in range(0, len(padded) - depth, BLOCK):
            piece = padded[at : at + BLOCK + depth]
            parts.append(piece)
            owners.append(owner)
            held += len(piece)
            if held >= BLOCK:
                yield flush()
                parts, owners, held = [], [], 0
    if parts:
        yield flush()


def counted(numbers: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers, sorted, with the sum of their weights, or how often each is there."""
    if weights is None:
        numbers = np.sort(numbers)
    else:
        order = np.argsort(numbers)
        numbers, weights = numbers[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(numbers) else np.zeros(0, np.int64)
    if weights is None:
        return numbers[first], np.diff(np.append(first, len(numbers)))
    return numbers[first], np.add.reduceat(weights, first) if len(first) else weights


def texts_of(table: pa.Table) -> Iterator[bytes]:
    """The texts of a batch, one at a time."""
    return (raw.as_py() for raw in table["raw"])


def questions(table: pa.Table, depth: int) -> pa.Table:
    """``batch, number, word, n``: a batch's different sequences and words with their training counts."""
    train, parts = ~np.asarray(table["held"]), []
    for found, owner in sequences(texts_of(table), depth):
        learnt = train[owner]
        parts.append(counted(found[learnt]))
        other, n = counted(found[~learnt])
        parts.append((other, np.zeros_like(n)))
        if len(parts) >= MERGE:
            parts = [counted(*(np.concatenate(c) for c in zip(*parts, strict=True)))]
    numbers, counts = counted(*(np.concatenate(c) for c in zip(*parts, strict=True)))
    parts.clear()
    words: Counter[bytes] = Counter()
    for raw, learn in zip(texts_of(table), train, strict=True):
        own = raw.lower().split()
        words.update(own if learn else dict.fromkeys(own, 0))
    batch = table["batch"][0].as_py()
    n, m = len(numbers), len(words)
    return pa.table(
        {
            "batch": pa.array(np.full(n + m, batch, np.int32)),
            "number": pa.concat_arrays([pa.array(numbers), pa.nulls(m, pa.int64())]),
            "word": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(list(words), pa.binary())]),
            "n": pa.concat_arrays([pa.array(counts), pa.array(list(words.values()), pa.int64())]),
        }
    )


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x >= 1/2, by Stirling's series eight places up."""
    below = np.ones_like(x)
    for k in range(8):
        below = below * (x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(below)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def weighed(zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A context's mixed log probability, the weight of its own estimate, and its estimate of a one.

    ``longer`` is the sum of the mixed log probabilities of its longer contexts; None at full depth.
    """
    own, one = estimate(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
    if longer is None:
        return own, np.ones_like(own), one
    mixed = np.logaddexp(own, longer) - math.log(2)
    return mixed, np.exp(own - math.log(2) - mixed), one


class Stretch:
    """Contexts of ``SHARED`` to ``depth`` bytes over some sequences, which are sorted; a node is a context with the bits decided so far.

    Node numbers are the context's bytes and a last byte for the bits: 1, then each bit in turn.
    """

    def __init__(self, numbers: np.ndarray, counts: np.ndarray, depth: int):
        context, byte, counts = numbers >> 8 << 8, numbers & 255, counts.astype(np.float64)
        self.bits = [byte >> (7 - k) & 1 for k in range(8)]
        self.place, found, all_, ones, total = [], [], [], [], 0
        for k, bit in enumerate(self.bits):
            # The numbers are sorted, and so are the nodes of each bit.
            nodes = context | (1 << k) | (byte >> (8 - k))
            first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
            self.place.append(total + np.repeat(np.arange(len(first)), np.diff(np.append(first, len(nodes)))))
            found.append(nodes[first])
            all_.append(np.add.reduceat(counts, first))
            ones.append(np.add.reduceat(counts * bit, first))
            total += len(first)
        found, all_, ones = map(np.concatenate, (found, all_, ones))
        self.nodes, self.up, self.figures = [found], [], [(all_ - ones, ones)]
        mixed, *rest = weighed(all_ - ones, ones, None)
        self.weights = [rest]
        for _ in range(depth - SHARED):
            shorter = (self.nodes[-1] >> 16 << 8) | (self.nodes[-1] & 255)
            found, up = np.unique(shorter, return_inverse=True)
            zeros, ones = (np.bincount(up, figure, len(found)) for figure in self.figures[-1])
            mixed, *rest = weighed(zeros, ones, np.bincount(up, mixed, len(found)))
            self.nodes.append(found)
            self.up.append(up)
            self.figures.append((zeros, ones))
            self.weights.append(rest)
        self.mixed = mixed

    def scores(self, nodes: np.ndarray, above: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 probability of each sequence's last byte.

        ``above`` is what the shorter contexts add to the probability of a one at each node of
        the shortest depth here, ``left`` the weight that they leave.
        """
        at = np.searchsorted(nodes, self.nodes[-1])
        above, left = above[at], left[at]
        for level in reversed(range(len(self.nodes))):
            own, one = self.weights[level]
            if level < len(self.up):
                above, left = above[self.up[level]], left[self.up[level]]
            above, left = above + left * own * one, left * (1 - own)
        logs = np.log10(above), np.log10(np.maximum(1 - above, 1e-17))
        return sum(np.where(bit == 1, logs[0][place], logs[1][place]) for bit, place in zip(self.bits, self.place, strict=True))


def rows_weighed(level: DataFrame) -> DataFrame:
    """``node, zeros, ones, mixed, own, one`` of contexts given with the sums of their longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zeros, ones, longer = (batch.column(i).to_numpy() for i in (1, 2, 3))
            cells = [batch.column(0), batch.column(1), batch.column(2), *(pa.array(c) for c in weighed(zeros, ones, longer))]
            yield pa.RecordBatch.from_arrays(cells, names=["node", "zeros", "ones", "mixed", "own", "one"])

    return level.mapInArrow(run, "node bigint, zeros double, ones double, mixed double, own double, one double")


def model(counts: DataFrame, rows: int, depth: int = DEPTH) -> DataFrame:
    """``number, value``: log10 probability of the last byte of each counted sequence after the others."""
    pieces = max(1, math.ceil(rows / PIECE_ROWS))
    piece = F.pmod(F.xxhash64(F.shiftright("number", 8 * (depth + 1 - SHARED))), F.lit(pieces)).cast("int")
    counts = counts.select(piece.alias("piece"), "number", "n")

    def shared(table: pa.Table) -> pa.Table:
        """The contexts of ``SHARED`` bytes of a piece."""
        table = table.sort_by("number")
        part = Stretch(table["number"].to_numpy(), table["n"].to_numpy(), depth)
        zeros, ones = part.figures[-1]
        return pa.table({"node": part.nodes[-1], "zeros": zeros, "ones": ones, "mixed": part.mixed})

    longest = write_table(counts.groupBy("piece").applyInArrow(shared, "node bigint, zeros double, ones double, mixed double"))
    levels, below = [], longest
    for _ in range(SHARED):
        shorter = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(255))
        sums = below.groupBy(shorter.alias("node")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "mixed")])
        below = cut(rows_weighed(sums.select("node", "zeros", "ones", "mixed")))
        levels.append(below)
        below = below.df
    # From the empty context down: what the shorter contexts say, and the weight that is left.
    state = None
    for level in reversed(levels):
        if state is None:
            state = level.df.select("node", (F.col("own") * F.col("one")).alias("above"), (1 - F.col("own")).alias("left"))
        else:
            state = level.df.join(small(state), up_of("node") == F.col("_up")).select(
                "node", (F.col("_above") + F.col("_left") * F.col("own") * F.col("one")).alias("above"), (F.col("_left") * (1 - F.col("own"))).alias("left")
            )
    top = cut(state)
    parts = F.pmod(F.xxhash64(F.shiftright("node", 8)), F.lit(pieces)).cast("int")
    hints = longest.select("node").join(small(top.small()), up_of("node") == F.col("_up"))
    hints = hints.select(parts.alias("piece"), "node", F.col("_above").alias("above"), F.col("_left").alias("left"))

    def valued(table: pa.Table, given: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"number": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        table = table.sort_by("number")
        part = Stretch(table["number"].to_numpy(), table["n"].to_numpy(), depth)
        given = given.sort_by("node")
        return pa.table({"number": table["number"], "value": part.scores(*(given[c].to_numpy() for c in ("node", "above", "left")))})

    return counts.groupBy("piece").cogroup(hints.groupBy("piece")).applyInArrow(valued, "number bigint, value double")


def up_of(node: str) -> Column:
    """The node of the context without its earliest byte, after the same bits."""
    return F.shiftleft(F.shiftright(node, 16), 8).bitwiseOR(F.col(node).bitwiseAND(255))


def small(level: DataFrame) -> DataFrame:
    return level.select(F.col("node").alias("_up"), F.col("above").alias("_above"), F.col("left").alias("_left"))


class Lookup:
    """Values by number, for many numbers at a time: a hash table in two arrays, probed step by step."""

    def __init__(self, numbers: np.ndarray, values: np.ndarray):
        self.shift = 64 - max(4, (2 * len(numbers)).bit_length())
        self.keys = np.full(1 << (64 - self.shift), -1, np.int64)
        self.values = np.zeros(len(self.keys))
        left, at = np.arange(len(numbers)), self.slots(numbers)
        while len(left):
            free = self.keys[at] == -1
            # Of several numbers for a free slot one stays; the others go on to the next slot.
            self.keys[at[free]] = numbers[left[free]]
            there = self.keys[at] == numbers[left]
            self.values[at[there]] = values[left[there]]
            left, at = left[~there], (at[~there] + 1) % len(self.keys)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def __getitem__(self, numbers: np.ndarray) -> np.ndarray:
        """The values of numbers that are all in the table."""
        at = self.slots(numbers)
        wrong = np.flatnonzero(self.keys[at] != numbers)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(self.keys)
            wrong = wrong[self.keys[at[wrong]] != numbers[wrong]]
        return self.values[at]


def answered(table: pa.Table, answers: pa.Table, depth: int, total: int, distinct: int, ends: int) -> pa.Table:
    """The scores of a batch's documents from the values that it asked for."""
    rows, word = table.num_rows, pc.is_valid(answers["word"])
    # One after the other, so that only one table of values is there at a time.
    asked = answers.select(["number", "value"]).filter(pc.invert(word))
    values, scores = Lookup(asked["number"].to_numpy(), asked["value"].to_numpy()), np.zeros(rows)
    for found, owner in sequences(texts_of(table), depth):
        scores += np.bincount(owner, values[found], rows)
    asked = answers.select(["word", "value"]).filter(word)
    del values
    known = dict(zip(asked["word"].to_pylist(), pc.cast(asked["value"], pa.int64()).to_pylist(), strict=True))
    base, tokens, seen, sizes = [], [], [], []
    for raw in texts_of(table):
        own = np.array([*map(known.__getitem__, raw.lower().split()), ends], np.float64)
        base.append(math.fsum(np.log10((own + SMOOTHING) / (total + SMOOTHING * (distinct + 1)))))
        tokens.append(len(own))
        seen.append(int(np.count_nonzero(own)))
        sizes.append(len(raw) + 1.0)
    return pa.table(
        {
            "doc_id": table["doc_id"],
            "held_out": table["held"],
            "n_tokens": pa.array(tokens, pa.int64()),
            "n_known": pa.array(seen, pa.int64()),
            "train_tokens": pa.array([total] * rows, pa.int64()),
            "base_score": pa.array(base, pa.float64()),
            "score": pa.array(scores),
            "bits_per_byte": pa.array(-scores / math.log10(2) / np.array(sizes)),
        }
    )


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of each row.

    ``score`` is the log10 probability of the whole text, end included, and ``bits_per_byte`` its
    code length for each byte; ``base_score`` is that of the smoothed word counts.  Both learn
    from the rows whose id's CRC is not 0 modulo 10.  Null texts are empty ones: one end.  Rows
    that repeat an id are documents of their own with equal folds; a null id counts as an
    empty one, which is held out.  Without any training text all sequences are equally likely
    and words have probability 1.  An empty table gives an empty result; other columns are ignored.
    """
    batches = batched(docs, id_col, text)
    kind = docs.schema[id_col].dataType.simpleString()
    asked = write_table(batches.groupBy("batch").applyInArrow(lambda table: questions(table, depth), "batch int, number bigint, word binary, n bigint"))
    numbers = cut(asked.filter("number is not null").groupBy("number").agg(F.sum("n").alias("n")))
    words = cut(
        asked.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")), total=F.sum("n"), distinct=F.count_if(F.col("n") > 0)
    )
    ends = docs.filter(~held_out(id_col)).count()
    total, distinct = (words["total"] or 0) + ends, (words["distinct"] or 0) + (ends > 0)
    values = write_table(model(numbers.df, numbers.rows, depth))
    answers = asked.filter("number is not null").select("batch", "number").join(values, "number").select("batch", "number", F.lit(None).cast("binary").alias("word"), "value")
    counted = asked.filter("word is not null").select("batch", "word").join(words.df, "word")
    answers = answers.unionByName(counted.select("batch", F.lit(None).cast("bigint").alias("number"), "word", F.col("n").cast("double").alias("value")))

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"

    def run(table: pa.Table, given: pa.Table) -> pa.Table:
        return answered(table, given, depth, total, distinct, ends)

    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)
