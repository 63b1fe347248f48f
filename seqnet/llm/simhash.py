"""Near duplicates by SimHash and the generalised pigeonhole principle.

A document's fingerprint has 64 bits; a bit is set where over half of the hashes of its
word shingles have it set.  Documents link when at most ``max_distance`` bits differ.

The bits are divided into partitions that keep correlated bits together.  If the
thresholds ``t_i`` of a query add up to ``max_distance - m + 1`` (a threshold of -1 leaves
a partition out), every fingerprint within ``max_distance`` of the query is within
``t_i`` of it on some partition.  Each query allocates its thresholds by dynamic
programming on estimated candidate counts, so a value that very many fingerprints share is
avoided by those that hold it, then probes the values in reach and verifies candidates.

Equal fingerprints are one class from the start, so exact copies cost one row.  Where a
similarity is asked for, a class is an equal fingerprint and an equal shingle set, and
every link is verified; texts too far apart for the fingerprints are found by the rarest
shingles of their sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqnet.llm.common import raw_text, sliced, small_batches, without
from seqnet.operators.graph import component_labels
from seqnet.plans.lineage import Stage, cut, remove, write_table

BITS = 64
#: Shingles hashed at a time within one document.
BLOCK = 65_536
#: Bits of the sub-blocks whose value counts estimate candidates.
SUB_BITS = 8
#: Relative cost of one probe row and of one verified candidate.
PROBE_COST, VERIFY_COST = 1.0, 0.01
#: Fingerprints on which partition numbers are compared; affects cost only, not results.
PLAN_SAMPLE = 2000
#: Most partitions that are considered.
MOST_PARTS = 8
#: Distance within which near copies are connected before similarity alone decides; affects cost only, not results.
NEAR_STEP = 4
#: Rounds in which the sets of a key are compared with one of them, as long as each leaves at most this share of the rows; cost only.
STAR_ROUNDS, WORTHWHILE = 2, 0.9
#: Buckets of shingle counts, a fixed 16 MB, and the parts in which they are added up; they order shingles, so they affect cost only.
SKETCH_BITS, SKETCH_PARTS = 22, 16
#: Bytes of shingle sets that are compared together, at most about.
BLOCK_BYTES = 8 << 20
POPCOUNT = np.array([bin(i).count("1") for i in range(1 << SUB_BITS)], dtype=np.uint8)


def bits_of(values: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers, lowest first, as a matrix of 0 and 1."""
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def shingle_hashes(raw: bytes, width: int) -> Iterator[np.ndarray]:
    """Hashes of all word shingles of a UTF-8 text, some at a time; none without words.

    Lower-cases A-Z only; words end at blanks, tabs, line ends and form feeds.
    """
    words = raw.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(width, len(words))
    firsts, lasts = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    hash64 = xxhash.xxh64_intdigest
    for at in range(0, len(firsts), BLOCK):
        spans = zip(firsts[at : at + BLOCK], lasts[at : at + BLOCK], strict=True)
        yield np.array([hash64(joined[a:z], 42) for a, z in spans], dtype=np.uint64)


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that over half of ``n`` hashes have set, as a signed 64-bit integer."""
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(raw: bytes, width: int) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit integer; zero without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(raw, width):
        ones, n = ones + bits_of(hashes).sum(axis=0, dtype=np.int64), n + len(hashes)
    return majority(ones, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit integer) of each row; null and empty texts have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(raw.as_py(), width) for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), raw_text(text).alias("raw")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def correlated_groups(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits divided into ``parts`` groups of nearly equal size, correlated bits together."""
    left, out = list(range(BITS)), []
    for part in range(parts):
        room = len(left) // (parts - part)
        group = [max(left, key=lambda b: correlation[b, left].sum())]
        while len(group) < room:
            rest = [b for b in left if b not in group]
            group.append(max(rest, key=lambda b: correlation[b, group].sum()))
        left = [b for b in left if b not in group]
        out.append(sorted(group))
    return out


def values_on(bits: np.ndarray, group: list[int]) -> np.ndarray:
    """The integer that each row's bits of ``group`` form, first bit lowest."""
    return bits[:, group].astype(np.int64) @ (np.int64(1) << np.arange(len(group), dtype=np.int64))


def sub_blocks(group: list[int]) -> list[list[int]]:
    return [group[i : i + SUB_BITS] for i in range(0, len(group), SUB_BITS)]


def bit_correlation(classes: DataFrame) -> np.ndarray:
    """Absolute correlation of each two bits over all fingerprints: one small sum per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((BITS, BITS))
        n = 0
        for frame in frames:
            bits = bits_of(frame["fp"].to_numpy(np.int64)).astype(np.float64)
            both, n = both + bits.T @ bits, n + len(bits)
        if n:
            cells = np.append(both.ravel(), n)
            yield pd.DataFrame({"cell": np.arange(len(cells)), "total": cells})

    sums = classes.select("fp").mapInPandas(run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    found = np.zeros(BITS * BITS + 1)
    for row in sums.collect():
        found[row["cell"]] = row["total"]
    n = max(found[-1], 1.0)
    both = found[:-1].reshape(BITS, BITS) / n
    means = np.diag(both)
    spread = np.sqrt(np.maximum(means * (1 - means), 1e-12))
    correlation = np.abs(both - np.outer(means, means)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0.0)
    return correlation


class Plan:
    """Partitions of the bits with value counts of their sub-blocks: at most a few thousand numbers."""

    def __init__(self, groups: list[list[int]], max_distance: int):
        self.groups, self.max_distance = groups, max_distance
        self.blocks = [sub_blocks(g) for g in groups]
        self.near: list[list[np.ndarray]] = []
        self.rows = 0.0

    def learn(self, counts: dict[tuple[int, int], np.ndarray], rows: float) -> None:
        """counts: by (group, block) the rows per value.  Keeps rows per value and distance."""
        self.rows = rows
        for g, blocks in enumerate(self.blocks):
            tables = []
            for b, block in enumerate(blocks):
                size = 1 << len(block)
                apart = POPCOUNT[np.arange(size)[:, None] ^ np.arange(size)[None, :]]
                share = counts[g, b][:size] / max(rows, 1.0)
                tables.append(np.stack([(apart == d) @ share for d in range(self.max_distance + 1)], axis=1))
            self.near.append(tables)

    def units(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query and partition the threshold plus one, and the query's estimated cost.

        The units of a query add up to ``max_distance + 1``.
        """
        most, n = self.max_distance + 1, len(bits)
        best = np.full((n, most + 1), np.inf)
        best[:, 0] = 0.0
        choice = []
        for group, blocks, tables in zip(self.groups, self.blocks, self.near, strict=True):
            chance = np.zeros((n, most))
            chance[:, 0] = 1.0
            for block, table in zip(blocks, tables, strict=True):
                own = table[values_on(bits, block)]
                chance = np.stack([(chance[:, : d + 1] * own[:, d::-1]).sum(axis=1) for d in range(most)], axis=1)
            reach = np.cumsum([comb(len(group), d) for d in range(most)]) * PROBE_COST
            price = np.concatenate([np.zeros((n, 1)), reach + np.cumsum(chance, axis=1) * self.rows * VERIFY_COST], axis=1)
            sums = np.full((n, most + 1, most + 1), np.inf)
            for spent in range(most + 1):
                for unit in range(spent + 1):
                    sums[:, spent, unit] = best[:, spent - unit] + price[:, unit]
            choice.append(sums.argmin(axis=2))
            best = sums.min(axis=2)
        out, left = np.zeros((n, len(self.groups)), np.int64), np.full(n, most)
        for g in reversed(range(len(self.groups))):
            out[:, g] = choice[g][np.arange(n), left]
            left = left - out[:, g]
        return out, best[:, most]

    def masks(self, group: int, distance: int) -> np.ndarray:
        """All changes of at most ``distance`` bits of a partition."""
        width = len(self.groups[group])
        return np.array([sum(1 << b for b in picked) for d in range(distance + 1) for picked in combinations(range(width), d)], np.int64)


def make_plan(classes: DataFrame, max_distance: int) -> Plan:
    """Group correlated bits for each number of partitions, and take the number that costs least.

    Correlations and value counts cover all fingerprints; the driver gets at most some
    thousand sums.  Only the comparison of plans uses ``PLAN_SAMPLE`` fingerprints.
    """
    correlation = bit_correlation(classes)
    plans = [Plan(correlated_groups(correlation, parts), max_distance) for parts in range(min(2, max_distance + 1), min(MOST_PARTS, max_distance + 1) + 1)]
    places = [(p, g, b, block) for p, plan in enumerate(plans) for g, blocks in enumerate(plan.blocks) for b, block in enumerate(blocks)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(places), 1 << SUB_BITS), np.int64)
        for frame in frames:
            bits = bits_of(frame["fp"].to_numpy(np.int64))
            for i, (*_, block) in enumerate(places):
                sums[i] += np.bincount(values_on(bits, block), minlength=1 << SUB_BITS)
        at, value = np.nonzero(sums)
        yield pd.DataFrame({"place": at, "value": value, "n": sums[at, value]})

    counts = np.zeros((len(places), 1 << SUB_BITS))
    found = classes.select("fp").mapInPandas(run, "place int, value int, n bigint").groupBy("place", "value").agg(F.sum("n").alias("n"))
    for row in found.collect():
        counts[row["place"], row["value"]] = row["n"]
    rows = float(counts[0].sum())
    sample = classes.select("fp").orderBy(F.xxhash64("fp")).limit(PLAN_SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    bits = bits_of(sample)
    for p, plan in enumerate(plans):
        plan.learn({(g, b): counts[i] for i, (q, g, b, _) in enumerate(places) if q == p}, rows)
    return min(plans, key=lambda plan: plan.units(bits)[1].sum())


def index_rows(classes: DataFrame, plan: Plan) -> DataFrame:
    """``key, fp``: each fingerprint's value on each partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            marks = frame["fp"].to_numpy(np.int64)
            bits = bits_of(marks)
            for g, group in enumerate(plan.groups):
                yield pd.DataFrame({"key": (np.int64(g) << BITS // 2 + 1) + values_on(bits, group), "fp": marks})

    return classes.select("fp").mapInPandas(run, "key bigint, fp bigint")


def probe_rows(classes: DataFrame, plan: Plan) -> DataFrame:
    """``key, query``: the partition values within each query's own thresholds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            marks = frame["fp"].to_numpy(np.int64)
            bits = bits_of(marks)
            units, _ = plan.units(bits)
            for g, group in enumerate(plan.groups):
                values = (np.int64(g) << BITS // 2 + 1) + values_on(bits, group)
                for unit in range(1, plan.max_distance + 2):
                    chosen = np.flatnonzero(units[:, g] == unit)
                    masks = plan.masks(g, unit - 1) if len(chosen) else []
                    step = max(1, 200_000 // max(1, len(masks)))
                    for at in range(0, len(chosen), step):
                        own = chosen[at : at + step]
                        keys = (values[own][:, None] ^ masks[None, :]).ravel()
                        yield pd.DataFrame({"key": keys, "query": np.repeat(marks[own], len(masks))})

    return classes.select("fp").mapInPandas(run, "key bigint, query bigint")


def links(classes: DataFrame, max_distance: int = 4) -> DataFrame:
    """``src, dst``: each two different fingerprints (``src > dst``) that differ in few bits.

    A pair may come more than once.  Every fingerprint queries all others, so both ends find
    a link and only the larger one reports it.
    """
    plan = make_plan(classes, max_distance)
    probes, index = probe_rows(classes, plan), index_rows(classes, plan)
    close = (F.col("fp") < F.col("query")) & (F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= max_distance)
    return probes.join(index, (probes["key"] == index["key"]) & close).select(F.col("query").alias("src"), F.col("fp").alias("dst"))


def mark_and_set(raw: bytes, width: int) -> tuple[int, np.ndarray]:
    """Fingerprint of a UTF-8 text, and its different shingle hashes, sorted."""
    ones, n, parts = np.zeros(BITS, np.int64), 0, [np.zeros(0, np.uint64)]
    for hashes in shingle_hashes(raw, width):
        ones, n = ones + bits_of(hashes).sum(axis=0, dtype=np.int64), n + len(hashes)
        parts.append(np.unique(hashes))
    return majority(ones, n), np.unique(np.concatenate(parts))


def node_of(mark: int, shingles: np.ndarray) -> int:
    """A signed 64-bit number for a fingerprint and a shingle set: texts that share it are one class."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), mark & ((1 << BITS) - 1))).view(np.int64))


def least_common(size: int, similarity: float) -> int:
    """Shingles that a set of this size has at least in common with any other of this similarity."""
    return ceil(similarity * size - 1e-9)


def shingle_sets(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """``row, doc_id, fp, node, size, shingles`` of each row: the sorted different shingle hashes, 64 bits each, and their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            marks, nodes, sizes, sets = [], [], [], []
            for raw in batch.column(1):
                mark, own = mark_and_set(raw.as_py(), width)
                marks.append(mark)
                nodes.append(node_of(mark, own))
                sizes.append(len(own))
                sets.append(own.tobytes())
            cells = [pa.array(marks, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells], names=["doc_id", "fp", "node", "size", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, fp bigint, node bigint, size bigint, shingles binary"
    found = docs.select(F.col(id_col).alias("doc_id"), raw_text(text).alias("raw")).mapInArrow(run, schema)
    return found.withColumn("row", F.monotonically_increasing_id())


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many rows hold a shingle of each bucket: ``1 << SKETCH_BITS`` numbers, whatever the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for raw in batch.column(0):
                own, n = np.unique(np.frombuffer(raw.as_py(), np.uint64) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                total[own.astype(np.int64)] += n.astype(np.uint32)
        for part, piece in enumerate(np.split(total, SKETCH_PARTS)):
            if piece.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "packed": pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint32)
        for packed in table["packed"]:
            total += np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
        return pa.table({"part": table["part"][:1], "packed": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "part int, packed binary"
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint32)
    with small_batches(sets.sparkSession):
        parts = sets.select("shingles").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect()
    for row in parts:
        out[row["part"]] = np.frombuffer(zlib.decompress(row["packed"]), np.uint32)
    return out.ravel()


def with_prefix(sets: DataFrame, similarity: float) -> DataFrame:
    """``doc_id, row, fp, node, size, prefix``: the rarest shingles of each set, so many that two sets of the similarity share one of them.

    All sets are ordered alike: by the count of a shingle's bucket, then by its hash.
    """
    counts = sets.sparkSession.sparkContext.broadcast(frequencies(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            prefixes = []
            for raw in batch.column(5):
                own = np.frombuffer(raw.as_py(), np.uint64)
                # Sorted by hash already, so a stable sort by count is the common order.
                order = np.argsort(counts.value[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                prefixes.append(own[order[: len(own) - least_common(len(own), similarity) + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(prefixes, pa.binary())], names=["doc_id", "row", "fp", "node", "size", "prefix"])

    kind = sets.schema["doc_id"].dataType.simpleString()
    rows = sets.select("doc_id", "row", "fp", "node", "size", "shingles")
    return rows.mapInArrow(run, f"doc_id {kind}, row bigint, fp bigint, node bigint, size bigint, prefix binary")


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs of classes (``src, dst``) whose shingle sets have at least this Jaccard similarity, compared exactly.

    Pairs are dealt into blocks, and a block gets each set that its pairs need once.
    """
    sizes = classes.select(F.col("node").alias("_node"), "size")
    pairs = pairs.join(sizes.withColumnsRenamed({"_node": "src", "size": "_a"}), "src").join(sizes.withColumnsRenamed({"_node": "dst", "size": "_b"}), "dst")
    weighed = cut(pairs.select("src", "dst", "_a", "_b"), bytes=F.sum(8 * (F.col("_a") + F.col("_b"))))
    blocks = max(1, ceil((weighed["bytes"] or 0) / BLOCK_BYTES))
    # Pairs of one destination mostly meet in a block: stars have their center there.
    block = F.pmod(F.xxhash64("dst", F.pmod(F.xxhash64("src"), F.lit(1 + blocks // 16))), F.lit(blocks)).cast("int")
    dealt = weighed.df.select(block.alias("block"), "src", "dst")
    sides = [dealt.select("block", F.col(side).alias("node")).distinct() for side in ("src", "dst")]
    ends = sides[0].unionByName(sides[1]).distinct()
    wanted = cut(ends.join(classes.select("node", "row"), "node").select("block", "row"))
    needed = sets.select("row", "node", "shingles").join(wanted.small(), "row").select("block", "node", "shingles")

    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        rows = dict(zip(given["node"].to_pylist(), range(given.num_rows), strict=True))
        shingles, good = given["shingles"].combine_chunks() if given.num_rows else None, []
        for a, b in zip(asked["src"].to_pylist(), asked["dst"].to_pylist(), strict=True):
            left, right = (np.frombuffer(shingles[rows[node]].as_buffer(), np.uint64) for node in (a, b))
            # Both are sorted: an overlap is found by place.
            if len(left) > len(right):
                left, right = right, left
            at = np.minimum(np.searchsorted(right, left), len(right) - 1)
            common = int(np.count_nonzero(right[at] == left))
            good.append(common >= similarity * (len(left) + len(right) - common))
        return asked.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    with small_batches(sets.sparkSession):
        out = write_table(dealt.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(run, "src bigint, dst bigint"))
    for stage in (weighed, wanted):
        remove(sets.sparkSession, stage.path)
    return out


def labelled(found: DataFrame) -> Stage:
    """``node, component`` of all classes that some link connects."""
    return cut(component_labels(found.select(F.lit(0).alias("graph_id"), "src", "dst")).select("node", "component"))


def prefix_keys(classes: DataFrame, groups: Stage) -> DataFrame:
    """``key, prev, node, size, rest, component``: each prefix shingle of a class, the one before it, and how many shingles are left from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            numbers = np.stack([batch.column(i).to_numpy() for i in range(3)])
            keys = [np.frombuffer(prefix.as_py(), np.int64) for prefix in batch.column(3)]
            counts = np.fromiter(map(len, keys), np.int64, len(keys))
            node, size, component = np.repeat(numbers, counts, axis=1)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            key = np.concatenate(keys)
            numbers = [pa.array(size.astype(np.int32)), pa.array((size - place).astype(np.int32)), pa.array(component)]
            cells = [pa.array(key), pa.array(np.roll(key, 1), mask=place == 0), pa.array(node), *numbers]
            yield pa.RecordBatch.from_arrays(cells, names=["key", "prev", "node", "size", "rest", "component"])

    # Empty sets have no keys: all of them are one class.
    rows = classes.filter("size > 0").join(groups.small().withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    rows = rows.select("node", "size", F.coalesce("component", "node").alias("component"), "prefix")
    return rows.mapInArrow(run, "key bigint, prev bigint, node bigint, size int, rest int, component bigint")


def contested(keys: DataFrame) -> Stage:
    """The rows of those keys that classes of several components hold."""
    shared = keys.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    shared = cut(shared.filter("_low < _high").select("key"))
    out = cut(keys.join(shared.small(), "key"))
    remove(keys.sparkSession, shared.path)
    return out


def fitting(a: str, b: str, similarity: float):
    """Whether the rows may be of sets of this similarity that share no earlier key, from different components."""
    rest = F.least(F.col(f"{a}.rest"), F.col(f"{b}.rest"))
    enough = rest * (1 + similarity) >= similarity * (F.col(f"{a}.size") + F.col(f"{b}.size")) - 1e-6
    return (F.col(f"{a}.component") != F.col(f"{b}.component")) & enough


def similar_links(classes: DataFrame, sets: DataFrame, similarity: float, max_distance: int | None) -> DataFrame:
    """Verified links that connect whatever all verified links connect.

    Near copies are connected first, each compared with one other only: those that SimHash finds
    within ``NEAR_STEP`` bits with the least fingerprint in reach, those of one prefix key with one
    set there, a few rounds with another one each.  Then every pair of different components that shares a prefix key is
    compared, whatever its fingerprints, so no pair of the similarity can be missed.
    """
    spark = sets.sparkSession
    heads = cut(classes.groupBy("fp").agg(F.min("node").alias("node")))
    left, right = (heads.df.withColumnsRenamed({"fp": f"_{side}", "node": side}) for side in ("src", "dst"))
    radius = NEAR_STEP if max_distance is None else min(NEAR_STEP, max_distance)
    near = links(heads.df, radius).groupBy("src").agg(F.min("dst").alias("dst")).withColumnsRenamed({"src": "_src", "dst": "_dst"})
    near = near.join(left, "_src").join(right, "_dst").select("src", "dst")
    equal = classes.select("fp", "node").join(heads.df.withColumnRenamed("node", "_head"), "fp").filter("node <> _head")
    found = [verified(near.unionByName(equal.select(F.col("node").alias("src"), F.col("_head").alias("dst"))), classes, sets, similarity)]
    groups = labelled(found[0])
    close = F.lit(True)
    if max_distance is not None:
        marks = classes.select("node", "fp")
        close = F.bit_count(F.col("_fa").bitwiseXOR(F.col("_fb"))) <= max_distance

    def compared(candidates: DataFrame) -> DataFrame:
        pairs = candidates.distinct()
        if max_distance is not None:
            pairs = pairs.join(marks.withColumnsRenamed({"node": "src", "fp": "_fa"}), "src").join(marks.withColumnsRenamed({"node": "dst", "fp": "_fb"}), "dst")
            pairs = pairs.filter(close).select("src", "dst")
        return verified(pairs, classes, sets, similarity)

    keys = contested(prefix_keys(classes, groups))
    for turn in range(STAR_ROUNDS):
        if not keys.rows:
            break
        # Another center for every key and round, so that groups that share several keys are soon connected.
        pick = F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("order"), "node", "size", "rest", "component")
        center = keys.df.groupBy("key").agg(F.min(pick).alias("b"))
        stars = keys.df.select("key", F.struct("node", "size", "rest", "component").alias("a")).join(center, "key")
        found.append(compared(stars.filter(fitting("a", "b", similarity)).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))))
        groups = labelled(reduce(DataFrame.unionByName, found))
        rows = keys.df.drop("component").join(groups.small().withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        left_over = contested(rows.select("key", "prev", "node", "size", "rest", F.coalesce("component", "node").alias("component")))
        remove(spark, keys.path)
        before, keys = keys.rows, left_over
        if keys.rows > WORTHWHILE * before:
            break
    a, b = (keys.df.alias(side) for side in "ab")
    # Two sets that share the shingle before too met there already, where both had more left.
    met = F.coalesce(F.col("a.prev") == F.col("b.prev"), F.lit(False))
    both = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") > F.col("b.node")) & ~met & fitting("a", "b", similarity)
    found.append(compared(a.join(b, both).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))))
    remove(spark, heads.path)
    remove(spark, keys.path)
    return write_table(reduce(DataFrame.unionByName, found))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, max_distance: int | None = 4, similarity: float | None = None
) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept`` of each row.

    ``component_id`` is the least id reachable over links, the row's own included; ``kept``
    marks the one document of each group that stays.  With ``similarity``, two texts link only
    when their shingle sets have at least this Jaccard similarity too, equal fingerprints or not;
    ``max_distance`` None then leaves the decision to the similarity alone.
    Null and empty texts have fingerprint zero and link like any other.  Rows that repeat an id are one document.  A null id is
    never a component's id unless no other id is in it; such rows count as kept.  An empty
    table gives an empty result; other columns are ignored.
    """
    if similarity is None:
        by = "fp"
        marks = write_table(fingerprints(docs, id_col, text, width))
        classes = write_table(marks.groupBy("fp").agg(F.min("doc_id").alias("first")))
        found = write_table(links(classes, max_distance))
    else:
        by = "node"
        with small_batches(docs.sparkSession):
            sets = cut(shingle_sets(docs, id_col, text, width))
        one = [F.min(c).alias(c) for c in ("row", "fp", "size", "prefix")]
        with small_batches(docs.sparkSession):
            classes = write_table(with_prefix(sets.df, similarity).groupBy("node").agg(F.min("doc_id").alias("first"), *one))
        found = similar_links(classes, sets.df, similarity, max_distance)
        marks = write_table(sets.df.select("doc_id", "fp", "node"))
        remove(docs.sparkSession, sets.path)
        classes = classes.select("node", "first")
    labels = component_labels(found.select(F.lit(0).alias("graph_id"), "src", "dst"))
    linked = write_table(labels.select(F.col("node").alias(by), "component").join(classes, by))
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    lead = linked.join(least, "component").select(by, "least")
    heads = classes.join(lead, by, "left").select(F.col(by).alias("_by"), F.coalesce("least", "first").alias("component_id"))
    return marks.join(heads, F.col(by) == F.col("_by")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; columns as they came."""
    dropped = near_duplicates(docs, **options).filter(~F.col("kept")).select("doc_id").distinct()
    return without(docs, write_table(dropped), options.get("id_col", "doc_id"))
