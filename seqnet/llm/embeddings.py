"""Near-duplicate vectors by an inverted multi-index.

The unit vectors are cut in two halves with a codebook each; the cells of the product grid
hold the vectors whose halves are nearest to the cell's two centroids.  A query orders each
half's centroids by how far it would have to move to be in their region (the distance to
the plane between that centroid and its own), and visits the cells of the grid in order of
the two distances' sum of squares, until the sum passes the radius at which the target
recall is reached.  Vectors at the similarity limit can be no farther apart than their
distance, so that radius is bounded and gives complete recall at its bound.  Pairs from visited
cells are verified in double precision.

Cells are dealt in blocks, so a cell that holds a third of all vectors is the work of many
tasks.  A block reports how many links each vector has and a spanning forest of its links,
never all pairs, so its output is no larger than its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqnet.operators.graph import component_labels
from seqnet.plans.lineage import write_table

#: Vectors, by least id hash, that codebooks and radius are fitted on, at least, and for each centroid; every vector is indexed.
SAMPLE, SAMPLE_EACH = 8192, 8
#: Vectors of a cell on average, centroids of a half at most, rows of a block at most.
PER_CELL, MOST_CENTROIDS, BLOCK = 32, 4096, 2048
TARGET_RECALL = 0.999


def unit_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable vectors of ``dims`` finite components and not zero, and those as unit vectors."""
    good = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False).copy()
    flat = pc.list_flatten(column.filter(pa.array(good))).to_numpy(zero_copy_only=False)
    rows = flat.astype(np.float64).reshape(-1, max(dims, 1))
    scale = np.abs(rows).max(axis=1, initial=0.0)
    fine = np.isfinite(scale) & (scale > 0)
    rows = rows[fine] / scale[fine, None]
    good[np.flatnonzero(good)[~fine]] = False
    return good, rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def unpack(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def prepared(vectors: DataFrame, dims: int) -> DataFrame:
    """``vec_id, label, unit, mark``: the vectors that can link, scaled to length one, as bytes of doubles, and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, rows = unit_rows(batch.column(2), dims)
            kept = batch.filter(pa.array(good))
            units = pa.array([row.tobytes() for row in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), units], names=["vec_id", "label", "unit"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    rows = vectors.filter("vec_id is not null and label is not null and embedding is not null").select("vec_id", "label", "embedding")
    found = rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, unit binary")
    return found.withColumn("mark", F.unhex(F.sha2("unit", 256)))


def codebook(rows: np.ndarray, size: int, rounds: int = 10) -> np.ndarray:
    """Centroids of half vectors by Lloyd's method from evenly spread rows."""
    size = min(size, len(rows)) if rows.shape[1] else 1
    centers = rows[np.linspace(0, len(rows) - 1, size).astype(int)].copy()
    for _ in range(rounds if rows.shape[1] else 0):
        own = squared(rows, centers).argmin(axis=1)
        counts = np.bincount(own, minlength=size)
        sums = np.stack([np.bincount(own, rows[:, d], size) for d in range(rows.shape[1])], axis=1)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0)


class MultiIndex:
    """Two codebooks and the radius: at most a few hundred short vectors."""

    def __init__(self, sample: np.ndarray, per_half: int, limit: float, target: float, seed: int = 11):
        self.half = sample.shape[1] // 2
        self.books = [codebook(part, per_half) for part in self.halves(sample)]
        self.apart = [np.sqrt(squared(book, book)) for book in self.books]
        self.radius = self.reach(sample, limit, target, np.random.default_rng(seed))

    def halves(self, rows: np.ndarray) -> list[np.ndarray]:
        return [rows[:, : self.half], rows[:, self.half :]]

    def cells(self, rows: np.ndarray) -> np.ndarray:
        own = [squared(part, book).argmin(axis=1) for part, book in zip(self.halves(rows), self.books, strict=True)]
        return own[0] * len(self.books[1]) + own[1]

    def moves(self, rows: np.ndarray) -> list[np.ndarray]:
        """Per half the squared distance of each row to each centroid's region, from below."""
        out = []
        for part, book, apart in zip(self.halves(rows), self.books, self.apart, strict=True):
            far = squared(part, book)
            own = far.argmin(axis=1)
            wide = np.maximum(2 * apart[own], 1e-12)
            out.append(np.maximum((far - far[np.arange(len(far)), own][:, None]) / wide, 0.0) ** 2)
        return out

    def needed(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How large the radius has to be for each row to visit each cell."""
        first, second = self.moves(rows)
        at, width = np.arange(len(rows)), len(self.books[1])
        return first[at, cells // width] + second[at, cells % width]

    def reach(self, sample: np.ndarray, limit: float, target: float, rng: np.random.Generator) -> float:
        """The radius that finds the target share of pairs at the limit.

        Each sampled vector is paired with one at exactly the limit in a random direction, the
        hardest pairs that count.
        """
        bound = 2 * (1 - limit) + 1e-9
        if target >= 1:
            return bound
        turn = rng.normal(size=sample.shape)
        turn -= (turn * sample).sum(axis=1)[:, None] * sample
        turn /= np.sqrt((turn * turn).sum(axis=1))[:, None]
        other = limit * sample + np.sqrt(1 - limit * limit) * turn
        return float(min(bound, np.quantile(self.needed(sample, self.cells(other)), target) + 1e-12))

    def visits(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and cell of every visit.

        Both halves are sorted; for each centroid of the first, the second is followed until the
        sum passes the radius, which is the frontier where the multi-sequence traversal stops.
        """
        first, second = self.moves(rows)
        order = [np.argsort(m, axis=1, kind="stable") for m in (first, second)]
        near = [np.take_along_axis(m, o, axis=1) for m, o in zip((first, second), order, strict=True)]
        out_rows, out_cells = [], []
        for step in range(first.shape[1]):
            active = np.flatnonzero(near[0][:, step] <= self.radius)
            if not len(active):
                break
            hit, place = np.nonzero(near[1][active] <= self.radius - near[0][active, step][:, None])
            row = active[hit]
            out_rows.append(row)
            out_cells.append(order[0][row, step] * len(self.books[1]) + order[1][row, place])
        return np.concatenate(out_rows), np.concatenate(out_cells)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that connect whatever the matrix's links connect, each but once."""
    group = np.arange(near.shape[0], near.shape[0] + near.shape[1])
    out = []
    for row in np.flatnonzero(near.any(axis=1)):
        columns = np.flatnonzero(near[row])
        kinds, where = np.unique(group[columns], return_index=True)
        out += [(int(row), int(columns[w])) for w in where]
        group[columns] = kinds[0]
        if len(kinds) > 1:
            group[np.isin(group, kinds[1:])] = kinds[0]
    return out


def search(rows: DataFrame, index: MultiIndex, dims: int, limit: float) -> DataFrame:
    """``vec_id, other, n``: link counts (``other`` null) to be added up, and links that connect (``n`` zero).

    ``rows`` has ``vec_id, label, unit, weight``: different vectors, and how many ids share each.
    """
    label = rows.schema["label"]
    key = rows.schema["vec_id"]
    names = ["vec_id", "label", "unit", "weight"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(unpack(batch.column(2), dims))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64())], names=[*names, "cell"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows, cells = index.visits(unpack(part.column(2), dims))
                chosen = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(cells, pa.int64())], names=[*names, "cell"])

    longs = [T.StructField(name, T.LongType()) for name in ("weight", "cell")]
    schema = T.StructType([key, label, T.StructField("unit", T.BinaryType()), *longs])
    rows = rows.select(*names)
    base = rows.mapInArrow(place, schema)
    probes = write_table(rows.mapInArrow(probe, schema))
    cell = ["label", "cell"]
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    sizes = base.groupBy(*cell).agg(blocks.alias("bases")).join(probes.groupBy(*cell).agg(blocks.alias("queries")), cell)
    sizes = write_table(sizes)

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own block, once for every block of the other side."""
        chosen = F.pmod(F.xxhash64("vec_id", F.lit(own)), F.col(own)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        out = rows.join(sizes, cell).withColumn("_own", chosen).withColumn("_other", copies)
        return out.select(*cell, F.col("_own").alias(own), F.col("_other").alias(other), "vec_id", "unit", "weight")

    def verify(bases: pa.Table, queries: pa.Table) -> pa.Table:
        out = pa.schema([("vec_id", bases.schema.field("vec_id").type), ("other", bases.schema.field("vec_id").type), ("n", pa.int64())])
        if not bases.num_rows or not queries.num_rows:
            return out.empty_table()
        ids, weights = ([t.column(c).to_numpy() for t in (queries, bases)] for c in ("vec_id", "weight"))
        left, right = (unpack(t.column("unit"), dims) for t in (queries, bases))
        near = (left @ right.T >= limit) & (ids[0][:, None] != ids[1][None, :])
        if not near.any():
            return out.empty_table()
        rows, columns = np.nonzero(near)
        # A query counts what it finds; the other end counts it too unless it visits this query's cell itself.
        cells, own = np.unique(index.cells(left), return_inverse=True)
        visits, which = np.unique(columns * len(cells) + own[rows], return_inverse=True)
        unseen = np.zeros(len(visits), bool)
        for at in range(0, len(visits), 65_536):
            base, cell = np.divmod(visits[at : at + 65_536], len(cells))
            unseen[at : at + 65_536] = index.needed(right[base], cells[cell]) > index.radius
        blind = unseen[which]
        counts = [
            np.bincount(rows, weights[1][columns], len(left)).astype(np.int64),
            np.bincount(columns[blind], weights[0][rows[blind]], len(right)).astype(np.int64),
        ]
        pairs = forest(near)
        who = np.concatenate([ids[0][counts[0] > 0], ids[1][counts[1] > 0], ids[0][[p[0] for p in pairs]]])
        number = np.concatenate([counts[0][counts[0] > 0], counts[1][counts[1] > 0], np.zeros(len(pairs), np.int64)])
        other = np.concatenate([np.zeros(len(who) - len(pairs), ids[1].dtype), ids[1][[p[1] for p in pairs]]])
        missing = np.arange(len(who)) < len(who) - len(pairs)
        return pa.table([pa.array(who), pa.array(other, mask=missing), pa.array(number, pa.int64())], schema=out)

    by = [*cell, "bases", "queries"]
    kind = key.dataType.simpleString()
    bases, queries = dealt(base, "bases", "queries"), dealt(probes, "queries", "bases").select(*by, "vec_id", "unit", "weight")
    return bases.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(verify, f"vec_id {kind}, other {kind}, n bigint")


def linked(vectors: DataFrame, dims: int, limit: float, target: float) -> DataFrame | None:
    """``vec_id, head, n`` of the usable vectors of one length, and the links ``head, other`` that connect heads.

    Equal vectors of a label are one row of the index, under their smallest id.  Nothing without usable vectors.
    """
    rows = write_table(prepared(vectors.filter(F.size("embedding") == dims), dims))
    members = rows.select("vec_id", "label", "mark").distinct()
    heads = members.groupBy("label", "mark").agg(F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("weight"))
    heads = write_table(heads.withColumn("number", F.monotonically_increasing_id()))
    facts = heads.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    if not facts["n"]:
        return None
    first = rows.dropDuplicates(["vec_id", "label", "mark"]).withColumnRenamed("vec_id", "head")
    single = first.join(heads, ["head", "label", "mark"]).select(F.col("number").alias("vec_id"), "label", "unit", "weight")
    single = write_table(single)
    per_half = int(np.clip(round((facts["n"] / (max(1, facts["labels"]) * PER_CELL)) ** 0.5), 2, MOST_CENTROIDS))
    index = MultiIndex(unpack_sample(single, dims, max(SAMPLE, SAMPLE_EACH * per_half)), per_half, limit, target)
    found = write_table(search(single, index, dims, limit))
    # The ids that share a vector link with each other, and with whatever their vector links with.
    counts = found.groupBy(F.col("vec_id").alias("number")).agg(F.sum("n").alias("n"))
    own = members.join(heads, ["label", "mark"]).join(counts, "number", "left")
    own = own.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.col("head").alias("other"))
    names = heads.select("number", "head")
    links = found.filter("other is not null").join(names.toDF("vec_id", "_from"), "vec_id").join(names.toDF("other", "_to"), "other")
    return own.unionByName(links.select(F.col("_from").alias("vec_id"), F.lit(0).cast("long").alias("n"), F.col("_to").alias("other")))


def near_duplicates(vectors: DataFrame, limit: float = 0.98, target: float = TARGET_RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row.

    Vectors link when their labels and lengths are equal and their cosine is at least ``limit``;
    every length has an index of its own.  Null labels, ids and vectors, zero vectors, and vectors
    with null or non-finite components link with nothing.  Rows that repeat an id with an equal
    vector and label are one vector; with another they are vectors of their own, whose links are
    added up.  Equal vectors link like any others.  An empty table gives an empty result; other
    columns are ignored.
    """
    # One row per vector length comes to the driver.
    lengths = vectors.filter("embedding is not null").groupBy(F.size("embedding").alias("dims")).count().orderBy("dims").collect()
    found = [part for row in lengths if row["dims"] and (part := linked(vectors, row["dims"], limit, target)) is not None]
    ids = vectors.select("vec_id")
    if not found:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = write_table(reduce(DataFrame.unionByName, found))
    counts = rows.groupBy("vec_id").agg(F.sum("n").alias("n"))
    edges = rows.select(F.lit(0).alias("graph_id"), F.col("vec_id").alias("src"), F.col("other").alias("dst"))
    labels = component_labels(edges).select(F.col("node").alias("vec_id"), "component")
    joined = ids.join(counts, "vec_id", "left").join(labels, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def unpack_sample(rows: DataFrame, dims: int, most: int) -> np.ndarray:
    """The ``most`` vectors of least id hash, on the driver."""
    found = rows.select("vec_id", "unit").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()
    return np.frombuffer(b"".join(r["unit"] for r in found), np.float64).reshape(-1, max(dims, 1))
