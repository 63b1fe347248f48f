"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

The state of a corpus is three tables in the shared folder, dealt by the hash of the key:

- ``postings``: one row per line key and document, the exact references;
- ``counts``: per key its number of documents and the document that keeps it;
- ``filters``: per shard a cuckoo filter of the keys that enough documents hold.

Inserting or deleting documents appends or removes their postings, counts the touched keys
anew and inserts into or deletes from the filters just the keys that crossed the limit, so
a deletion undoes an insertion.  To clean documents, their keys are tested in the filters;
only keys that pass are looked up in the exact counts.

A key stands for a line with ASCII white space stripped at both ends and A-Z lower-cased;
it is identified by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqnet.llm.common import fresh, raw_text, sliced
from seqnet.plans.lineage import write_table

BLANK = b" \t\n\x0b\x0c\r"
KEY = ["k1", "k2"]
#: Keys per filter shard, and rows that one task tests at a time.
SHARD_KEYS = 50_000
PROBE_ROWS = 100_000
SLOTS = 4
KICKS = 500


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key's 128-bit hash, or nothing for a key of fewer code points."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, k1, k2``: the distinct keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, raw in enumerate(batch.column(1)):
                own = {k for line in raw.as_py().split(b"\n") if (k := line_key(line, min_chars))}
                rows += [i] * len(own)
                keys += own
            pairs = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc_id", *KEY])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc_id"), raw_text(text).alias("raw")).mapInArrow(run, f"doc_id {kind}, k1 bigint, k2 bigint")


class Cuckoo:
    """Cuckoo filter of 16-bit marks: supports insertion and deletion, never misses a member."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def for_keys(cls, n: int) -> Cuckoo:
        size = 1
        while size * SLOTS * 0.9 < max(1, n):
            size *= 2
        return cls(np.zeros((size, SLOTS), np.uint16))

    @classmethod
    def load(cls, raw: bytes) -> Cuckoo:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mark and the two buckets of each key."""
        size = np.uint64(len(self.table) - 1)
        mark = (k2.view(np.uint64) >> np.uint64(48)) | np.uint64(1)
        first = (k1.view(np.uint64) >> np.uint64(20)) & size
        return mark, first, first ^ (self.jump(mark) & size)

    @staticmethod
    def jump(mark):
        return (mark * np.uint64(0x5BD1E995)) >> np.uint64(3)

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, first, second = self.places(k1, k2)
        mark = mark[:, None].astype(np.uint16)
        return (self.table[first] == mark).any(axis=1) | (self.table[second] == mark).any(axis=1)

    def add(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Insert keys; false when the table is too full, which leaves it unfit for use."""
        size = np.uint64(len(self.table) - 1)
        for mark, first, second in zip(*self.places(k1, k2), strict=True):
            bucket = first if (self.table[first] == 0).any() else second
            for kick in range(KICKS):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = mark
                    break
                slot = kick % SLOTS
                mark, self.table[bucket, slot] = np.uint64(self.table[bucket, slot]), mark
                bucket = bucket ^ (self.jump(mark) & size)
            else:
                return False
        return True

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Delete keys that were inserted."""
        for mark, first, second in zip(*self.places(k1, k2), strict=True):
            for bucket in (first, second):
                slot = np.flatnonzero(self.table[bucket] == mark)
                if len(slot):
                    self.table[bucket, slot[0]] = 0
                    break


def filter_of(keys: pd.DataFrame) -> Cuckoo:
    """A filter that holds the keys, as large as it takes."""
    k1, k2 = keys["k1"].to_numpy(np.int64), keys["k2"].to_numpy(np.int64)
    made, room = Cuckoo.for_keys(len(keys)), len(keys)
    while not made.add(k1, k2):
        room = 2 * max(room, len(made.table) * SLOTS // 2)
        made = Cuckoo.for_keys(room)
    return made


def update_shard(key: tuple, old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
    """The shard's filter with the crossing keys inserted (``up``) or deleted.

    ``change`` holds every key of the shard that stays frequent as well, for the case that
    the filter has to grow.
    """
    member = change[change["frequent"]]
    if len(old):
        made = Cuckoo.load(old["filter"].iloc[0])
        gone, new = change[change["was"] & ~change["frequent"]], member[~member["was"]]
        made.remove(gone["k1"].to_numpy(np.int64), gone["k2"].to_numpy(np.int64))
        if not made.add(new["k1"].to_numpy(np.int64), new["k2"].to_numpy(np.int64)):
            made = filter_of(member)
    else:
        made = filter_of(member)
    return pd.DataFrame({"shard": [int(key[0])], "filter": [made.dump()]})


def probe_shard(hits: pa.Table, filters: pa.Table) -> pa.Table:
    own = hits.select(["doc_id", *KEY])
    if not filters.num_rows or not hits.num_rows:
        return own.slice(0, 0)
    made = Cuckoo.load(filters.column("filter")[0].as_py())
    return own.filter(pa.array(made.has(*(own.column(k).to_numpy() for k in KEY))))


@dataclass
class LineIndex:
    """One version of the state; changes give a new version and leave this one usable."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = 20
    min_docs: int = 3

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> LineIndex:
        postings = write_table(line_keys(docs, min_chars).distinct())
        counts = write_table(counted(postings))
        frequent = counts.filter(F.col("n_docs") >= min_docs)
        shards = max(1, ceil(frequent.count() / SHARD_KEYS))
        empty = docs.sparkSession.createDataFrame([], "shard int, filter binary")
        made = cls(postings, counts, empty, shards, min_chars, min_docs)
        return made._refilter(frequent.select(*KEY, F.lit(True).alias("frequent"), F.lit(False).alias("was")))

    def _shard(self):
        return F.pmod(F.xxhash64("k2", "k1"), F.lit(self.shards)).cast("int")

    def _refilter(self, changes: DataFrame) -> LineIndex:
        changes = changes.withColumn("shard", self._shard())
        made = self.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(update_shard, "shard int, filter binary")
        return LineIndex(self.postings, self.counts, write_table(made), self.shards, self.min_chars, self.min_docs)

    def _changed(self, postings: DataFrame, touched: DataFrame) -> LineIndex:
        touched = write_table(touched.select(*KEY).distinct())
        fresh_counts = counted(postings.join(touched, KEY, "left_semi"))
        counts = write_table(self.counts.join(touched, KEY, "left_anti").unionByName(fresh_counts))
        old = self.counts.select(*KEY, (F.col("n_docs") >= self.min_docs).alias("was"))
        new = counts.select(*KEY, (F.col("n_docs") >= self.min_docs).alias("frequent"))
        both = old.join(new, KEY, "full").select(*KEY, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("frequent", "was")])
        version = LineIndex(postings, counts, self.filters, self.shards, self.min_chars, self.min_docs)
        return version._refilter(both.filter("frequent or was"))

    def insert(self, docs: DataFrame) -> LineIndex:
        """With further documents; lines that are there already change nothing."""
        new = line_keys(docs, self.min_chars)
        return self._changed(write_table(self.postings.unionByName(new).distinct()), new)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents whose ids are in the one column of ``ids``."""
        out = ids.toDF("_gone").distinct()
        same = F.col("doc_id").eqNullSafe(F.col("_gone"))
        rest = write_table(self.postings.join(out, same, "left_anti"))
        return self._changed(rest, self.postings.join(out, same, "left_semi"))

    def dropped(self, docs: DataFrame, doc: str = "doc_id", text: str = "text", keys: DataFrame | None = None) -> DataFrame:
        """``doc_id, keys``: the keys (as bytes) whose lines go from each document that has any.

        ``keys`` may give the documents' line keys where they are at hand.  A shard's tests are
        divided into pieces of about ``PROBE_ROWS``, so a line of a third of all documents is
        tested by many tasks, each with a copy of the one filter.
        """
        keys = line_keys(docs, self.min_chars, doc, text) if keys is None else keys
        rows = keys.withColumn("shard", self._shard())
        pieces = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PROBE_ROWS).cast("int").alias("pieces"))
        pieces = write_table(pieces)
        dealt = rows.join(pieces, "shard").withColumn("piece", F.pmod(F.xxhash64("doc_id", "k1"), F.col("pieces")).cast("int"))
        copies = self.filters.join(pieces, "shard").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        by = ["shard", "piece"]
        schema = T.StructType([keys.schema["doc_id"], T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])
        near = dealt.drop("pieces").groupBy(*by).cogroup(copies.select(*by, "filter").groupBy(*by)).applyInArrow(probe_shard, schema)
        exact = self.counts.filter(F.col("n_docs") >= self.min_docs)
        gone = near.join(exact, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        return gone.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("keys"))


def counted(postings: DataFrame) -> DataFrame:
    """``k1, k2, n_docs, keeper`` of distinct postings; the keeper is the largest id, null if there is none other."""
    return postings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def clean(raw: bytes, gone: set[bytes], min_chars: int) -> tuple[bytes, int, int]:
    """The text without the lines of these keys, its number of lines before, and of dropped ones."""
    lines = raw.split(b"\n")
    if not gone:
        return raw, len(lines), 0
    kept = [line for line in lines if line_key(line, min_chars) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def gone_keys(value) -> set[bytes]:
    return {np.array([k["k1"], k["k2"]], np.int64).tobytes() for k in value or ()}


def with_dropped(docs: DataFrame, dropped: DataFrame, doc: str, name: str) -> DataFrame:
    """``docs`` with a column of the keys that go.  The text is shuffled by id; the smaller side is hashed."""
    other = dropped.withColumnsRenamed({"doc_id": f"{name}_id", "keys": name}).hint("shuffle_hash")
    return docs.join(other, docs[doc].eqNullSafe(other[f"{name}_id"]), "left").drop(f"{name}_id")


def line_report(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of each row, the text without repeated lines.

    Lines whose key has at least ``min_chars`` code points and is found in at least
    ``min_docs`` documents go, except in the largest id that holds it.  Null and empty texts
    are one empty line.  Rows that repeat an id are one document; rows with a null id are one
    too, which keeps a line only if no other holds it.  Tables may be empty and may have
    other columns.
    """
    rows = docs.select(F.col(doc).alias("doc_id"), raw_text(text).alias("raw"))
    source = rows.select("doc_id", F.col("raw").cast("string").alias("text"))
    index = LineIndex.build(source, min_chars, min_docs)
    dropped = index.dropped(source, keys=index.postings)
    joined = with_dropped(rows, dropped, "doc_id", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [clean(raw.as_py(), gone_keys(g.as_py()), min_chars) for raw, g in zip(batch.column(1), batch.column(2), strict=True)]
            parts = [pa.array([f[0].decode() for f in found], pa.string()), *(pa.array([f[i] for f in found], pa.int64()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts], names=["doc_id", "text", "n_lines", "n_dropped"])

    kind = docs.schema[doc].dataType.simpleString()
    return joined.select("doc_id", "raw", "gone").mapInArrow(run, f"doc_id {kind}, text string, n_lines bigint, n_dropped bigint")


def digests(report: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of a line report."""
    return report.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with texts cleaned as by ``line_report``, other columns as they came.

    ``n_chars``, where there is one, is counted anew for changed texts; a null text stays null.
    """
    index = LineIndex.build(docs, min_chars, min_docs)
    name = fresh(docs, "_gone")
    joined = with_dropped(docs, index.dropped(docs, keys=index.postings), "doc_id", name)
    at = docs.columns.index("text")
    sized = "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.IntegralType)
    counted_at = docs.columns.index("n_chars") if sized else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = batch.columns[:-1]
            gone = batch.column(batch.num_columns - 1).to_pylist()
            texts = columns[at].to_pylist()
            for i, keys in enumerate(gone):
                if keys and texts[i] is not None:
                    texts[i] = clean(texts[i].encode(), gone_keys(keys), min_chars)[0].decode()
            if counted_at is not None:
                sizes = columns[counted_at].to_pylist()
                sizes = [len(t) if keys and t is not None else n for t, n, keys in zip(texts, sizes, gone, strict=True)]
                columns[counted_at] = pa.array(sizes, columns[counted_at].type)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.select(*docs.columns, name).mapInArrow(run, docs.schema)


def oracle(min_chars: int = 20, min_docs: int = 3) -> str:
    """The digests of ``line_report``, by grouping the keys themselves."""
    blanks = " || ".join(f"chr({b})" for b in BLANK)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
        WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (SELECT row_id, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM texts),
        keyed AS (SELECT *, translate(trim(line, {blanks}), '{letters}', '{letters.lower()}') AS key FROM lines),
        shared AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}
        ),
        marked AS (SELECT keyed.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN shared USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY row_id, doc_id
    """
