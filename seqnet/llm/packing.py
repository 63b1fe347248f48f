"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Piece lengths are whole numbers up to the sequence length, so the instance is a histogram of
at most that many counts, whatever the number of documents.  The reduction fixes small sets
of lengths that provably dominate all others with the same largest length, as many times as
the counts allow; the remainder is packed best-fit, largest first.  The result is a list of
slots: so many sequences, each with a run of pieces of one length at one place.  Spark ranks
the pieces of each length, in salted groups, and the rank picks the slot.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqnet.llm.common import sliced
from seqnet.plans.lineage import write_table

LENGTH = 2048
#: Pieces of a length that are ranked together, about.
RANK_ROWS = 1_000


def place(folder: str | None, file: str) -> str:
    import public_tokenizers

    return f"{folder}/{file}" if folder else public_tokenizers.path(file)


@cache
def tokenizer(folder: str | None, name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(place(folder, f"{name}.json"))


@cache
def added_tokens(folder: str | None, name: str) -> tuple[str, ...]:
    """Texts that are one id each in the tokenizer, whatever stands around them."""
    return tuple(token.content for token in tokenizer(folder, name).get_added_tokens_decoder().values())


@cache
def fast_encoder(folder: str | None, name: str):
    """A faster encoder with the same vocabulary, splits and ids."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(place(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, folder: str | None = None, name: str = "byte_bpe_50k") -> list[int]:
    """Token ids of a whole text as the unmodified tokenizer gives them without special tokens around it.

    A Latin-1 text goes through the faster encoder, which splits it alike; another, whose
    letters may depend on a library's Unicode version, and one that holds an added token, through
    the tokenizer itself.
    """
    try:
        text.encode("latin-1")
        plain = not any(token in text for token in added_tokens(folder, name))
    except UnicodeEncodeError:
        plain = False
    if not plain:
        return tokenizer(folder, name).encode(text, add_special_tokens=False).ids
    return fast_encoder(folder, name).encode_ordinary(text)


def cut_points(total: int, length: int) -> list[int]:
    """Where the pieces of a document of ``total`` ids start: only the first may be short."""
    return [0] if total <= length else [0, *range(total % length or length, total, length)]


def pieces(docs: DataFrame, length: int = LENGTH, folder: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document, its ids followed by id 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, out = [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.array([*token_ids(text.as_py(), folder), 0], "<u4")
                starts = cut_points(len(ids), length)
                for piece, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append(row)
                    out.append((piece, a, z - a, crc32(ids[a:z].tobytes())))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            values = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *values], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


@dataclass
class Bins:
    """So many sequences of the same content: runs of (length, times)."""

    number: int
    runs: tuple[tuple[int, int], ...]
    room: int


def reduce_instance(counts: np.ndarray, capacity: int) -> list[Bins]:
    """Fix dominating sets; takes what it fixes out of ``counts`` (by length).

    For the largest length ``a`` not yet looked at, with ``c`` the room beside it and ``k``
    the largest other length that fits:

    - nothing fits: ``{a}``;
    - ``k`` fills the room, or no two others fit together, or none of the pairs that fit is
      larger than ``k`` while no three fit: ``{a, k}``;
    - at most two others fit, the best partner ``b`` of ``k`` is no smaller than the smaller
      member of any pair that fits: ``{a, k, b}``.

    Any other set with ``a`` can be exchanged for these item by item, so some best packing
    holds them.  Fixing a set leaves fewer items, which can only make more sets dominate, so
    lengths are looked at again until nothing changes.
    """
    out, changed = [], True
    while changed:
        changed = False
        a = capacity
        while a > 0:
            if not counts[a]:
                a -= 1
                continue
            found = dominating(counts, a, capacity)
            if found is None:
                a -= 1
                continue
            need = np.bincount(found, minlength=len(counts))
            times = int(min(counts[x] // need[x] for x in set(found)))
            counts -= times * need
            out.append(Bins(times, tuple((x, int(need[x])) for x in sorted(set(found), reverse=True)), capacity - sum(found)))
            changed = True
    return out


def dominating(counts: np.ndarray, a: int, capacity: int) -> tuple[int, ...] | None:
    """The set that dominates all others with one item of length ``a``, if there is one."""
    room = capacity - a
    own = counts[a]
    counts[a] -= 1
    try:
        fitting = np.flatnonzero(counts[: room + 1])
        if not len(fitting):
            return (a,)
        k = int(fitting[-1])
        if k == room:
            return (a, k)
        smallest = np.repeat(fitting[:3], np.minimum(counts[fitting[:3]], 3))[:3]
        if len(smallest) < 2 or smallest[0] + smallest[1] > room:
            return (a, k)
        if len(smallest) == 3 and smallest.sum() <= room:
            return None
        # The largest partner of each length that may be the smaller of a pair.
        places = np.searchsorted(fitting, room - fitting, side="right") - 1
        partner = np.where(places >= 0, fitting[np.maximum(places, 0)], 0)
        single = (partner == fitting) & (counts[fitting] < 2)
        lower = np.concatenate([[0], fitting[:-1]])
        partner = np.where(single, lower, partner)
        pairs = partner > 0
        sums = (fitting + partner)[pairs]
        if not len(sums) or sums.max() <= k:
            return (a, k)
        lesser = np.minimum(fitting, partner)[pairs].max()
        with_k = partner[-1]
        if with_k > 0 and with_k >= lesser:
            return (a, k, int(with_k))
        return None
    finally:
        counts[a] = own


def best_fit(counts: np.ndarray, capacity: int) -> list[Bins]:
    """Best-fit decreasing on the counts: whole groups of equal sequences at a time."""
    by_room: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def put(group: Bins) -> None:
        if group.number:
            if group.room not in by_room:
                by_room[group.room] = []
                insort(rooms, group.room)
            by_room[group.room].append(group)

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                group = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            else:
                each = capacity // size
                group = Bins(-(-left // each), (), capacity)
            each = group.room // size
            full, rest = divmod(left, each)
            full = min(full, group.number)
            left -= full * each
            put(Bins(full, (*group.runs, (size, each)), group.room - each * size))
            unused = group.number - full
            if unused and left:
                put(Bins(1, (*group.runs, (size, rest)), group.room - rest * size))
                left, unused = 0, unused - 1
            put(Bins(unused, group.runs, group.room))
    return [group for room in rooms for group in by_room[room]]


def pack_counts(counts: dict[int, int], capacity: int = LENGTH) -> list[Bins]:
    """Sequences for so many pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    fixed = reduce_instance(left, capacity)
    return fixed + best_fit(left, capacity)


def slots(bins: list[Bins]) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, times in a sequence, first sequence, offset), by rank.

    Their number depends on the sequence length, not on the number of documents.
    """
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for group in bins:
        offset = 0
        for size, times in group.runs:
            rank = taken.get(size, 0)
            out.setdefault(size, []).append((rank, times, sequence, offset))
            taken[size] = rank + group.number * times
            offset += size * times
        sequence += group.number
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``, from 0, among the pieces of the same length.

    A length that very many pieces have is ranked in salted groups whose sizes are then
    added up; rows that tie in every column are alike, so any order among them will do.
    """
    sizes = rows.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / RANK_ROWS).cast("int").alias("salts"))
    # At most one row per length up to the sequence length.
    salted = rows.join(F.broadcast(sizes), "length")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    skips = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    numbered = salted.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(skips, ["length", "salt"]).withColumn("rank", F.col("place") + F.col("skip")).drop("salt", "place", "skip")


def pack(docs: DataFrame, length: int = LENGTH, folder: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece.

    Null and empty texts are the single id 0.  Null ids, repeated rows and ties are packed
    row by row like any other; other columns are ignored, an empty table gives no pieces.
    """
    rows = write_table(pieces(docs, length, folder))
    # The driver gets one count per length.
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = slots(pack_counts(counts, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                slot = places[size][np.searchsorted(places[size][:, 0], ranks[own], side="right") - 1]
                beyond = ranks[own] - slot[:, 0]
                sequence[own] = slot[:, 2] + beyond // slot[:, 1]
                offset[own] = slot[:, 3] + beyond % slot[:, 1] * size
            columns = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    order = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked(rows).select(*order, "rank").mapInArrow(run, schema)
