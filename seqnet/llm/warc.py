"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

A record ends with an empty line, so a text writer whose line separator is CR LF CR LF
writes valid uncompressed archives, and a text reader with that separator reads them in
splits from any file system.  A split cannot tell a record from the same magic inside a
payload.  Each task therefore emits for everything that looks like a record its offset and
the offset at which its successor must start, and digests the payload on the way.  Within
a split the successors are followed to where they leave it; pointer jumping from the start
of each file over those exits tells where the true chain enters each split, and only records
on the chain are kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqnet.plans.lineage import cut, shared_folder, write_table

MAGIC = b"WARC/1.1\r\n"
BREAK = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``id, refers_to``: pages whose payload a page of smaller id holds, for payloads of ``least`` bytes or more."""
    payload = F.coalesce("html", F.lit(""))
    marks = pages.filter(F.octet_length(payload) >= least).select(F.col("page_id").alias("id"), F.sha2(payload.cast("binary"), 256).alias("mark"))
    firsts = marks.groupBy("mark").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return marks.join(firsts, "mark").filter("id <> refers_to").select("id", "refers_to").distinct()


def header(page, url: str | None, payload: bytes, refers) -> str:
    """Header lines of a record; control characters of an address are escaped."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_ID}{'' if page is None else page}>"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}"]
    if refers is not None:
        lines += [f"WARC-Refers-To: <{RECORD_ID}{refers}>", f"WARC-Profile: {SAME_PAYLOAD}", f"X-Payload-Length: {len(payload)}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload) if refers is None else 0}"]
    return "\r\n".join(lines)


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """One record per row, ``page_id, url, html``; each task writes an archive.

    Of equal payloads the smallest id is the response and others revisit it; shorter payloads
    than ``least`` bytes are all responses.  Null payloads are empty, null addresses left out,
    null ids are written empty and never refer nor are referred to unless alone.
    """
    # Written first, so that Spark knows its size when it picks the join.
    same = write_table(revisits(pages, least))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    joined = rows.join(same, rows["page_id"] == same["id"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                page, url, html, refers = (c.to_pylist() for c in batch.slice(at, 256).columns)
                made = []
                for p, u, h, r in zip(page, url, html, refers, strict=True):
                    body = h if r is None else ""
                    made.append(f"{header(p, u, h.encode(), r)}{BREAK}{body}")
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["value"])

    joined.mapInArrow(run, "value string").write.option("lineSep", BREAK).text(path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, raw``: what stands between separators, in order within each split."""
    rows = spark.read.option("lineSep", BREAK).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))


def number(raw: bytes) -> int | None:
    """A length in a header field: 1 to 18 ASCII digits, so that places stay below 2^63; nothing else is one."""
    return int(raw) if raw.isdigit() and len(raw) <= 18 else None


def fields_of(raw: bytes) -> dict[bytes, bytes] | None:
    """Header fields by lower-case name; nothing unless every line is one and the length is a ``number``."""
    out = {}
    for line in raw[len(MAGIC) :].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            return None
        out[name.lower()] = value.strip()
    return out if number(out.get(b"content-length", b"")) is not None else None


class Candidate:
    """Something that looks like a record, while its payload passes by."""

    def __init__(self, at: int, body: int, fields: dict[bytes, bytes]):
        self.at, self.body, self.fields = at, body, fields
        self.size = self.left = number(fields[b"content-length"])
        self.digest = hashlib.sha1()

    def feed(self, raw: bytes) -> None:
        self.digest.update(raw if len(raw) <= self.left else memoryview(raw)[: self.left])
        self.left = max(0, self.left - len(raw))

    def row(self, file: str, block: int) -> dict:
        text = {k: v.decode("utf-8", "replace") for k, v in self.fields.items()}
        return {
            "file": file, "block": block, "at": self.at, "body": self.body, "next": self.body + self.size + len(BREAK), "size": self.size,
            "type": text.get(b"warc-type"), "id": text.get(b"warc-record-id"), "refers": text.get(b"warc-refers-to"),
            "url": text.get(b"warc-target-uri"), "declared": text.get(b"warc-payload-digest"), "full_size": number(self.fields.get(b"x-payload-length", b"")),
            "found": base32(self.digest.digest()) if not self.left else None,
        }


CANDIDATE = pa.schema(
    [
        ("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("body", pa.int64()), ("next", pa.int64()), ("size", pa.int64()),
        ("type", pa.string()), ("id", pa.string()), ("refers", pa.string()), ("url", pa.string()), ("declared", pa.string()),
        ("full_size", pa.int64()), ("found", pa.string()), ("block_bytes", pa.int64()), ("exit", pa.int64()),
    ]
)
CANDIDATE_SQL = """file string, block bigint, at bigint, body bigint, next bigint, size bigint, type string, id string, refers string,
url string, declared string, full_size bigint, found string, block_bytes bigint, exit bigint"""


def split_rows(file: str, block: int, made: list[Candidate], total: int) -> pa.RecordBatch:
    """A split's candidates with their exits, and one row that tells the split's bytes.  Places count from the split's start."""
    rows = [c.row(file, block) for c in made]
    exits: dict[int, int] = {}
    for row in reversed(rows):  # a successor always stands behind
        exits[row["at"]] = row["exit"] = exits.get(row["next"], row["next"])
    rows.append({"file": file, "block": block, "block_bytes": total})
    return pa.RecordBatch.from_pylist([{f.name: row.get(f.name) for f in CANDIDATE} for row in rows], CANDIDATE)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records of each split, with payload digests where the payload's bytes are in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, made, open_, at = None, [], [], 0
        for batch in batches:
            for file, block, raw in zip(*(c for c in batch.columns), strict=True):
                here, raw = (file.as_py(), block.as_py()), raw.as_py()
                if here != where:
                    if where:
                        yield split_rows(*where, made, at)
                    where, made, open_, at = here, [], [], 0
                end = at + len(raw) + len(BREAK)
                for c in open_:
                    c.feed(raw)
                    c.feed(BREAK.encode())
                place = raw.find(MAGIC)
                while place >= 0:
                    fields = fields_of(raw[place:])
                    if fields is not None:
                        made.append(Candidate(at + place, end, fields))
                        open_.append(made[-1])
                    place = raw.find(MAGIC, place + 1)
                open_ = [c for c in open_ if c.left]
                at = end
        if where:
            yield split_rows(*where, made, at)

    return chunks(spark, path).mapInArrow(run, CANDIDATE_SQL)


def chain_entries(found: DataFrame) -> DataFrame:
    """``file, at``: the places where the chain from the start of each file enters a split."""
    reached = write_table(found.select("file").distinct().withColumn("at", F.lit(0).cast("long")))
    jumps = write_table(found.select("file", "at", F.col("exit").alias("to")))
    n = 0
    while (now := reached.count()) > n:
        n = now
        further = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = write_table(reached.unionByName(further).distinct())
        ahead = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("_to"))
        jumps = write_table(jumps.join(ahead, ["file", "to"]).select("file", "at", F.col("_to").alias("to")))
    return reached


def walk(rows: pa.Table, entries: pa.Table) -> pa.Table:
    """The candidates of one split that the chain passes."""
    places, following = rows.column("at").to_pylist(), rows.column("next").to_pylist()
    row_at = {a: i for i, a in enumerate(places)}
    kept = []
    for entry in entries.column("at").to_pylist():
        while entry in row_at:
            kept.append(row_at[entry])
            entry = following[row_at[entry]]
    return rows.take(pa.array(sorted(set(kept)), pa.int64()))


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records on the chain: ``file, at, type, id, refers, url, size, full_size, declared, found``.

    ``found`` is the digest of the payload as read.  A damaged archive gives the records up to the
    damage.  An empty folder of archives gives no records.
    """
    made = write_table(candidates(spark, path))
    blocks = made.filter("block_bytes is not null").select("file", "block", "block_bytes")
    # A split's first byte is known once the bytes of the splits before it are: one small row for each split.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("file", "block", F.coalesce(F.sum("block_bytes").over(before), F.lit(0)).alias("base"))
    placed = made.filter("at is not null").join(base, ["file", "block"])
    for name in ("at", "body", "next", "exit"):
        placed = placed.withColumn(name, F.col(name) + F.col("base"))
    found = write_table(placed.drop("base", "block_bytes"))
    entries = write_table(chain_entries(found).join(found.select("file", "at", "block"), ["file", "at"]))
    by = ["file", "block"]
    kept = write_table(found.groupBy(*by).cogroup(entries.groupBy(*by)).applyInArrow(walk, found.schema))
    late = kept.filter("found is null").select("file", "at", "body", "size")
    if late.isEmpty():
        return kept
    digests = write_table(late_digests(spark, path, write_table(late), write_table(base)))
    return kept.join(digests, ["file", "at"], "left").withColumn("found", F.coalesce("found", "late")).drop("late")


def late_digests(spark: SparkSession, path: str, late: DataFrame, base: DataFrame) -> DataFrame:
    """``file, at, late``: digests of the few payloads that run over the end of a split: one at most for each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = None, 0
        for batch in batches:
            places = []
            for file, block, raw in zip(*batch.columns, strict=True):
                here = (file.as_py(), block.as_py())
                where, at = here, 0 if here != where else at
                places.append(at)
                at += len(raw.as_py()) + len(BREAK)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["file", "block", "raw", "place"])

    rows = chunks(spark, path).mapInArrow(run, "file string, block bigint, raw binary, place bigint")
    ends = late.withColumn("end", F.col("body") + F.col("size"))
    spans = base.withColumn("stop", F.coalesce(F.lead("base").over(_by_file()), F.lit(1 << 62)))
    reach = ends.join(spans, "file").filter("base < end and stop > body").select("file", "block", "at", "body", "end", "base")
    # Sent to the readers of the splits while its measured size allows, so that they pass on nothing but these payloads.
    parts = rows.join(cut(reach).small(), ["file", "block"]).withColumn("place", F.col("place") + F.col("base"))
    parts = parts.filter(F.expr(f"place < end and place + octet_length(raw) + {len(BREAK)} > body"))

    def join_up(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        body, end = table.column("body")[0].as_py(), table.column("end")[0].as_py()
        whole = b"".join(raw.as_py() + BREAK.encode() for raw in table.column("raw"))
        first = table.column("place")[0].as_py()
        digest = base32(hashlib.sha1(whole[body - first : end - first]).digest())
        return pa.table({"file": [key[0].as_py()], "at": [key[1].as_py()], "late": [digest]})

    return parts.select("file", "at", "body", "end", "place", "raw").groupBy("file", "at").applyInArrow(join_up, "file string, at bigint, late string")


def _by_file():
    from pyspark.sql.window import Window

    return Window.partitionBy("file").orderBy("base")


def archive_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def digests(found: DataFrame, id_type: str = "bigint") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of page records."""

    def page(name: str):
        text = F.regexp_extract(F.col(name), f"^<{RECORD_ID}(.*)>$", 1)
        return F.when(text != "", text).cast(id_type)

    revisit = F.col("type") == "revisit"
    return found.select(
        page("id").alias("page_id"),
        F.when(revisit, F.col("full_size")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("declared", "^sha1:", "")).otherwise(F.col("found")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, page("refers")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back, and report each record.

    Other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = archive_path(spark)
    write(pages, path, least)
    return digests(records(spark, path), pages.schema["page_id"].dataType.simpleString())


def oracle() -> str:
    """What a round trip of the pages must report; base 32 is spelt out by groups of 40 bits."""
    return """
        WITH marked AS (
            SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first, sha1(coalesce(html, '')) AS mark FROM pages
        ),
        parts AS (SELECT *, [CAST('0x' || mark[10 * i + 1:10 * i + 10] AS BIGINT) FOR i IN range(4)] AS words FROM marked)
        SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
            array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((words[i // 8 + 1] >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) + 1 AS BIGINT), 1) FOR i IN range(32)], '')
                AS payload_digest,
            CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first < page_id THEN first END AS refers_to
        FROM parts
    """
