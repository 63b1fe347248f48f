import base64
import hashlib
import uuid

import pytest

from seqnet.llm import warc
from seqnet.llm.catalog import QUERIES
from seqnet.plans.lineage import shared_folder

TABLES = "/root/testdata/sf0.01"
SCHEMA = "page_id bigint, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        lead = first.get(html or "")
        revisit = i is not None and lead is not None and lead != i
        out.append((i, len((html or "").encode()), digest(html), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=str)


def rows_of(found):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in found.collect()), key=str)


def test_query_equals_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows_of(QUERIES["op10_warc"](spark, TABLES)) == plain(rows)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 40"
TRAPS = [
    f"before\r\n\r\n{FAKE}\r\n\r\ninside a payload\r\n\r\nafter", FAKE, f"{FAKE}\r\n\r\n", f"\r\n\r\n{FAKE}\r\n\r\n{FAKE}\r\n\r\n", "\r\n", "\r\n\r\n", "x\r\n\r\n\r\n\r\n",
    "ends with\r", "ends with\r\n", "ends with\n", "\n\r\n\r\n\r", "WARC/1.1\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\n", "\r\n\r", "Ünïcode 日本 🎉", "a" * 20_000, "",
    f"{FAKE[:-2]}{'9' * 20}\r\n\r\nmore", f"{FAKE[:-2]}{'7' * 5000}", f"{FAKE}\r\nX-Payload-Length: ²\r\n\r\n{'b' * 60}", f"{FAKE[:-2]}²", f"{FAKE[:-2]}{'9' * 18}\r\n\r\n",
    f"{FAKE}\r\nX-Payload-Length: {'8' * 30}",
]


@pytest.mark.parametrize("split", ["128m", "4k", "700"])
def test_magic_inside_payloads_is_rejected(spark, documents, split):
    """Payloads that look like records, whatever the splits cut."""
    documents([])
    rows = [(i, f"http://x/{i} y\r\nz", TRAPS[i % len(TRAPS)] + ("" if i < 60 else f"{i}")) for i in range(100)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    pages = spark.createDataFrame(rows, SCHEMA).repartition(2)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert rows_of(warc.round_trip(pages)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)


def test_archives_are_valid_and_damage_ends_a_chain(spark, documents):
    documents([])
    rows = [(i, "http://x/", f"payload {i}") for i in range(5)]
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    (raw,) = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
    at, seen = 0, []
    while at < len(raw):
        head, _, rest = raw[at:].partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        seen.append(rest[:size].decode())
        assert rest[size : size + 4] == b"\r\n\r\n"
        assert fields[b"WARC-Payload-Digest"] == f"sha1:{digest(seen[-1])}".encode()
        at += len(head) + 4 + size + 4
    assert sorted(seen) == [r[2] for r in rows]
    broken = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    text = raw.decode().replace("Content-Length: 9\r\n\r\npayload 2", "Content-Length: 8\r\n\r\npayload 2")
    spark.createDataFrame([(text.removesuffix(warc.BREAK),)], "value string").coalesce(1).write.option("lineSep", warc.BREAK).text(broken)
    assert warc.digests(warc.records(spark, broken)).count() == 3


@pytest.mark.parametrize("least", [0, 5, 1000])
def test_odd_rows(spark, documents, least):
    documents([])
    rows = [
        (5, None, None), (2, "", ""), (3, "u", "same"), (1, "u", "same"), (1, "v", "same"), (None, "w", "same"), (7, "u", "longer same"), (8, "u", "longer same"),
        (9, "u", "x" * 300_000), (None, None, None),
    ]
    pages = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], f"{SCHEMA}, refers_to string, id int, value string").repartition(3)
    assert rows_of(warc.round_trip(pages, least)) == plain(rows, least)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
