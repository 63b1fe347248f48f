import hashlib
import random
from zlib import crc32

import pytest

from seqnet.llm import mpeg
from seqnet.llm.catalog import QUERIES

TABLES = "/root/testdata/sf0.001"


def plain_payload(raw):
    raw += b" " * (-len(raw) % 192)
    return raw or b" " * 192


def test_query_equals_texts(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    found = QUERIES["op8_mpeg_audio"](spark, TABLES).collect()
    assert len(found) == len(texts)
    for r in found:
        payload, stream = plain_payload(texts[r["doc_id"]]), mpeg.encode(texts[r["doc_id"]])
        assert r["n_bytes"] == len(texts[r["doc_id"]]) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == crc32(payload[-16:])
        assert r["media_bytes"] == len(stream) and r["media_sha256"] == hashlib.sha256(stream).hexdigest()
        assert "crc=0/" in r["feature"] and "skipped=0;table=ok" in r["feature"]


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 384, 1151, 1152, 1344, 1345, 100_000])
def test_round_trip(size):
    raw = random.Random(size).randbytes(size)
    stream = mpeg.encode(raw)
    found = mpeg.parse(stream)
    assert mpeg.payload_of(stream, found) == plain_payload(raw)
    assert (found.failed, found.skipped, found.table, found.checked) == (0, 0, "ok", len(found.offsets))
    assert found.samples == 1152 * len(found.offsets) and found.micros == found.samples * 1_000_000 // 32000
    for at, length in zip(found.offsets, found.lengths, strict=True):
        assert mpeg.header_of(stream[at : at + 4]).length == length
    # Each table entry is the place, in 256ths of the stream, of the frame at so many hundredths of the time.
    begin = found.offsets[0] - mpeg.header_of(mpeg.frame_header(32, False)).length
    total = len(stream) - mpeg.TAG_END - begin
    n = len(found.offsets)
    assert list(found.toc) == [min(255, (found.offsets[i * n // 100] - begin) * 256 // total) for i in range(100)]


def test_known_header_lengths():
    """Frame lengths the standard gives."""
    assert mpeg.header_of(bytes.fromhex("fffb9064")).length == 417  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz
    assert mpeg.header_of(bytes.fromhex("fffb9264")).length == 418
    assert mpeg.header_of(bytes.fromhex("fffd8404")).length == 384  # layer II, 128 kbit/s, 48 kHz
    assert mpeg.header_of(bytes.fromhex("fff38464")).length == 192  # MPEG-2 layer III, 64 kbit/s, 24 kHz
    for bad in ("fffbf064", "fffb0064", "fffb9c64", "ffe99064", "fff99064", "00fb9064"):
        assert mpeg.header_of(bytes.fromhex(bad)) is None


def test_damage_is_seen():
    stream = mpeg.encode(random.Random(5).randbytes(30_000))
    whole = mpeg.parse(stream)
    hole = mpeg.parse(stream[: whole.offsets[3] + 100] + stream[whole.offsets[5] - 7 :])
    assert hole.skipped > 0 and hole.table == "wrong" and len(whole.offsets) - 3 <= len(hole.offsets) < len(whole.offsets)
    flipped = bytearray(stream)
    flipped[whole.offsets[2] + 8] ^= 1  # in the side information, which the checksum covers
    assert mpeg.parse(bytes(flipped)).failed == 1
    junk = mpeg.parse(b"\xff\xfb\x90\x64" + random.Random(1).randbytes(300) + stream[whole.offsets[0] - 144 :])
    assert len(junk.offsets) == len(whole.offsets) and junk.skipped == 304
    assert mpeg.parse(b"").offsets == [] and mpeg.parse(b"\xff").skipped == 1


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(spark, documents, odd_rows, clashing):
    found = mpeg.digests(mpeg.stored_features(documents(odd_rows, clashing))).collect()
    assert len(found) == len(odd_rows)
    want = sorted((i or 0, len((t or "").encode()), hashlib.sha256(plain_payload((t or "").encode())).hexdigest()) for i, t in odd_rows)
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["payload_sha256"]) for r in found) == want
    assert mpeg.stored_features(documents([])).count() == 0
    assert mpeg.features(spark.createDataFrame([(1, None)], "doc_id bigint, media binary")).first()["frames"] == 0


def frames(head, n, body=b""):
    length = mpeg.header_of(head).length
    return (head + body).ljust(length, b"\0") * n


def test_any_bytes_may_be_given(spark):
    """Random, truncated and spliced bytes, short frames with a table's tag, and odd numbers in tags."""
    rng = random.Random(9)
    whole = mpeg.encode(rng.randbytes(3000))
    short = bytes.fromhex("fff314c4")  # MPEG-2 layer III, 8 kbit/s, 24 kHz: 24 bytes
    assert mpeg.header_of(short).length == 24
    streams = [whole[:n] for n in range(0, len(whole), 97)] + [whole[n:] for n in range(0, len(whole), 131)]
    streams += [frames(short, 1, bytes(9) + tag + bytes(k))[: 24 - cut] for tag in (b"Xing", b"Info", b"VBRI") for k in range(9) for cut in range(9)]
    streams += [b"ID3" + bytes([v, 0, f]) + rng.randbytes(rng.randrange(60)) for v in range(6) for f in (0, 0x10, 0x40, 0x80, 0xF0) for _ in range(6)]
    streams += [rng.randbytes(rng.randrange(400)) for _ in range(200)]
    streams += [b"".join(rng.choice([b"\xff\xfb\x90\x64", b"\xff\xfa", b"Xing", b"TAG", b"ID3\x04", rng.randbytes(40)]) for _ in range(30)) for _ in range(100)]
    note = mpeg.text_frame(b"TXXX", b"payload\0" + "²".encode("latin-1"))
    streams += [b"ID3\x03\0\0" + mpeg.syncsafe(len(note)) + note, b"ID3\x03\0\0" + mpeg.syncsafe(40) + mpeg.text_frame(b"TXXX", b"payload\0" + b"9" * 30)]
    for data in streams:
        found = mpeg.parse(data)
        assert found.skipped <= len(data) and all(0 <= at < len(data) for at in found.offsets)
    table = spark.createDataFrame(list(enumerate(streams)), "doc_id bigint, media binary")
    assert mpeg.digests(mpeg.features(table)).count() == len(streams)


def plain_crc(bits):
    """Remainder of the bits, behind sixteen ones, by x^16 + x^15 + x^2 + 1, one division step at a time."""
    register = [1] * 16
    for bit in bits:
        feedback = register[0] ^ bit
        register = register[1:] + [0]
        if feedback:
            for place in (0, 13, 15):
                register[place] ^= 1
    return int("".join(map(str, register)), 2)


def as_bits(raw):
    return [byte >> (7 - k) & 1 for byte in raw for k in range(8)]


@pytest.mark.parametrize(
    ("head", "layer", "runs", "bound", "channels"),
    [
        ("fffe9000", 1, [(32, 4)], 32, 2),  # layer I, stereo
        ("fffe90c0", 1, [(32, 4)], 32, 1),  # mono
        ("fffe9050", 1, [(32, 4)], 8, 2),  # joint stereo from subband 8 on
        ("fffc8000", 2, [(11, 4), (12, 3), (4, 2)], 32, 2),  # layer II, 64 kbit/s a channel, 44.1 kHz
        ("fffca000", 2, [(11, 4), (12, 3), (7, 2)], 32, 2),  # 96 kbit/s a channel
        ("fffc18c0", 2, [(2, 4), (10, 3)], 32, 1),  # 32 kbit/s mono, 32 kHz
        ("fffc8040", 2, [(11, 4), (12, 3), (4, 2)], 4, 2),  # joint stereo from subband 4 on
        ("fff48400", 2, [(4, 4), (7, 3), (19, 2)], 32, 2),  # MPEG-2
    ],
)
def test_checksums_of_layers_one_and_two(head, layer, runs, bound, channels):
    """Frames written bit by bit from the standard's tables."""
    rng = random.Random(head)
    raw = bytes.fromhex(head)
    assert mpeg.header_of(raw).layer == layer and mpeg.header_of(raw).protected
    made = b""
    for _ in range(6):
        covered, selections, subband = [], [], 0
        for number, width in runs:
            for _ in range(number):
                for _ in range(channels if subband < bound else 1):
                    value = rng.choice([0, rng.randrange(1 << width)])
                    covered += [value >> (width - 1 - k) & 1 for k in range(width)]
                    shared = channels if subband >= bound else 1
                    selections += [rng.randrange(2) for _ in range(2 * shared)] if value else []
                subband += 1
        covered += selections if layer == 2 else []
        check = plain_crc(as_bits(raw[2:]) + covered)
        padded = covered + [rng.randrange(2) for _ in range(-len(covered) % 8)]
        body = bytes(int("".join(map(str, padded[k : k + 8])), 2) for k in range(0, len(padded), 8))
        made += frames(raw, 1, check.to_bytes(2, "big") + body)
    found = mpeg.parse(made)
    assert (len(found.offsets), found.checked, found.failed, found.skipped) == (6, 6, 0, 0)
    flipped = bytearray(made)
    flipped[found.offsets[3] + 6] ^= 0x80
    assert mpeg.parse(bytes(flipped)).failed >= 1


def test_vbri_table_gives_places():
    head = bytes.fromhex("fffb9000")  # 417 bytes, stereo
    lengths = [417] * 40
    entries = [sum(lengths[k : k + 10]) for k in range(0, 40, 10)]
    total = 417 * 41
    table = b"VBRI" + bytes([0, 1, 0, 0, 0, 75]) + total.to_bytes(4, "big") + (40).to_bytes(4, "big")
    table += b"".join(n.to_bytes(2, "big") for n in (len(entries), 1, 2, 10)) + b"".join(e.to_bytes(2, "big") for e in entries)
    stream = frames(head, 1, bytes(32) + table) + frames(head, 40)
    found = mpeg.parse(stream)
    assert (found.table, len(found.offsets), found.micros) == ("ok", 40, 40 * 1152 * 1_000_000 // 44100)
    assert found.seek == [found.offsets[k] for k in range(0, 40, 10)]
    assert mpeg.parse(stream[: -417 * 2]).table == "wrong"


def test_tags_of_all_versions():
    audio = frames(bytes.fromhex("fffb9000"), 4)

    def tag(version, flags, body, footer=b""):
        return b"ID3" + bytes([version, 0, flags]) + mpeg.syncsafe(len(body)) + body + footer + audio

    title = "Ärger 日本"
    long = "x" * 300
    four = b"TIT2" + mpeg.syncsafe(1 + len(title.encode())) + b"\0\0\x03" + title.encode() + b"TALB" + mpeg.syncsafe(301) + b"\0\0\0" + long.encode() + bytes(20)
    three = b"TIT2" + (1 + len(title.encode("utf-16"))).to_bytes(4, "big") + b"\0\0\x01" + title.encode("utf-16") + b"APIC" + (3).to_bytes(4, "big") + b"\0\0abc"
    three += b"TALB" + (301).to_bytes(4, "big") + b"\0\0\0" + long.encode()
    two = b"TT2" + (6).to_bytes(3, "big") + b"\0title" + b"TXX" + (6).to_bytes(3, "big") + b"\0k\0vvv"
    for stream, want in (
        (tag(4, 0, four), {"TIT2": title, "TALB": long}),
        (tag(4, 0x10, four, b"3DI\x04\0\x10" + mpeg.syncsafe(len(four))), {"TIT2": title, "TALB": long}),
        (tag(4, 0x40, mpeg.syncsafe(6) + b"\1\0" + four), {"TIT2": title, "TALB": long}),
        (tag(3, 0, three), {"TIT2": title, "TALB": long}),
        (tag(3, 0x40, (6).to_bytes(4, "big") + bytes(6) + three), {"TIT2": title, "TALB": long}),
        (tag(3, 0x80, three.replace(b"\xff", b"\xff\0")), {"TIT2": title, "TALB": long}),
        (tag(2, 0, two), {"TT2": "title", "TXXX:k": "vvv"}),
    ):
        found = mpeg.parse(stream)
        assert (found.tags, len(found.offsets), found.skipped) == (want, 4, 0)


def test_known_checksum():
    """The standard's polynomial, against division bit by bit."""
    for n in (0, 1, 19, 36):
        data = random.Random(n).randbytes(n)
        assert mpeg.crc16(data) == plain_crc(as_bits(data))
