"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums and seek offsets.

``parse`` reads any MPEG-1, 2 or 2.5 stream of layers I to III: it reads ID3 tags of versions
2.2 to 2.4 and 1, looks for a frame header that a second one follows, resynchronises after
damage, verifies the CRC-16 of protected frames and the frame and byte counts of a Xing or
VBRI table, and gives exact durations (samples over rate) and the byte offset of every frame.

``encode`` stores bytes losslessly in a layer III stream of silent frames: side information
is all zero, so nothing of a frame belongs to the sound and the payload rides as ancillary
data.  Frames take the bitrate that fits their share of the payload, which makes the stream
one of variable bitrate, with a Xing table in front and tags at both ends.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqnet.llm.common import raw_text
from seqnet.plans.lineage import write_table

# Fixed values of the standard: kbit/s by index, Hz by index, samples of a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

UNIT = 192
RATE = 32000
HEAD, CHECK, SIDE = 4, 2, 17
#: kbit/s of the frame that carries so many units of payload.
CARRIER = {1: 48, 2: 96, 3: 160, 4: 192, 5: 224, 7: 320}
TAG_END = 128
#: Where a VBRI table stands in its frame, and its bytes before the entries (fixed values).
VBRI_AT, VBRI_BYTES = 36, 26
# Fixed values of the standard: bits of a layer II subband's allocation, as (subbands, bits) runs.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lower": ((4, 4), (7, 3), (19, 2)),
}
#: Names of text encodings in ID3 frames, by their number (fixed values).
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    length: int
    samples: int
    bound: int

    def like(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)

    @property
    def side(self) -> int:
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)

    @property
    def allocation(self) -> list[int]:
        """Layer II: bits of each subband's allocation."""
        each = self.kbits // (1 if self.mono else 2)
        if self.version != 1:
            kind = "lower"
        elif each <= 48:
            kind = "d" if self.rate == 32000 else "c"
        else:
            kind = "a" if each <= 80 or self.rate == 48000 else "b"
        return [bits for subbands, bits in ALLOCATION[kind] for _ in range(subbands)]

    def checked_bits(self, body: bytes) -> int | None:
        """How many bits behind the checksum it covers; nothing where the frame is too short for them."""
        channels = 1 if self.mono else 2
        if self.layer == 3:
            return 8 * self.side if len(body) >= self.side else None
        if self.layer == 1:
            bits = 4 * (channels * self.bound + 32 - self.bound)
            return bits if 8 * len(body) >= bits else None
        # Layer II: allocations, and two bits of selection for each that is not zero.
        value, at, chosen = int.from_bytes(body[:64], "big"), 0, 0
        have = 8 * len(body[:64])
        for subband, bits in enumerate(self.allocation):
            for _ in range(channels if subband < self.bound else 1):
                at += bits
                if at > have:
                    return None
                if value >> (have - at) & ((1 << bits) - 1):
                    chosen += 2 if subband < self.bound else 2 * channels
        return at + chosen if at + chosen <= have else None


@lru_cache(4096)
def header_of(raw: bytes) -> Header | None:
    """The frame header that four bytes are, if they are one.  Free-format frames are not read."""
    if len(raw) < HEAD or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(raw[1] >> 3 & 3)
    layer = 4 - (raw[1] >> 1 & 3)
    index, rate_index = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate_index == 3 or raw[3] & 3 == 2:
        return None
    family = 1 if version == 1 else 2
    kbits, rate, pad = BITRATES[family, layer][index], RATES[version][rate_index], raw[2] >> 1 & 1
    samples = SAMPLES[family, layer]
    length = (12000 * kbits // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // rate + pad
    # Joint stereo shares the allocation of the upper subbands.
    bound = 4 + 4 * (raw[3] >> 4 & 3) if raw[3] >> 6 == 1 else 32
    return Header(version, layer, not raw[1] & 1, kbits, rate, raw[3] >> 6 == 3, length, samples, bound)


def crc16_bits(data: bytes, bits: int) -> int:
    """CRC-16 of polynomial 0x8005, from 0xFFFF, highest bit first, of the first ``bits`` bits."""
    value = 0xFFFF
    for at in range(bits):
        top = value >> 15 ^ (data[at >> 3] >> (7 - (at & 7)) & 1)
        value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return value


@lru_cache(4096)
def crc16(data: bytes) -> int:
    return crc16_bits(data, 8 * len(data))


def syncsafe(n: int) -> bytes:
    return bytes(n >> shift & 0x7F for shift in (21, 14, 7, 0))


def from_syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def frame_header(kbits: int, protected: bool) -> bytes:
    """Header of an MPEG-1 layer III mono frame at 32 kHz."""
    return bytes([0xFF, 0xFA if protected else 0xFB, BITRATES[1, 3].index(kbits) << 4 | 2 << 2, 0xC0])


@lru_cache(16)
def frame_start(kbits: int) -> tuple[bytes, int]:
    """Header, checksum and empty side information, and the frame's length."""
    head = frame_header(kbits, True)
    side = bytes(SIDE)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side, header_of(head).length


def units_of(length: int) -> int:
    return (length - HEAD - CHECK - SIDE) // UNIT


def padded(raw: bytes) -> bytes:
    """The payload: filled with blanks up to a positive multiple of the unit."""
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


def text_frame(name: bytes, value: bytes) -> bytes:
    return name + struct.pack(">IH", len(value) + 1, 0) + b"\0" + value


def encode(raw: bytes) -> bytes:
    """A stream that holds the bytes: tag, Xing table, frames, closing tag.  Equal bytes, equal stream."""
    payload, frames, at = padded(raw), [], 0
    most = max(CARRIER)
    while at < len(payload):
        left = (len(payload) - at) // UNIT
        units = most if left >= most else max(u for u in CARRIER if u <= left)
        start, length = frame_start(CARRIER[units])
        frames.append((start + payload[at : at + units * UNIT]).ljust(length, b"\0"))
        at += units * UNIT
    samples = SAMPLES[1, 3] * len(frames)
    notes = text_frame(b"TLEN", str(samples * 1000 // RATE).encode()) + text_frame(b"TXXX", b"payload\0" + str(len(raw)).encode())
    head = frame_header(32, False)
    front = header_of(head).length
    offsets, total = [], front
    for frame in frames:
        offsets.append(total)
        total += len(frame)
    toc = bytes(min(255, offsets[i * len(frames) // 100] * 256 // total) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    closing = b"TAG" + b"payload".ljust(TAG_END - 4, b"\0") + b"\xff"
    return b"".join([b"ID3\x03\0\0", syncsafe(len(notes)), notes, (head + bytes(SIDE) + xing).ljust(front, b"\0"), *frames, closing])


@dataclass
class Stream:
    """What a stream holds.  Offsets are of whole frames, the table's own frame left out.

    ``seek`` has the places that a variable-bitrate table names, from the stream's first frame on.
    """

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    kbits: set[int] = field(default_factory=set)
    samples: int = 0
    rate: int = 0
    checked: int = 0
    failed: int = 0
    skipped: int = 0
    table: str = "none"
    toc: bytes = b""
    seek: list[int] = field(default_factory=list)

    @property
    def micros(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0


def decoded(value: bytes) -> str:
    """The text of an ID3 frame by the encoding its first byte names."""
    if not value:
        return ""
    name = ENCODINGS[value[0]] if value[0] < len(ENCODINGS) else "latin-1"
    return value[1:].decode(name, "replace")


def tag_frames(body: bytes, version: int) -> Iterator[tuple[str, bytes]]:
    """Name and content of the frames of an ID3 tag, up to its padding or damage."""
    name_bytes, head = (3, 6) if version == 2 else (4, 10)
    at = 0
    while at + head <= len(body) and body[at]:
        raw = body[at + name_bytes : at + (6 if version == 2 else 8)]
        size = from_syncsafe(raw) if version == 4 and max(raw) < 0x80 else int.from_bytes(raw, "big")
        yield body[at : at + name_bytes].decode("latin-1"), body[at + head : at + head + size]
        at += head + size


def read_tags(data: bytes, out: Stream) -> tuple[int, int]:
    """Where the frames lie between the tags."""
    start, end = 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10:
        version, flags = data[3], data[5]
        stop = 10 + from_syncsafe(data[6:10])
        start = min(end, stop + (10 if version == 4 and flags & 0x10 else 0))
        body = data[10 : min(end, stop)]
        if flags & 0x80 and version < 4:
            body = body.replace(b"\xff\0", b"\xff")
        if flags & 0x40 and version in (3, 4) and len(body) >= 4:
            # The size of an extended header counts itself from version 4 on.
            body = body[from_syncsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big") :]
        for name, content in tag_frames(body, version) if version in (2, 3, 4) else ():
            if name[0] != "T":
                continue
            value = decoded(content)
            if name in ("TXXX", "TXX"):
                key, _, rest = value.partition("\0")
                out.tags[f"TXXX:{key}"] = rest.lstrip("\ufeff").rstrip("\0")
            else:
                out.tags[name] = value.rstrip("\0")
    if end - start >= TAG_END and data[end - TAG_END : end - TAG_END + 3] == b"TAG":
        end -= TAG_END
        out.tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    return start, end


def read_table(frame: bytes, head: Header, out: Stream) -> tuple[int, int] | bool:
    """The frames and bytes that a variable-bitrate table in this frame tells; True where it tells none, False without a table."""
    at = HEAD + CHECK * head.protected + head.side
    if head.layer == 3 and frame[at : at + 4] in (b"Xing", b"Info"):
        flags = int.from_bytes(frame[at + 4 : at + 8], "big") if len(frame) >= at + 8 else 0
        at += 8
        told = []
        for bit in (1, 2):
            if flags & bit:
                told.append(int.from_bytes(frame[at : at + 4], "big") if len(frame) >= at + 4 else -1)
                at += 4
        if flags & 4 and len(frame) >= at + 100:
            out.toc = frame[at : at + 100]
            if len(told) == 2:
                out.seek = [mark * told[1] // 256 for mark in out.toc]
        return tuple(told) if len(told) == 2 else True
    if head.layer == 3 and frame[VBRI_AT : VBRI_AT + 4] == b"VBRI":
        if len(frame) < VBRI_AT + VBRI_BYTES:
            return True
        total, frames, entries, scale, size, _ = struct.unpack(">IIHHHH", frame[VBRI_AT + 10 : VBRI_AT + VBRI_BYTES])
        at = VBRI_AT + VBRI_BYTES
        if 1 <= size <= 4 and len(frame) >= at + entries * size:
            place = len(frame)
            for k in range(entries):
                out.seek.append(place)
                place += scale * int.from_bytes(frame[at + k * size : at + (k + 1) * size], "big")
        return frames, total
    return False


def parse(data: bytes) -> Stream:
    """Walk a whole stream; bytes that belong to no frame are counted as skipped.  Any bytes may be given."""
    out = Stream()
    at, end = read_tags(data, out)
    begin, last, told = at, None, False
    while at + HEAD <= end:
        head = header_of(data[at : at + HEAD])
        after = at + head.length if head else 0
        trusted = head is not None and after <= end and (last is None or head.like(last))
        if trusted and after < end and (last is None or out.skipped):
            follower = header_of(data[after : after + HEAD])
            trusted = follower is not None and follower.like(head)
        if not trusted:
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out.skipped += step - at
            at = step
            continue
        found = read_table(data[at:after], head, out) if last is None else False
        if found:
            told, out.table = found, "unchecked"
        else:
            if head.protected:
                body = data[at + HEAD + CHECK : after]
                bits = head.checked_bits(body)
                out.checked += 1
                if bits is None:
                    out.failed += 1
                else:
                    covered = data[at + 2 : at + HEAD] + body[: (bits + 7) // 8]
                    value = crc16(covered) if bits % 8 == 0 else crc16_bits(covered, 16 + bits)
                    out.failed += int.from_bytes(data[at + HEAD : at + HEAD + CHECK], "big") != value
            out.offsets.append(at)
            out.lengths.append(head.length)
            out.kbits.add(head.kbits)
            out.samples += head.samples
            out.rate = head.rate
        last, at = head, after
    out.skipped += max(0, end - at)
    if isinstance(told, tuple):
        out.table = "ok" if told == (len(out.offsets), end - begin) else "wrong"
    return out


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The bytes that ``encode`` stored, with their filling."""
    skip = HEAD + CHECK + SIDE
    return b"".join(data[a + skip : a + skip + units_of(n) * UNIT] for a, n in zip(stream.offsets, stream.lengths, strict=True))


def media(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, media``: each text as an audio stream.  Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = pa.array([encode(raw.as_py()) for raw in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=["doc_id", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", raw_text(text).alias("raw")).mapInArrow(run, f"doc_id {kind}, media binary")


FACTS = pa.struct(
    [
        ("frames", pa.int64()), ("samples", pa.int64()), ("rate", pa.int64()), ("micros", pa.int64()), ("kbits", pa.list_(pa.int64())),
        ("crc_checked", pa.int64()), ("crc_failed", pa.int64()), ("skipped", pa.int64()), ("table", pa.string()), ("seek", pa.list_(pa.int64())),
        ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ]
)
SCHEMA = """frames bigint, samples bigint, rate bigint, micros bigint, kbits array<bigint>, crc_checked bigint, crc_failed bigint,
skipped bigint, table string, seek array<bigint>, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint,
media_bytes bigint, media_sha256 string"""


def features(stored: DataFrame) -> DataFrame:
    """Facts of the streams in ``media``: exact duration (samples over rate), seek offset of every
    frame, checksums, state of the variable-bitrate table, and what the payload is.

    Null streams have no frames.  Any bytes may be given; damage shows as skipped bytes,
    failed checksums or a wrong table.
    """

    def facts(data: bytes) -> dict:
        found = parse(data)
        payload = payload_of(data, found)
        told = found.tags.get("TXXX:payload", "")
        return {
            "frames": len(found.offsets), "samples": found.samples, "rate": found.rate, "micros": found.micros, "kbits": sorted(found.kbits),
            "crc_checked": found.checked, "crc_failed": found.failed, "skipped": found.skipped, "table": found.table, "seek": found.offsets,
            "n_bytes": int(told) if told.isascii() and told.isdigit() and len(told) <= 18 else len(payload), "payload_bytes": len(payload),
            "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": crc32(payload[-16:]),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                streams = [data.as_py() or b"" for data in part.column(1)]
                found = pa.array([facts(data) for data in streams], FACTS)
                sizes = pa.array([len(data) for data in streams], pa.int64())
                sums = pa.array([hashlib.sha256(data).hexdigest() for data in streams], pa.string())
                names = ["doc_id", *[f.name for f in FACTS], "media_bytes", "media_sha256"]
                yield pa.RecordBatch.from_arrays([part.column(0), *found.flatten(), sizes, sums], names=names)

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def stored_features(docs: DataFrame) -> DataFrame:
    """Store each text as a stream in a table, read the table back, and compute features.

    Null and empty texts become one unit of blanks.  Null ids and repeated rows are kept row
    by row, other columns are ignored, an empty table gives an empty result.
    """
    return features(write_table(media(docs)))


def digests(found: DataFrame) -> DataFrame:
    """The facts that identify a stored text, with the others as one string."""
    seek = F.substring(F.sha2(F.array_join("seek", ",").cast("binary"), 256), 1, 16)
    feature = F.format_string(
        "frames=%d;samples=%d;rate=%d;us=%d;kbits=%s;crc=%d/%d;skipped=%d;table=%s;seek=%s",
        "frames", "samples", "rate", "micros", F.array_join("kbits", "+"), "crc_failed", "crc_checked", "skipped", "table", seek,
    )
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return found.select(*names, feature.alias("feature"))
