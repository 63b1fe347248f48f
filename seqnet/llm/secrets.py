"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Natural text and code come in pieces that a subword vocabulary knows, so a token covers
several characters; random strings break into many short tokens.  A string of secret-like
characters whose characters per token fall below a ratio is reported, unless it is a digest
of a known length or an identifier made of words that the vocabulary knows.  Digits count like
any other characters: the ratio decides for a long number too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqnet.llm.common import sliced

KINDS = ("assign", "access", "hex", "token")
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Least characters of group 2, of an access key, and of any run worth looking at.
ASSIGN_CHARS, ACCESS_CHARS, RUN_CHARS = 6, 20, 20
RANDOM_RUN = re.compile(rf"[A-Za-z0-9+/=_-]{{{RUN_CHARS},}}")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 (fixed values).
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Shape of names, with at most a short number behind each part: snake, kebab, camel case and paths.
NAME = re.compile(r"(?:[+/=_-]*(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z]))[0-9]{0,4})+[+/=_-]*")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RATIO = 2.2
#: Least letters per token of a name's parts: of 1 500 random strings each of six alphabets, 20 or 32 long, one reaches it.
WORD_RATIO = 2.5


@cache
def vocabulary(folder: str | None, name: str):
    import base64

    import public_tokenizers
    import tiktoken

    path = f"{folder}/{name}.tiktoken" if folder else public_tokenizers.path(f"{name}.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_name(run: str, folder: str | None, name: str) -> bool:
    """Whether the run has the shape of a name and the vocabulary knows its parts as words, in some spelling."""
    if not NAME.fullmatch(run):
        return False
    parts, count = PART.findall(run), vocabulary(folder, name).encode_ordinary
    tokens = sum(min(len(count(p)) for p in (part, part.lower(), f" {part.lower()}", part.capitalize())) for part in parts)
    return sum(map(len, parts)) >= WORD_RATIO * tokens


def is_random(run: str, folder: str | None, name: str, ratio: float) -> bool:
    """Whether few characters of the run make a token, and it is neither digest nor identifier."""
    if (len(run) in DIGEST_CHARS and HEXADECIMAL.fullmatch(run)) or UUID.fullmatch(run):
        return False
    return len(run) < ratio * len(vocabulary(folder, name).encode_ordinary(run)) and not is_name(run, folder, name)


def long_runs(text: str) -> Iterator[tuple[int, str]]:
    """Pieces between white space that are long enough for a key, with their place."""
    at = 0
    for piece in text.split():
        if len(piece) >= RUN_CHARS:
            at = text.find(piece, at)
            yield at, piece
            at += len(piece)


def find(text: str, folder: str | None = None, name: str = "byte_bpe_50k", ratio: float = RATIO) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of all secrets of a whole text, by start, then kind as listed."""
    spans = []
    lowered = text.lower()
    if any(word in lowered for word in KEYWORDS):
        spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    random = []
    for at, piece in long_runs(text):
        spans += [("access", at + m.start(), at + m.end()) for m in ACCESS.finditer(piece) if len(m[0]) >= ACCESS_CHARS]
        spans += [("hex", at + m.start(), at + m.end()) for m in HEX.finditer(piece)]
        random += [("token", at + m.start(), at + m.end()) for m in RANDOM_RUN.finditer(piece) if is_random(m[0], folder, name, ratio)]
    if random:
        base = list(spans)
        spans += [s for s in random if not any(b[1] <= s[1] and s[2] <= b[2] for b in base)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def secrets(docs: DataFrame, text: str = "text", folder: str | None = None, name: str = "byte_bpe_50k", ratio: float = RATIO) -> DataFrame:
    """``doc_id, secrets`` of each row: an array of ``kind, start, end, value`` in code points.

    Null and empty texts have an empty array.  Null ids, repeated rows and ties are scanned
    like any other; other columns are ignored, an empty table gives an empty result.
    ``folder`` holds the vocabulary where it is not the installed one.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = []
            for text in batch.column(1).to_pylist():
                spans = find(text, folder, name, ratio)
                found.append([{"kind": k, "start": a, "end": z, "value": text[a:z]} for k, a, z in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "secrets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, secrets array<struct<kind: string, start: bigint, end: bigint, value: string>>"
    return docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    spans = F.col("secrets")
    base = of_kind(spans, *BASE_KINDS)
    counts = [F.size(of_kind(spans, kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))
