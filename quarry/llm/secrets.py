"""Secret scans with structural confirmation.

Base spans come from three patterns (assignments, access keys, hex strings), leftmost
and non-overlapping per kind. The method adds spans that patterns alone can't vouch for:
base64 or hex runs are decoded, and reported only if the bytes parse as a private key
(ASN.1 lengths that nest exactly, in the shape of a known key, or the OpenSSH container
with its length-prefixed fields) or are PEM text of one, and dotted triples only if the first part decodes to a
JSON header that names a signing algorithm. A run may follow '=' and go on over line
breaks, escaped ones too; the key's own length fields say where it ends. Each text is scanned whole, by itself: no
shuffle, memory of one Arrow batch.

Defined cases: a null or empty text has no spans; very long texts are scanned whole; rows
with a null ``doc_id`` and repeated rows are scanned each; spans that begin together are
listed by kind; an empty table gives no rows; other columns pass, whatever their names,
but a column named ``secrets`` in any case is replaced. Positions are code points, ends
exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._native import finished, inner_names

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "key")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("passw", "secret", "token", "apikey", "api_key")

SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
#: What may stand inside a key: white space, and line breaks escaped once or more often, as in JSON.
BREAK = r"(?:\s|\\+(?:[nrt]|u000[aAdD9]|/(?=/)|\r?\n))"
BREAKS = re.compile(rf"{BREAK}|\\")
ARMOURED = re.compile(rf"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=]|{BREAK}|\\+/)+)-----END \1-----")
#: Starts of base64 that can be a key: a DER sequence, the OpenSSH container or PEM text. '=' may stand before (``KEY=MII...``).
START64 = re.compile(r"M[A-P][A-Za-z0-9+/_-]{2}|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi")
START16 = re.compile(r"30[0-9A-Fa-f]{6}|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100|2[Dd]2[Dd]2[Dd]2[Dd]2[Dd]424547494[Ee]")
#: What may stand right before a start: no character of a run but that of an escape.
FREE64, FREE16 = re.compile(r"(?<![A-Za-z0-9+/_-])|(?<=\\[nrt])|(?<=\\u000[aAdD9])"), re.compile(r"(?<![0-9A-Fa-f])|(?<=\\u000[aAdD9])")
PIECE64 = re.compile(rf"([A-Za-z0-9+/_-]+)((?:{BREAK}|\\(?=/))*)")
PIECE16 = re.compile(rf"([0-9A-Fa-f]+)((?:{BREAK})*)")
PADDING = re.compile("={0,2}")
OPENSSH = b"openssh-key-v1\0"


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of consecutive DER elements that fill ``data`` exactly, or None."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + size > len(data):
            return None
        found.append((tag, data[at : at + size]))
        at += size
    return found


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are a private key: PKCS#1, PKCS#8 (plain or encrypted), SEC1 or OpenSSH."""
    if data.startswith(OPENSSH):
        at, fields = len(OPENSSH), 0
        for _ in range(3):  # cipher, key derivation and its options
            size = int.from_bytes(data[at : at + 4], "big")
            if at + 4 + size > len(data):
                return False
            at, fields = at + 4 + size, fields + 1
        return int.from_bytes(data[at : at + 4], "big") >= 1
    outer = elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = elements(outer[0][1])
    if not parts:
        return False
    tags = [t for t, _ in parts]
    algorithm = lambda body: bool((inner := elements(body)) and inner[0][0] == 0x06)
    if tags[:3] == [0x02, 0x30, 0x04]:
        return algorithm(parts[1][1])
    if tags == [0x30, 0x04]:
        return algorithm(parts[0][1])
    if tags[:2] == [0x02, 0x04] and parts[0][1] == b"\1":
        return len(parts[1][1]) >= 16
    return len(tags) >= 9 and set(tags[:9]) == {0x02}


def key_size(data: bytes) -> int | None:
    """Bytes of the key that ``data`` begins with, by its own length fields; None if it begins with none."""
    if data.startswith(OPENSSH):
        at, left = len(OPENSSH), 3  # cipher, key derivation and its options
        while left:
            if at + 4 > len(data):
                return None
            at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
        keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        for _ in range(min(keys, 64) + 1):  # public keys, then the private part
            if at + 4 > len(data):
                return None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at
    if len(data) < 6 or data[0] != 0x30:
        return None
    width = data[1] & 0x7F if data[1] >= 0x80 else 0
    if width > 4 or data[1] == 0x80 or len(data) <= 2 + width or data[2 + width] not in (0x02, 0x30):
        return None
    return 2 + width + (int.from_bytes(data[2 : 2 + width], "big") if width else data[1])


def decode64(run: str) -> bytes:
    clean = BREAKS.sub("", run).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(clean + "=" * (-len(clean) % 4))
    except (binascii.Error, ValueError):
        return b""


def armoured_keys(text: str) -> list[re.Match]:
    return [m for m in ARMOURED.finditer(text) if is_private_key(decode64(m[2]))] if "-----BEGIN " in text else []


def gathered(text: str, at: int, piece: re.Pattern, wanted: float) -> tuple[str, list[tuple[int, int]]]:
    """Characters of the run at ``at`` over its line breaks, about ``wanted`` of them, and the pieces that they come from."""
    pieces: list[tuple[int, int]] = []
    while wanted > 0 and (m := piece.match(text, at)):
        pieces.append(m.span(1))
        wanted, at = wanted - len(m[1]), m.end()
        if not m[2]:
            break
    return "".join(text[a:b] for a, b in pieces), pieces


def key_end(text: str, at: int, piece: re.Pattern) -> int | None:
    """End of the encoded key that starts at ``at``, or None."""
    bits = 6 if piece is PIECE64 else 4

    def decoded(run: str) -> bytes:
        if bits == 4:
            return bytes.fromhex(run[: len(run) // 2 * 2])
        return decode64(run[:-1] if len(run) % 4 == 1 else run)

    def end(pieces: list[tuple[int, int]], size: int) -> int | None:
        """Where ``size`` bytes end, which must be the end of a piece."""
        left = -(-size * 8 // bits)
        for a, b in pieces:
            if left <= b - a:
                return b if left == b - a else None
            left -= b - a
        return None

    head = decoded(gathered(text, at, piece, 16)[0])
    if head.startswith(b"-----BEG"):
        run, pieces = gathered(text, at, piece, float("inf"))
        keys = armoured_keys(decoded(run).decode("latin-1"))
        if not keys:
            return None
        left = -(-keys[-1].end() * 8 // bits)
        for a, b in pieces:
            if left <= b - a:
                return b
            left -= b - a
        return None
    if head.startswith(OPENSSH[:8]):
        run, pieces = gathered(text, at, piece, float("inf"))
        data = decoded(run)
        size = key_size(data)
        if size and size <= len(data) and is_private_key(data[:size]) and (found := end(pieces, size)):
            return found
        # Cut off: its fields up to the keys are evidence enough.
        a, b = pieces[0]
        return b if b - a >= 48 and is_private_key(decoded(text[a:b])) else None
    size = key_size(head)
    if not size or size < 16:
        return None
    run, pieces = gathered(text, at, piece, -(-size * 8 // bits))
    data = decoded(run)
    return end(pieces, size) if len(data) >= size and is_private_key(data[:size]) else None


def names_algorithm(part: str) -> bool:
    try:
        header = json.loads(decode64(part))
    except ValueError:
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def base_spans(text: str) -> Iterator[tuple[int, int, str]]:
    low = text.lower()
    if any(n in low for n in NAMES):
        yield from ((*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6)
    if "AKIA" in text:
        yield from ((*m.span(), "access") for m in ACCESS.finditer(text))
    yield from ((*m.span(), "hex") for m in HEX.finditer(text))


def confirmed_spans(text: str) -> Iterator[tuple[int, int, str]]:
    if "eyJ" in text:
        yield from ((*m.span(), "jwt") for m in SIGNED.finditer(text) if names_algorithm(m[1]))
    done = [m.span() for m in armoured_keys(text)]
    yield from ((*span, "key") for span in done)
    for start, free, piece in ((START64, FREE64, PIECE64), (START16, FREE16, PIECE16)):
        past = 0
        for m in start.finditer(text):
            if m.start() < past or not free.match(text, m.start()) or any(a <= m.start() < b for a, b in done):
                continue
            if end := key_end(text, m.start(), piece):
                past = end
                if piece is PIECE64:
                    end += len(PADDING.match(text, end)[0])
                yield m.start(), end, "key"


def scan(text: str | None) -> list[tuple[str, int, int]]:
    if not text:
        return []
    found = {*base_spans(text), *confirmed_spans(text)}
    return [(kind, start, end) for start, end, kind in sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``secrets``: an array of (kind, start, end)."""
    names = inner_names(docs.columns, "text")
    inner = docs.toDF(*names)
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*inner.schema.fields, T.StructField("secrets", kind)])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t.as_py())] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, SPANS)], [*batch.schema.names, "secrets"])

    return finished(inner.mapInArrow(scanned, schema), docs.columns, names, {"secrets": F.col("secrets")})


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs)
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(F.size(of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )
