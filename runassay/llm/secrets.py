"""Secrets in texts: base patterns, and candidates confirmed by their structure."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runassay.llm.common import mapped, slices

# The base patterns and least lengths.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16

KINDS = ("assign", "access", "hex", "jwt", "pem", "key", "nested")
BASE = KINDS[:3]

_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*+)")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:(?!-----)[\s\S])*+)-----END \1-----")
# The shortest base secret has 14 bytes (token= and eight characters): 19 base64 characters, 28 hex digits.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{19,}+={0,2}")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{28,}+")
_WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}"
)
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Encodings within encodings that are opened.
DEPTH = 3

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Base matches, leftmost and non-overlapping per kind; failing ones are dropped."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [
            ("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE
        ]
    if "AKIA" in text:
        found += [
            ("access", m.start(), m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= LEAST_ACCESS
        ]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def decode64(text: str) -> bytes | None:
    """Strict base64 in either alphabet, padding optional."""
    plain = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each element, or None unless the lengths fill ``data`` exactly."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
            if size < 0x80:
                return None  # not the shortest form
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


#: Element tags.
_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def private_der(data: bytes) -> bool:
    """An RSA, EC, PKCS#8 or encrypted PKCS#8 private key, by nested lengths and tags."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return False
    inner = der_items(outer[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if tags == [_INTEGER] * 9 or tags[:6] == [_INTEGER] * 6 and len(tags) == 6:
        return inner[0][1] == b"\x00"  # RSA with nine numbers, DSA with six
    if tags[:2] == [_INTEGER, _OCTETS]:
        return inner[0][1] == b"\x01" and len(inner[1][1]) >= 16  # EC
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS]:
        kind = der_items(inner[1][1])
        return inner[0][1] in (b"\x00", b"\x01") and bool(kind) and kind[0][0] == _OID
    if tags == [_SEQUENCE, _OCTETS]:
        kind = der_items(inner[0][1])
        return bool(kind) and kind[0][0] == _OID and len(inner[1][1]) >= 16
    return False


#: Fixed value: start of this key format.
_SSH_START = b"openssh-key-v1\x00"


def private_ssh(data: bytes) -> bool:
    """The format of SSH private keys: every nested length must fit."""
    if not data.startswith(_SSH_START):
        return False
    at = len(_SSH_START)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(field() is None for _ in range(3)):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return False
    return all(field() for _ in range(keys + 1))


def private_key(data: bytes | None) -> bool:
    return data is not None and (private_der(data) or private_ssh(data))


#: Signature bytes of each algorithm; None where the length varies.
SIGNATURES = {
    "HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64,
    "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None,
}


def signed_token(header: str, payload: str, signature: str) -> bool:
    """A signed token: a JSON header that names an algorithm, a JSON payload, a fitting signature."""
    parts = []
    for part in (header, payload):
        try:
            parts.append(json.loads((decode64(part) or b"").decode()))
        except (ValueError, RecursionError):
            return False
        if not isinstance(parts[-1], dict):
            return False
    alg = parts[0].get("alg")
    if not isinstance(alg, str) or alg not in SIGNATURES:
        return False
    size = len(decode64(signature) or b"")
    return size == SIGNATURES[alg] if SIGNATURES[alg] else size >= 128


def plain_text(data: bytes | None) -> str | None:
    """Decoded bytes as text, if all of it is printable or line and tab controls."""
    try:
        text = (data or b"").decode()
    except UnicodeDecodeError:
        return None
    return text if text.translate(_BLANKS).isprintable() else None


_BLANKS = {9: " ", 10: " ", 13: " "}


def wrapped_runs(text: str) -> Iterator[tuple[int, int]]:
    """Encoded values that run over lines of one length, with a shorter last line or without."""
    for m in _WRAPPED.finditer(text):
        lines = [(x.start(), x.end()) for x in _LINE.finditer(text, m.start(), m.end())]
        i = 0
        while i < len(lines):
            size = lines[i][1] - lines[i][0]
            j = i + 1
            while j < len(lines) and lines[j][1] - lines[j][0] == size:
                j += 1
            if size >= 16:
                if j < len(lines) and lines[j][1] - lines[j][0] < size:
                    yield lines[i][0], lines[j][1]
                if j > i + 1:
                    yield lines[i][0], lines[j - 1][1]
            i = j


def decoded_kind(text: str, depth: int) -> str | None:
    """``key`` or ``nested`` if the text encodes a private key, or text that holds a secret."""
    for decode in (decode64, _from_hex):
        data = decode(text)
        if private_key(data):
            return "key"
        plain = plain_text(data)
        if plain and (base_spans(plain) or depth and structural_spans(plain, depth - 1)):
            return "nested"
    return None


def structural_spans(text: str, depth: int = DEPTH) -> list[Span]:
    """Candidates that decode and parse as what they seem to be.

    What decodes to text is searched in turn, ``depth`` encodings deep.
    """
    found: list[Span] = []
    if "." in text and "eyJ" in text:
        found += [("jwt", m.start(), m.end()) for m in _TOKEN.finditer(text) if signed_token(*m.groups())]
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            lines = m[2].split("\n\n", 1)
            locked = "ENCRYPTED" in lines[0] and len(lines) == 2
            body = decode64(lines[1] if locked else m[2])
            if private_key(body) or locked and body and len(body) % 8 == 0:
                found.append(("pem", m.start(), m.end()))
    inside = [(a, b) for kind, a, b in found]
    runs = list(wrapped_runs(text))
    single = [(m.start(), m.end()) for p in (_BASE64, _LONG_HEX) for m in p.finditer(text)]
    for start, end in runs + single:
        if any(a <= start < b for a, b in inside):
            continue
        kind = decoded_kind(text[start:end], depth)
        if kind:
            found.append((kind, start, end))
            inside.append((start, end))
    return found


def _from_hex(text: str) -> bytes | None:
    try:
        return bytes.fromhex(text)
    except ValueError:
        return None


def listed(spans: list[Span], kinds: tuple[str, ...] = KINDS) -> str:
    """``kind:start:end`` by start, then kind in the listed order, comma-joined."""
    own = sorted({s for s in spans if s[0] in kinds}, key=lambda s: (s[1], kinds.index(s[0]), s[2]))
    return ",".join([f"{k}:{a}:{b}" for k, a, b in own])


SCHEMA = (
    "n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"
)


def find_secrets(documents: DataFrame) -> DataFrame:
    """Secret spans of each whole text, in code points with the end exclusive.

    Base spans are ``assign``, ``access`` and ``hex``. Confirmed spans are added: ``jwt``
    (signed tokens), ``pem`` (private key blocks), ``key`` (base64 or hex that parses as a
    private key) and ``nested`` (base64 or hex that decodes to text with a base or confirmed
    secret, up to ``DEPTH`` encodings deep). Values may be wrapped over lines of one length.
    Null and empty texts have none; repeated rows are reported each; null ids stay null;
    other columns are ignored; an empty table gives no rows.
    """
    key = documents.schema["doc_id"].dataType.simpleString()
    narrow = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return mapped(narrow, _scan, f"doc_id {key}, {SCHEMA}")


def _scan(batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts: dict[str, list[int]] = {k: [] for k in BASE}
        confirmed, digests, spans = [], [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            more = structural_spans(text or "")
            for k in BASE:
                counts[k].append(sum([s[0] == k for s in base]))
            confirmed.append(len(more))
            digests.append(hashlib.sha256(listed(base, BASE).encode()).hexdigest())
            spans.append(listed(base + more))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                **{f"n_{k}": pa.array(counts[k], pa.int64()) for k in BASE},
                "n_confirmed": pa.array(confirmed, pa.int64()),
                "base_sha256": pa.array(digests, pa.string()),
                "spans": pa.array(spans, pa.string()),
            }
        )
