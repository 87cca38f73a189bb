"""Secret scans: fixed patterns, and candidates confirmed by what they decode to."""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernspark.llm.common import sliced, slices

#: The base patterns, in the order in which kinds are listed, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones can be skipped at once
KINDS = ("assign", "access", "hex", "pem", "der", "jwt", "sshkey")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

#: Armoured keys, signed tokens and long base64 or hex runs: candidates only, reported if their inside parses.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}?PRIVATE KEY)-----((?:(?:(?:\r?\n|\\r\\n|\\n)[ \t]*)+[A-Za-z][A-Za-z0-9-]*:[^\n\\]*)*)([A-Za-z0-9+/=\s\\]+)-----END \1-----", re.ASCII)
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(e[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
#: A run in either alphabet with the lines that go on after it.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}(?:[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
_LINE = re.compile(r"\\r\\n|\\n|[A-Za-z0-9+/_-]+")
_LONG_HEX = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{64,}(?![0-9a-fA-F])")
#: Encodings within encodings that are undone.
MOST_DEPTH = 3
#: Elements of a key's sequence, and nested ones included, at most; keys of the known kinds have up to 9 and under 30.
MOST_PARTS, MOST_ELEMENTS = 16, 64

Span = tuple[str, int, int]
_STANDARD = str.maketrans("-_", "+/")


def _unbase64(s: str, *, url: bool = False) -> bytes | None:
    s = s.rstrip("=")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """Where an element's content begins and ends, given the place of its length byte; None if it doesn't fit."""
    if at >= len(data):
        return None
    n = data[at]
    at += 1
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(data) or data[at] == 0:
            return None
        n = int.from_bytes(data[at : at + k], "big")
        at += k
        if n < 0x80:
            return None
    return (at, at + n) if at + n <= len(data) else None


def der_elements(data: bytes, a: int, b: int, depth: int = 0, left: list[int] | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the elements that fill data[a:b] exactly, nested ones checked too; None if the lengths don't nest or there are over ``MOST_PARTS``, or ``MOST_ELEMENTS`` in all."""
    out, left = [], left or [MOST_ELEMENTS]
    while a < b:
        tag = data[a]
        left[0] -= 1
        if left[0] < 0 or tag & 0x1F == 0x1F or not (x := der_length(data, a + 1)) or x[1] > b:
            return None
        if tag in (0x30, 0x31) and (depth > 8 or der_elements(data, *x, depth + 1, left) is None):
            return None
        out.append((tag, *x))
        if len(out) > MOST_PARTS:
            return None
        a = x[1]
    return out


def der_key(data: bytes, at: int = 0) -> int | None:
    """The end of a DER sequence at ``at`` that is shaped like a private key: of integers (PKCS 1, or DSA's), a version, an algorithm
    identifier and an octet string (PKCS 8), an algorithm identifier with a sequence of parameters and an octet string (encrypted PKCS 8), or version 1
    and an octet string (SEC 1). Public keys are no secrets. Only the elements' heads are looked at, at most ``MOST_ELEMENTS``."""
    if at >= len(data) or data[at] != 0x30 or not (x := der_length(data, at + 1)) or x[1] - at < 24 or data[x[0]] not in (0x02, 0x30):
        return None
    parts = der_elements(data, *x)
    if not parts or len(parts) < 2:
        return None
    tags = [t for t, _, _ in parts]
    oid = lambda p: p[0] == 0x30 and p[2] - p[1] > 2 and data[p[1]] == 0x06
    if tags[0] == 0x30:
        found = tags == [0x30, 0x04] and oid(parts[0]) and [t for t, _, _ in der_elements(data, *parts[0][1:])] == [0x06, 0x30]
    elif tags[0] != 0x02:
        found = False
    elif len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
        found = oid(parts[1])
    elif tags[1] == 0x04:
        found = data[parts[0][1] : parts[0][2]] == b"\x01"
    else:
        found = set(tags) == {0x02} and len(tags) in (6, 9) and data[parts[0][1] : parts[0][2]] == b"\0"
    return x[1] if found else None


def is_der_key(data: bytes) -> bool:
    """Whether all of ``data`` is a private key, see :func:`der_key`."""
    return der_key(data) == len(data)


def is_ssh_key(data: bytes) -> bool:
    """Whether ``data`` is an SSH private key: the format's name, then length-prefixed cipher, derivation and its options, and a number of keys that isn't zero."""
    magic, at = b"openssh-key-v1\0", 15
    if not data.startswith(magic):
        return False
    for _ in range(3):
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if at + 4 > len(data):
            return False
    return int.from_bytes(data[at : at + 4], "big") > 0


def is_signed_token(header: str, payload: str) -> bool:
    """Whether two base64url parts are JSON objects and the first names an algorithm that signs."""
    parts = []
    for p in (header, payload):
        data = _unbase64(p, url=True)
        try:
            parts.append(json.loads(data) if data else None)
        except (ValueError, RecursionError):
            return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str) and parts[0]["alg"].lower() != "none"


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, leftmost non-overlapping in each kind, in code points, ends exclusive."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _der_in(s: str) -> Iterator[tuple[int, int]]:
    """Begin and end of each base64 of a DER key in ``s``, one after the other: 0x30 makes an M, the sequence's length tells the end.

    ``s`` is decoded once from each of four places, whichever M a key begins with, and a candidate costs the heads of its elements.
    """
    decoded: list[bytes | None] = [None] * 4
    at = s.find("M")
    while at >= 0:
        first = at % 4
        if decoded[first] is None:
            n = len(s) - first
            decoded[first] = _unbase64(s[first : len(s) - (n % 4 == 1)]) or b""
        begin = (at - first) // 4 * 3
        end = der_key(decoded[first], begin)
        if end is not None:
            stop = at + -((begin - end) * 4 // 3)  # rounded up
            yield at, stop
            at = s.find("M", stop)
        else:
            at = s.find("M", at + 1)


def _decoded_spans(data: bytes, depth: int) -> list[Span]:
    """Confirmed spans, in bytes, of decoded bytes: all of them if they are a key, else those of the text that they are."""
    if is_ssh_key(data):
        return [("sshkey", 0, len(data))]
    if is_der_key(data):
        return [("der", 0, len(data))]
    if depth < MOST_DEPTH and (b"-----BEGIN " in data or b"eyJ" in data or data.isascii()):
        return confirmed_spans(data.decode("latin-1"), depth + 1)
    return []


class _Reach:
    """How far spans reach that begin at or before a place: prefix maxima in a Fenwick tree."""

    def __init__(self, n: int):
        self.ends = [-1] * (n + 1)

    def add(self, place: int, end: int) -> None:
        place += 1
        while place < len(self.ends):
            self.ends[place] = max(self.ends[place], end)
            place += place & -place

    def until(self, place: int) -> int:
        place, far = place + 1, -1
        while place > 0:
            far = max(far, self.ends[place])
            place &= place - 1
        return far


def _base64_spans(text: str, m: re.Match, depth: int) -> list[Span]:
    """Confirmed spans of a run of base64 and the lines after it. What lies in decoded text takes whole lines."""
    lines = [(x.start() + m.start(), x[0]) for x in _LINE.finditer(m[0]) if x[0][0] != "\\"]
    places = [0]  # where each line begins in the joined run
    for _, line in lines:
        places.append(places[-1] + len(line))
    joined = "".join(line for _, line in lines).translate(_STANDARD)

    def place(i: int) -> int:
        k = bisect.bisect_right(places, i, 0, len(lines)) - 1
        return lines[k][0] + i - places[k]

    def padded(end: int) -> int:
        return m.end() if end >= m.end() - 2 and not text[end : m.end()].strip("=") else end

    out = [("der", place(a), padded(place(b - 1) + 1)) for a, b in _der_in(joined)]
    begins = [a for a, _ in lines]
    reach = _Reach(len(lines))
    for _, a, b in out:
        reach.add(bisect.bisect_left(begins, a), b)
    # An encoding may stop at any line's end, as the words of the next line can look like more of it, and may begin after other signs.
    for start in range(4):
        for n in sorted({len(lines), max(len(lines) - 1, 1), 1}, reverse=True):
            s = joined[start : places[n]]
            data = _unbase64(s) if len(s) % 4 != 1 else _unbase64(s[:-1])
            for kind, a, b in _decoded_spans(data, depth) if data else ():
                first = bisect.bisect_right(places, start + a * 4 // 3, 0, len(lines)) - 1
                last = bisect.bisect_right(places, min(start + -(-b * 4 // 3), places[n]) - 1, 0, len(lines)) - 1
                span = (kind, lines[first][0], padded(lines[last][0] + len(lines[last][1])))
                if reach.until(first) < span[2]:  # else it lies in a span told before
                    out.append(span)
                    reach.add(first, span[2])
    return out


def confirmed_spans(text: str, depth: int = 0) -> list[Span]:
    """Spans whose inside decodes to a key or a signed token, through up to ``MOST_DEPTH`` encodings."""
    out = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = _unbase64(re.sub(r"\s|\\[nr]", "", m[3]))
            locked = "ENCRYPTED" in m[2] or "DEK-Info:" in m[2]  # the inside is whole blocks of a cipher
            if data and (is_der_key(data) or is_ssh_key(data) or locked and len(data) >= 16 and len(data) % 8 == 0):
                out.append(("pem", *m.span()))
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]
    # Spans so far, each kind ascending and apart: what lies in one of them isn't told again.
    known = [[x for x in out if x[0] == kind] for kind in ("pem", "jwt")]
    starts = [[x[1] for x in k] for k in known]

    def inside(a: int, b: int) -> bool:
        return any((i := bisect.bisect_right(s, a)) and b <= k[i - 1][2] for s, k in zip(starts, known, strict=True))

    for m in _BASE64.finditer(text):
        out += [s for s in _base64_spans(text, m, depth) if not inside(s[1], s[2])]
    for m in _LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and (found := _decoded_spans(bytes.fromhex(m[0]), depth)):
            out.append((found[0][0], *m.span()))
    return out


def find(text: str | None) -> list[Span]:
    """All spans by start, then kind as listed."""
    if not text:
        return []
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds secrets in every whole text: ``<id_col>, spans array<struct<kind,start,end>>`` per row.

    Kinds, in this order where starts are equal: assign, access, hex (base patterns, always reported), pem, der, jwt, sshkey
    (reported only if the candidate decodes and its nested lengths, key fields or token header parse; public keys and unsigned tokens aren't secrets). Offsets count
    code points; ends are exclusive. Null or empty text: an empty array. Null ids and repeated rows stay; other columns
    aren't read; an empty table gives an empty table. Very long texts are searched whole, in one task's memory.
    """
    src = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("_text"))
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(_SPAN))], [id_col, "spans"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, spans {SPANS}")


def redact(text: str | None) -> str | None:
    """``text`` with every secret, overlapping spans together, replaced by ``[KIND]`` of the first span."""
    spans = find(text)
    if not spans:
        return text
    out, at, end, first = [], 0, -1, ""
    for kind, a, b in [*spans, ("", len(text) + 1, 0)]:
        if a >= end:
            if end >= 0:
                out.append(f"[{first.upper()}]")
                at = end
            out.append(text[at:a])
            first, end = kind, b
        else:
            end = max(end, b)
    return "".join(out)


def redacted(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows with the secrets of ``text_col`` replaced, see :func:`redact`; null texts stay null, other columns go through whatever their names.

    Only the texts are sent to Python, as Arrow arrays, and are made into strings a slice at a time.
    """

    @F.arrow_udf("string")
    def cleaned(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            yield sliced(some, lambda part: pa.array(list(map(redact, part)), pa.string()))

    return docs.withColumn(text_col, cleaned(F.col(text_col)))
