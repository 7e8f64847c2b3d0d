"""Secret scans with structural confirmation.

Three plain patterns (assignments, access keys, long hex runs) are reported as
they match.  Beyond them, base64 and hex candidates are decoded, and what they
hold must parse before it is reported: a private key in DER, whose nested
lengths fill the bytes exactly; an OpenSSH key, likewise; PEM armour around
either; a signed token, whose header names an algorithm and whose claims are an
object.

A candidate may begin wherever no letter or digit stands before it, as slashes,
dashes and underscores are both separators and digits of base64.  The first
bytes say whether it can be a key and how long that is, so each place costs
little, and a key that is wrapped in lines or followed by something is found.
Decoded text is searched in turn, as deep as it goes: each level is a quarter
shorter.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks

BLOCK_BYTES = 1 << 20
#: In the order in which spans with one start are listed.
KINDS = ["assign", "access", "hex", "jwt", "pem", "der", "ssh"]
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_CANDIDATE = 6, 20, 24, 24
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# The value's class is of both cases already, so ignoring case changes the names only.
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}+")
TOKEN_HINT = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[nrt]))e[yw][A-Za-z0-9_-]{6,}+\.")
RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIN_CANDIDATE)
HEX_DIGITS = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{%d,}(?![0-9A-Fa-f])" % MIN_CANDIDATE)
DIGITS = re.compile(r"[A-Za-z0-9+/_-]+")
#: Where digits of base64 go on in the next line; line ends may be escaped, as in JSON.
WRAP = re.compile(r"[ \t]*(?:(?:\\+r)?\\+n|\r?\n)[ \t]*(?=[A-Za-z0-9+/_-])")
TOKEN_HEAD = re.compile(rb"\{\s*(?:\}|\"[\w.:#/-]{1,60}\"\s*:)")
START = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[nrt]))[A-Za-z0-9]")
SSH_MAGIC = b"openssh-key-v1\x00"
_RUNS = bytes(49 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_-") else 32 for b in range(256))
_HEX_RUNS = bytes(49 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_RUN, _HEX_RUN = b"1" * MIN_CANDIDATE, b"1" * MIN_HEX


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of elements that fill ``data`` exactly; None if they don't."""
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
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def is_der_key(data: bytes) -> bool:
    """Whether ``data`` is a private key: PKCS#1, PKCS#8 (encrypted too), SEC 1 or traditional DSA."""
    outer = der_items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = der_items(outer[0][1])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _ in inner]
    if tags[0] == 0x30 and tags[1:] == [0x04]:  # encrypted: algorithm, octets
        algorithm = der_items(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(inner[1][1]) >= 16
    if tags[0] != 0x02 or len(inner[0][1]) != 1:
        return False
    if tags[1] == 0x30 and tags[2:3] == [0x04]:  # version, algorithm, key
        algorithm = der_items(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and bool(inner[2][1])
    if tags[1] == 0x04:  # version, private value of a curve
        return 16 <= len(inner[1][1]) <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return (len(inner) >= 9 or len(inner) == 6) and set(tags) == {0x02} and len(inner[1][1]) >= 32  # numbers of an RSA or DSA key


def der_size(head: bytes) -> int:
    """How long the element is that begins with ``head``, if a private key can begin so; else 0."""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 3 or head[1] == 0x80 or head[2 + n] not in (0x02, 0x30):
        return 0
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def ssh_size(data: bytes) -> int:
    """How long the OpenSSH private key is that ``data`` begins with, by its nested lengths; 0 if there is none."""
    if not data.startswith(SSH_MAGIC):
        return 0
    at = len(SSH_MAGIC)

    def field() -> bool:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        return at <= len(data)

    if not all(field() for _ in range(3)):  # cipher, derivation, its options
        return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at if 1 <= keys <= 64 and all(field() for _ in range(keys + 1)) else 0


def is_ssh_key(data: bytes) -> bool:
    """Whether ``data`` is an OpenSSH private key whose nested lengths fill it."""
    return 0 < ssh_size(data) == len(data)


def decoded(text: str) -> list[bytes]:
    """What ``text`` may stand for: hex digits, base64 or its URL-safe form."""
    out = []
    if len(text) % 2 == 0 and re.fullmatch(r"[0-9A-Fa-f]+", text):
        out.append(bytes.fromhex(text))
    bare = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 != 1:
        try:
            out.append(base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True))
        except binascii.Error:
            pass
    return out


def is_token(header: str, claims: str, signature: str) -> bool:
    try:
        # its beginning and its end say whether the rest is worth decoding
        tail = len(header) - (len(header) % 4 or 4) - 4
        if not TOKEN_HEAD.match(unarmoured(header[:96])) or not unarmoured(header[max(tail, 0) :]).rstrip().endswith(b"}"):
            return False
        head, body = (json.loads(decoded(x)[-1]) for x in (header, claims))
    except (ValueError, IndexError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str) or not isinstance(body, dict):
        return False
    return bool(decoded(signature)) if signature else head["alg"].lower() == "none"


def armoured(label: str, body: str) -> bool:
    """Whether the body of a PEM block holds a key, encrypted in the old way too."""
    # line ends may be escaped, as in JSON
    body = re.sub(r"\\+r\\+n|\\+[rn]|\r\n?", "\n", body).replace("\\/", "/")
    headers, _, rest = body.partition("\n\n") if ":" in body else ("", "", body)
    text = re.sub(r"\s+", "", rest)
    data = decoded(text)
    if "DEK-Info" in headers:
        return bool(data) and len(data[-1]) >= 16 and len(data[-1]) % 8 == 0
    return any(is_der_key(d) or is_ssh_key(d) for d in data)


def unarmoured(digits: str) -> bytes:
    """The bytes of base64 digits of either alphabet; a last one that fills no byte is left out."""
    digits = digits[: len(digits) - (len(digits) % 4 == 1)].replace("-", "+").replace("_", "/")
    return binascii.a2b_base64(digits + "=" * (-len(digits) % 4))


def gathered(text: str, at: int, most: int) -> tuple[str, int]:
    """Up to ``most`` digits of base64 from ``at`` on, over line ends, and where they end."""
    parts, held = [], 0
    while True:
        m = DIGITS.match(text, at, at + most - held)
        parts.append(m[0])
        held += len(parts[-1])
        more = WRAP.match(text, m.end()) if held < most else None
        if more is None:
            return "".join(parts), at + len(parts[-1])
        at = more.end()


def _end(text: str, at: int) -> int | None:
    """Where a candidate ends whose digits end at ``at``: after its padding; None if letters or digits follow."""
    end = at
    while end < len(text) and end < at + 2 and text[end] == "=":
        end += 1
    return None if end == at and at < len(text) and text[at].isascii() and text[at].isalnum() else end


def key_at(text: str, at: int) -> tuple[int, int, str] | None:
    """The private key in base64 that begins at ``at``."""
    if text[at] == "M":  # the first byte is 0x30
        kind, size = "der", der_size(unarmoured(gathered(text, at, 12)[0]))
    elif text.startswith("b3BlbnNzaC1rZXktdjEA", at):
        kind, size = "ssh", ssh_size(unarmoured(gathered(text, at, len(text))[0]))
    else:
        return None
    digits = -(-8 * size // 6)
    if digits < MIN_CANDIDATE or digits > len(text) - at:
        return None
    body, end = gathered(text, at, digits)
    end = _end(text, end)
    if len(body) < digits or end is None:
        return None
    data = unarmoured(body)[:size]
    return (at, end, kind) if (is_der_key if kind == "der" else is_ssh_key)(data) else None


def text_at(text: str, at: int, end: int, searched: dict[int, int]) -> tuple[int, int, str] | None:
    """The candidate of base64 that begins at ``at`` and holds text with a secret that parses.

    ``searched`` says how far the run is decoded already from a start that is a
    multiple of four digits away: what was found there needs no second look.
    """
    if at < searched.get(at % 4, 0):
        return None
    if not unarmoured(text[at : at + MIN_CANDIDATE]).translate(None, _PLAIN) == b"":
        return None
    data = unarmoured(text[at:end])
    odd = _ODD.search(data)
    if odd:  # what follows the text isn't part of it
        cut = at + odd.start() * 8 // 6
        end = max((k for k in range(max(at, cut - 4), cut + 1) if not text[k].isalnum()), default=0)
        data = unarmoured(text[at:end]) if end - at >= MIN_CANDIDATE else b""
    searched[at % 4] = end
    inner = structural(data.decode("ascii")) if data and _ODD.search(data) is None else []
    stop = _end(text, end)
    return (at, end if stop is None else stop, inner[0][2]) if inner else None


_PLAIN = bytes([9, 10, 13, *range(32, 127)])
_ODD = re.compile(rb"[^\t\n\r\x20-\x7e]")


def tokens(text: str) -> list[tuple[int, int, str]]:
    """The signed tokens of a text."""
    out = []
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(len(parts) - 2):
            end = at + len(parts[k])
            for s in START.finditer(text, at, end) if at >= (out[-1][1] if out else 0) else ():
                begin = s.start()
                if text[begin : begin + 2] in ("ey", "ew") and is_token(text[begin:end], parts[k + 1], parts[k + 2]):
                    out.append((begin, end + len(parts[k + 1]) + len(parts[k + 2]) + 2, "jwt"))
                    break
            at = end + 1
    return out


def _gaps(spans: list[tuple[int, int, str]]):
    """Whether (start, end) overlaps none of ``spans``."""
    ordered = sorted(spans)
    starts, ends = [a for a, _, _ in ordered], list(accumulate((b for _, b, _ in ordered), max))
    return lambda a, b: (k := bisect_left(starts, b)) == 0 or ends[k - 1] <= a


def structural(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of tokens and keys that parse, in order of start; none lies in another."""
    out = []
    if "-----BEGIN " in text:
        out += [(*m.span(), "pem") for m in PEM.finditer(text) if armoured(m[1], m[2])]
    if TOKEN_HINT.search(text):
        out += tokens(text)
    found, free = [], _gaps(out)
    last = 0
    for run in RUN.finditer(text):
        if not free(*run.span()):
            continue
        searched: dict[int, int] = {}
        for s in START.finditer(text, run.start(), run.end()):
            at = s.start()
            if at < last:
                continue
            hit = key_at(text, at) or (text_at(text, at, run.end(), searched) if run.end() - at >= MIN_CANDIDATE else None)
            if hit and free(*hit[:2]):
                found.append(hit)
                last = hit[1]
    free = _gaps(out + found)
    for m in HEX_DIGITS.finditer(text):
        if len(m[0]) % 2 or not free(*m.span()):
            continue
        data = bytes.fromhex(m[0])
        kind = "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None
        if kind is None and _ODD.search(data) is None:
            kind = next((k for _, _, k in structural(data.decode("ascii"))), None)
        if kind:
            found.append((*m.span(), kind))
    return sorted(out + found)


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets of a text, by start, then kind as listed; code points."""
    if not text:
        return []
    out, low, raw = [], text.lower(), text.encode()
    if any(name in low for name in ASSIGN_NAMES):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if _HEX_RUN in raw.translate(_HEX_RUNS):
        out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if _RUN in raw.translate(_RUNS) or "-----BEGIN " in text or TOKEN_HINT.search(text):
        out += structural(text)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SCHEMA = "spans array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, texts in text_blocks(batch.column(1), BLOCK_BYTES):
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in scan((t or b"").decode("utf-8", "replace"))] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(spans, _ARROW)], ["id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans) for every row: the secrets of the whole text.

    ``spans`` are (kind, start, end) by start, then kind as in KINDS, in code
    points with the end exclusive.  Null and empty texts have none, rows that
    repeat are scanned each, other columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan, f"id {kind}, {SCHEMA}")
    return found.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mark``; overlapping spans by one."""
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_blocks(batch.column(where), BLOCK_BYTES):
                out = []
                for t in (None if t is None else t.decode("utf-8", "replace") for t in texts):
                    parts, at, last = [], 0, -1
                    for a, b, _ in scan(t or ""):
                        if a >= last:
                            parts += [t[at:a], mark]
                        at = last = max(b, last)
                    out.append("".join(parts) + t[at:] if parts else t)
                field = batch.schema.field(where)
                yield batch.slice(low, high - low).set_column(where, field, pa.array(out, field.type))

    return docs.mapInArrow(run, docs.schema)
