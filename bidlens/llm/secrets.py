"""Secret scans: pattern spans, and encoded keys and signed tokens that hold together when decoded and parsed."""

from __future__ import annotations

import base64
import binascii
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passes, runs

#: Kinds in the order in which spans of one start are listed. The first three are patterns, the others are confirmed.
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
BASE = KINDS[:3]
SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"

# What the pattern kinds look for.
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

# Bytes of a signature by algorithm (least, most), as RFC 7518 and RFC 8037 give them.
SIGNATURES = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114)} | {f"{k}{n}": (128, 2048) for k in ("RS", "PS") for n in (256, 384, 512)}
SSH_MAGIC = b"openssh-key-v1\0"
#: Object identifier of password-based encryption (1.2.840.113549.1.5), the start of what an encrypted key's scheme has.
PBE = bytes.fromhex("2a864886f70d0105")
#: Bytes of the largest key that is looked for.
MOST_KEY = 1 << 16

SEQUENCE, INTEGER, OCTETS, OID, CONTEXT0, CONTEXT1 = 0x30, 0x02, 0x04, 0x06, 0xA0, 0xA1


def _table(*ranges: str) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[ord(r[0]) : ord(r[-1]) + 1] = True
    return out


LOWER_HEX = _table("0-9", "a-f")
ANY_HEX = _table("0-9", "a-f", "A-F")
RUN = _table("0-9", "a-z", "A-Z", "+", "/", "_", "-")


# -- structures -------------------------------------------------------------------------------


def header(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, first byte, end) of the value that begins at `at` in DER: a definite length in its shortest form. The end may
    lie beyond the data."""
    if at + 2 > len(data):
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or at + width > len(data):
            return None
        n, at = int.from_bytes(data[at : at + width], "big"), at + width
        if n < 0x80 or n >> (8 * (width - 1)) == 0:
            return None
    return tag, at, at + n


def children(data: bytes) -> list[tuple[int, bytes]] | None:
    """The values side by side in data, if they fill it exactly."""
    out, at = [], 0
    while at < len(data):
        h = header(data, at)
        if h is None or h[2] > len(data):
            return None
        out.append((h[0], data[h[1] : h[2]]))
        at = h[2]
    return out


def _whole(data: bytes) -> list[tuple[int, bytes]] | None:
    """What the one sequence that data consists of holds."""
    h = header(data)
    return children(data[h[1] :]) if h and h[0] == SEQUENCE and h[2] == len(data) else None


def _number(b: bytes) -> bool:
    """An integer, not negative, in its shortest form."""
    return bool(b) and b[0] < 0x80 and (len(b) == 1 or b[0] != 0 or b[1] >= 0x80)


def _nested(b: bytes) -> bool:
    """One value that fills b; a sequence's own values must fill it too."""
    h = header(b)
    return h is not None and h[2] == len(b) and (h[0] == OCTETS or h[0] == INTEGER or (h[0] == SEQUENCE and children(b[h[1] :]) is not None))


def private_key(data: bytes) -> bool:
    """Whether data is exactly one private key in DER: RSA or DSA numbers, an elliptic curve's, a wrapped or an encrypted key.
    Certificates and public keys are none."""
    parts = _whole(data)
    if not parts:
        return False
    tags, first = [t for t, _ in parts], parts[0][1]
    if tags[0] == INTEGER and len(first) == 1:
        numbers = all(t == INTEGER and _number(b) for t, b in parts)
        if first in (b"\0", b"\1") and tags[:9] == [INTEGER] * 9 and all(_number(b) for _, b in parts[:9]) and (len(tags) == 9 or tags[9:] == [SEQUENCE]):
            return len(parts[1][1]) >= 64
        if first == b"\0" and len(tags) == 6 and numbers:
            return len(parts[1][1]) >= 64 and len(parts[2][1]) >= 20
        if first == b"\1" and tags[1:2] == [OCTETS] and 16 <= len(parts[1][1]) <= 66 and all(t in (CONTEXT0, CONTEXT1) for t in tags[2:]):
            return all(_nested_context(b) for _, b in parts[2:])
        if first in (b"\0", b"\1") and tags[1:3] == [SEQUENCE, OCTETS] and all(t in (CONTEXT0, 0x81, CONTEXT1) for t in tags[3:]):
            scheme = children(parts[1][1])
            return bool(scheme) and scheme[0][0] == OID and len(parts[2][1]) >= 16 and _nested(parts[2][1])
        return False
    if tags == [SEQUENCE, OCTETS]:
        scheme = children(first)
        return bool(scheme) and scheme[0][0] == OID and scheme[0][1].startswith(PBE) and len(parts[1][1]) >= 16
    return False


def _nested_context(b: bytes) -> bool:
    inner = children(b)
    return inner is not None and len(inner) == 1


def ssh_key_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH private key at the start of data, by its nested lengths; None if they don't hold together."""
    if not data.startswith(SSH_MAGIC):
        return None
    at = len(SSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    cipher, kdf, options = field(), field(), field()
    if not cipher or not kdf or options is None or (cipher == b"none") != (kdf == b"none"):
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return None
    for _ in range(keys):
        public = field()
        # a public part is fields in turn, the first of which names the algorithm
        if not public or not 4 <= int.from_bytes(public[:4], "big") <= len(public) - 4 or not public[4:8].isascii():
            return None
    private = field()
    if not private or len(private) % 8:
        return None
    return at if cipher != b"none" or private[:4] == private[4:8] else None


def signed_token(head: bytes, body: bytes, sign: bytes) -> bool:
    """Whether three base64url parts are a signed token: a JSON header that names an algorithm, a JSON object, and a signature
    of as many bytes as the algorithm gives."""
    try:
        h, claims, s = (base64.urlsafe_b64decode(p + b"=" * (-len(p) % 4)) for p in (head, body, sign))
        known = json.loads(h)
        least, most = SIGNATURES[known["alg"]]
        return least <= len(s) <= most and isinstance(json.loads(claims), dict)
    except (ValueError, KeyError, TypeError, RecursionError):
        return False


# -- candidates -------------------------------------------------------------------------------


_LINE = re.compile(rb"[A-Za-z0-9+/_-]+")
_BREAK = re.compile(rb"(?:\r?\n|\\r\\n|\\n)[ \t]*")


def gather(text: bytes, at: int, most: int) -> tuple[bytes, list[tuple[int, int]]]:
    """Up to `most` base64 digits from `at` on, over line breaks (also spelt `\\n`), and where each line's digits begin and end."""
    out, lines, size = [], [], 0
    while size < most and (m := _LINE.match(text, at)):
        end = min(m.end(), at + most - size)
        out.append(text[at:end])
        lines.append((at, end))
        size += end - at
        b = _BREAK.match(text, m.end())
        if end < m.end() or not b:
            break
        at = b.end()
    return b"".join(out), lines


def digits_end(text: bytes, lines: list[tuple[int, int]], digits: int) -> int:
    """The end of the digit of that number, and of the padding that completes its group."""
    for a, b in lines:
        if digits <= b - a:
            end = a + digits
            pad = -digits % 4
            return end + (pad if text[end : end + pad] == b"=" * pad else 0)
        digits -= b - a
    return lines[-1][1]


def decoded(digits: bytes) -> bytes:
    digits = digits.replace(b"-", b"+").replace(b"_", b"/")
    whole = digits[: len(digits) - len(digits) % 4]
    rest = digits[len(whole) :]
    return binascii.a2b_base64(whole) + (binascii.a2b_base64(rest + b"=" * (4 - len(rest))) if len(rest) > 1 else b"")


def key_at(text: bytes, at: int) -> tuple[str, int] | None:
    """Kind and end of the base64 key that begins at `at`: the key's own lengths tell how many digits it has."""
    lead = decoded(text[at : at + 20])
    if lead.startswith(SSH_MAGIC):
        digits, lines = gather(text, at, MOST_KEY * 4 // 3)
        n, kind = ssh_key_size(decoded(digits)), "ssh"
        if n is None:
            return None
    else:
        h = header(lead)
        if h is None or h[0] != SEQUENCE or not 32 <= h[2] <= MOST_KEY:
            return None
        n, kind = h[2], "der"
        digits, lines = gather(text, at, -(-n * 4 // 3))
        if len(digits) < -(-n * 4 // 3) or not private_key(decoded(digits)[:n]):
            return None
    return kind, digits_end(text, lines, -(-n * 4 // 3))


def wrapped_key(text: bytes, at: int) -> tuple[str, int] | None:
    """Kind and end of a base64 run whose bytes are a key file's text, with its dashes, around a key."""
    digits, lines = gather(text, at, MOST_KEY * 2)
    inner = decoded(digits)
    if not inner.startswith(b"-----BEGIN "):
        return None
    for m in re.finditer(rb"-----[\r\n]+", inner):
        found = key_at(inner, m.end())
        if found:
            return found[0], digits_end(text, lines, len(digits))
    return None


def confirmed(text: bytes, start: int, end: int) -> list[tuple[str, int, int]]:
    """The keys and tokens that begin in a run of base64 digits (either alphabet) of a text."""
    out = []
    if text[start : start + 16].startswith(b"LS0tLS1CRUdJTi"):  # `-----BEGIN`
        found = wrapped_key(text, start)
        if found:
            out.append((found[0], start, found[1]))
    elif end - start >= 40:
        found = key_at(text, start)
        if found:
            out.append((found[0], start, found[1]))
    return out


_DIGITS = re.compile(rb"[A-Za-z0-9_-]+")


def token_at(text: bytes, start: int, end: int) -> int | None:
    """The end of the signed token whose header is the run from start to end."""
    if text[start : start + 2] not in (b"ey", b"ew") or text[end : end + 1] != b".":
        return None
    body = _DIGITS.match(text, end + 1)
    sign = _DIGITS.match(text, body.end() + 1) if body and text[body.end() : body.end() + 1] == b"." else None
    return sign.end() if sign and signed_token(text[start:end], body.group(), sign.group()) else None


def spans_of(text: bytes, hexes: list[tuple[int, int]], wide: list[tuple[int, int]], coded: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) in bytes, in order: hexes and wide are the text's runs of hexadecimal digits (lower case; any),
    coded those of base64 digits."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= LEAST["assign"]]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(a, 2, b) for a, b in hexes]
    for a, b in coded:
        if text[a - 1 : a + 1] in (b"\\n", b"\\r", b"\\t"):  # an escaped line break before the run
            a += 1
        token = token_at(text, a, b)
        if token:
            out.append((a, KINDS.index("jwt"), token))
        out += [(p, KINDS.index(kind), q) for kind, p, q in confirmed(text, a, b)]
    for a, b in wide:
        data = bytes.fromhex(text[a : b - (b - a) % 2].decode())
        h = header(data)
        if h and 32 <= h[2] <= len(data) and private_key(data[: h[2]]):
            out.append((a, KINDS.index("der"), a + 2 * h[2]))
    return sorted(out)


# -- the scan ---------------------------------------------------------------------------------


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and its secrets' spans, of each row of docs (doc_id, text) that has an id; offsets are in code points, ends exclusive.

    Patterns: assignments to a name of a secret (a value of 12 characters or more), access keys (18 or more) and lower-case
    hexadecimal runs (16 or more), leftmost and not overlapping within a kind. Confirmed by structure: base64 (either
    alphabet, over line breaks) or hexadecimal runs that decode to a private key whose nested lengths fit to the last
    byte (`der`, `ssh`), and signed tokens (`jwt`) with a readable header, claims and a signature of the right
    size. Runs that only look like keys, public keys and certificates give no span. Texts are scanned whole; a null text has
    none. No shuffle; a task holds half a megabyte of text or one longer text."""

    def look(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, off, data in passes(batch.column(1)):
                found = {}
                for name, table, least in (("hex", LOWER_HEX, LEAST["hex"]), ("wide", ANY_HEX, 64), ("coded", RUN, 16)):
                    start, end = runs(data, off, table, least)
                    doc = np.searchsorted(off, start, "right") - 1
                    for d, a, b in zip(doc.tolist(), (start - off[doc]).tolist(), (end - off[doc]).tolist(), strict=True):
                        found.setdefault(d, {}).setdefault(name, []).append((a, b))
                rows = []
                for d in range(len(off) - 1):
                    raw, f = data[off[d] : off[d + 1]], found.get(d, {})
                    spans = spans_of(raw.tobytes(), f.get("hex", []), f.get("wide", []), f.get("coded", []))
                    if spans:
                        place = np.cumsum((raw & 0xC0) != 0x80) if (raw & 0x80).any() else None
                        at = (lambda i, place=place: i if place is None else int(place[i - 1]) if i else 0)
                        spans = [{"kind": KINDS[k], "start": at(a), "end": at(b)} for a, k, b in spans]
                    rows.append(spans)
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(rows)), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(look, SPANS)


def listed(spans, kinds=None):
    """Spans as `kind:start:end`, joined by commas."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark, sf_dir) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(listed(F.col("spans"), BASE), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
