"""Secrets in texts: plain patterns, and encoded ones whose structure confirms them.

Plain matches are reported as they are.  Beyond them, stretches that may be
base64 or hex are decoded, and only what parses is reported: private keys
whose nested lengths fill the whole (DER of several kinds, the OpenSSH
container, OpenPGP packets), signed tokens whose header and claims are JSON
objects and whose signature has its algorithm's length, and encoded text
that holds a secret itself.  Public keys, certificates, digests, pictures
and chance matches aren't.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import arrow_rows

#: Plain kinds, then those that decoding confirms: a key, a signed or encrypted token, encoded text with a secret in it.
PLAIN = ("assign", "access", "hex")
KINDS = (*PLAIN, "key", "signed", "encoded")
#: Codings inside codings that are opened.
DEPTH = 3

Span = tuple[str, int, int]

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")


def plain_spans(text: str) -> list[Span]:
    """Matches of the plain patterns, leftmost and non-overlapping per kind, by start, then kind."""
    found = [(0, *m.span()) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(2, *m.span()) for m in _HEX.finditer(text)]
    return [(PLAIN[k], a, b) for k, a, b in sorted(found, key=lambda s: (s[1], s[0]))]


# -- key encodings ----------------------------------------------------------
# Tags of ASN.1.
_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE, _CONTEXT0 = 0x02, 0x03, 0x04, 0x06, 0x30, 0xA0
#: Elements of a sequence that are looked at; the longest key has nine.
_ELEMENTS = 64


def elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill ``data[start:end]`` exactly, in definite lengths; None if none do."""
    out = []
    while start < end and len(out) < _ELEMENTS:
        if start + 2 > end:
            return None
        tag, size = data[start], data[start + 1]
        start += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or start + n > end:
                return None
            size = int.from_bytes(data[start : start + n], "big")
            if size < 0x80 or size >> 8 * (n - 1) == 0:  # a shorter form would do
                return None
            start += n
        if start + size > end:
            return None
        out.append((tag, start, start + size))
        start += size
    return out if start == end else None


def _is_der_key(data: bytes) -> bool:
    """A private key in DER: PKCS#1, PKCS#8 plain or encrypted, SEC 1, DSA or a PKCS#12 store."""
    outer = elements(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return False
    inner = elements(data, *outer[0][1:])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]

    def within(k: int) -> list[int]:
        return [t for t, _, _ in elements(data, *inner[k][1:]) or []]

    if tags == [_SEQUENCE, _OCTETS]:  # encrypted PKCS#8: an algorithm with parameters, and the ciphertext
        return within(0) == [_OID, _SEQUENCE] and inner[1][2] - inner[1][1] >= 16
    if tags[0] != _INTEGER or inner[0][2] - inner[0][1] != 1:
        return False
    version, rest = data[inner[0][1]], tags[1:]
    long_enough = sum(b - a for _, a, b in inner) >= 24
    if rest == [_INTEGER] * 8 or rest == [_INTEGER] * 5:
        return version <= 1 and long_enough
    if rest[:2] == [_SEQUENCE, _OCTETS] and version <= 1:
        return within(1)[:1] == [_OID] and long_enough
    if rest[0] == _OCTETS and version == 1:
        return all(t in (_CONTEXT0, _CONTEXT0 + 1) for t in rest[1:]) and inner[1][2] - inner[1][1] >= 16
    return version == 3 and rest[0] == _SEQUENCE and within(1)[:1] == [_OID]


# Fixed value: the first bytes of an OpenSSH key file.
_OPENSSH = b"openssh-key-v1\0"


def _is_openssh_key(data: bytes) -> bool:
    """Cipher, derivation and its options, a number of keys, public keys and the private part, each by its length."""
    at = len(_OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if not data.startswith(_OPENSSH) or not all(field() is not None for _ in range(3)):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16 or not all(field() for _ in range(keys)):
        return False
    return bool(field()) and at == len(data)


# Numbers of OpenPGP's public-key algorithms.
_PGP_ALGORITHMS = (1, 2, 3, 16, 17, 18, 19, 22, 25, 26, 27, 28)


def _is_pgp_key(data: bytes) -> bool:
    """OpenPGP packets that fill the whole, the first a secret key of a known version."""
    at, first = 0, True
    while at < len(data):
        head = data[at]
        if not head & 0x80 or at + 2 > len(data):
            return False
        at += 1
        if head & 0x40:  # new form
            tag, one = head & 0x3F, data[at]
            n, size = (1, one) if one < 192 else (2, (one - 192 << 8) + int.from_bytes(data[at + 1 : at + 2], "big") + 192) if one < 224 else (5, int.from_bytes(data[at + 1 : at + 5], "big"))
        else:
            tag, kind = head >> 2 & 15, head & 3
            if kind == 3:
                return False
            n = 1 << kind
            size = int.from_bytes(data[at : at + n], "big")
        at += n
        if at + size > len(data) or (first and (tag != 5 or size < 24 or data[at] not in (4, 5, 6) or data[at + 5] not in _PGP_ALGORITHMS)):
            return False
        at, first = at + size, False
    return not first


def is_private_key(data: bytes) -> bool:
    return _is_der_key(data) or _is_openssh_key(data) or _is_pgp_key(data)


# -- signed tokens ----------------------------------------------------------
# Bytes of a signature by algorithm, or the least of them.
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "ES256K": 64}
_LEAST_SIGNATURE = {"RS256": 128, "RS384": 128, "RS512": 128, "PS256": 128, "PS384": 128, "PS512": 128, "EdDSA": 64}


def _url_decoded(part: str) -> bytes | None:
    if len(part) % 4 == 1:
        return None
    try:
        return base64.b64decode(part + "=" * (-len(part) % 4), altchars=b"-_", validate=True)
    except binascii.Error:
        return None


def _json_object(data: bytes | None) -> dict | None:
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def signed_parts(token: str) -> int:
    """How many dotted parts of ``token`` make a JSON web token: three of a signed one, five of an encrypted one, else 0.

    The header must name an algorithm, the claims be an object and the
    signature have that algorithm's length.
    """
    parts = token.split(".")
    header = _json_object(_url_decoded(parts[0]))
    algorithm = header.get("alg") if header else None
    if not isinstance(algorithm, str):
        return 0
    if len(parts) >= 5 and isinstance(header.get("enc"), str):
        return 5 * (all(_url_decoded(p) is not None for p in parts[1:5]) and bool(parts[3]))
    signature = _url_decoded(parts[2]) if len(parts) >= 3 else None
    if signature is None or _json_object(_url_decoded(parts[1])) is None:
        return 0
    if algorithm in _SIGNATURE:
        return 3 * (len(signature) == _SIGNATURE[algorithm])
    return 3 * (len(signature) >= _LEAST_SIGNATURE.get(algorithm, 16))


# -- candidates -------------------------------------------------------------
# All of these read a text in linear time: a repeat starts only where its run starts and never gives back.
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]*+){2,4}+")
_ARMOUR = re.compile(r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----")
_CLOSE = re.compile(r"-----END (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----")
_BREAK = r"(?:\r?\n|\\r\\n|\\n)"
#: Lines of one text of base64, with breaks of a file or of a string literal.
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{{60,76}}+(?:{_BREAK}[ \t]{{0,16}}[A-Za-z0-9+/]{{1,76}}+={{0,2}})++")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
_HEX_CODED = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32,}+(?![0-9A-Fa-f])")
_LINE = re.compile(rf"(?:^|{_BREAK})[ \t]*([A-Za-z0-9+/]+={{0,2}})")
_BLANKS = re.compile(r"\\r\\n|\\n|\s+")
_ENCRYPTED_PEM = re.compile(r"Proc-Type: 4,ENCRYPTED\s+DEK-Info: [A-Z0-9-]{1,32},[0-9A-Fa-f]{16,64}\s+")
_HEADER_LINE = re.compile(r"(?:[A-Za-z-]{1,32}: [^\n]{0,256}\n)*\s*")


def _from_base64(text: str) -> bytes | None:
    """Base64 of either alphabet, padded or not."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _is_armoured(body: str) -> bool:
    """What stands between the two lines of an armour."""
    encrypted = _ENCRYPTED_PEM.search(body)
    if encrypted:
        data = _from_base64(_BLANKS.sub("", body[encrypted.end() :]))
        return data is not None and len(data) >= 48 and len(data) % 8 == 0
    body = _BLANKS.sub("", body[_HEADER_LINE.match(body.lstrip("\n")).end() if ": " in body else 0 :])
    data = _from_base64(re.sub(r"=[A-Za-z0-9+/]{4}$", "", body))  # without the checksum of OpenPGP
    return data is not None and is_private_key(data)


def _holds(data: bytes | None, depth: int) -> str | None:
    """What decoded bytes turn out to be: a kind, or None."""
    if not data or len(data) < 12:
        return None
    if is_private_key(data):
        return "key"
    if depth >= DEPTH or 0 in data[:64]:
        return None
    try:
        inner = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if sum(c.isprintable() or c in "\r\n\t" for c in inner) < len(inner):
        return None
    # digits of a decoded digest are no secret: hex counts in the open only
    if any(kind != "hex" for kind, _, _ in plain_spans(inner)) or any(True for _ in confirmed_spans(inner, depth + 1)):
        return "encoded"
    return None


def _lines(text: str, start: int, end: int) -> Iterator[tuple[str, int]]:
    """Base64 on several lines as one string, and where it ends: lines of one length with a shorter last one, or without it."""
    found = [(m.start(1) + start, m.end(1) + start) for m in _LINE.finditer(text[start:end])]
    wide = found[0][1] - found[0][0]
    full = next((k for k, (a, b) in enumerate(found) if b - a != wide), len(found))
    for n in (full + 1, full):
        if 2 <= n <= len(found) and found[n - 1][1] - found[n - 1][0] <= wide:
            yield "".join(text[a:b] for a, b in found[:n]), found[n - 1][1]


def _armours(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while (opened := _ARMOUR.search(text, at)) and (closed := _CLOSE.search(text, opened.end())):
        again = text.rfind("-----BEGIN ", opened.end(), closed.start())
        if again < 0:
            if _is_armoured(text[opened.end() : closed.start()]):
                yield opened.start(), closed.end()
        elif _ARMOUR.match(text, again):  # one that was never closed; this one is
            at = again
            continue
        at = closed.end()


def confirmed_spans(text: str, depth: int = 0) -> Iterator[Span]:
    """Spans of encoded secrets that their structure confirms, none inside an earlier one."""
    starts: list[int] = []
    ends: list[int] = []

    def free(a: int, b: int) -> bool:
        k = bisect_right(starts, a) - 1
        return k < 0 or ends[k] < b

    def take(kind: str, a: int, b: int) -> Span:
        k = bisect_right(starts, a)
        starts.insert(k, a)
        ends.insert(k, b)
        return kind, a, b

    if "PRIVATE KEY" in text:
        for a, b in _armours(text):
            yield take("key", a, b)
    for m in _SIGNED.finditer(text):
        if (n := signed_parts(m[0])) and free(*m.span()):
            yield take("signed", m.start(), m.start() + len(".".join(m[0].split(".")[:n])))
    for m in _WRAPPED.finditer(text):
        for joined, end in _lines(text, *m.span()):
            if free(m.start(), end) and (kind := _holds(_from_base64(joined), depth)):
                yield take(kind, m.start(), end)
                break
    for m in _BASE64.finditer(text):
        if free(*m.span()) and (kind := _holds(_from_base64(m[0]), depth)):
            yield take(kind, *m.span())
    for m in _HEX_CODED.finditer(text):
        if (m.end() - m.start()) % 2 == 0 and free(*m.span()) and (kind := _holds(bytes.fromhex(m[0]), depth)):
            yield take(kind, *m.span())


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans, each by start, then kind, then end; null is empty."""
    plain = plain_spans(text or "")
    return plain, sorted({*plain, *confirmed_spans(text or "")}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spans(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, plain, spans)``, arrays of ``(kind, start, end)``.

    Spans are code points, end exclusive.  Null and empty texts have none;
    very long texts are read whole, in linear time; repeated rows are
    answered each; null ids stay null; other columns are not read.
    """

    def rows(ids, texts):
        for i, t in zip(ids, texts, strict=True):
            yield i, *([{"kind": k, "start": a, "end": b} for k, a, b in s] for s in find(t))

    span = "array<struct<kind:string,start:long,end:long>>"
    return arrow_rows(docs, [id_col, "text"], f"{id_col} {docs.schema[id_col].dataType.simpleString()}, plain {span}, spans {span}", rows)
