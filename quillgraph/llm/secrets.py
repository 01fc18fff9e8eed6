"""Secret scan with structural confirmation.

Three textual kinds are reported by their patterns alone (``assign``,
``access``, ``hex``). All further candidates are decoded from base64 or hex and
reported only when the bytes have the structure of a secret:

* ``pem``   an armoured private key whose body decodes to a key, or that is
            declared as encrypted; also such an armour inside a base64 run,
* ``der``   a private key in ASN.1: every nested length must add up, and the
            members must be those of PKCS#1, SEC1, DSA, PKCS#8 (whose octet
            string must hold a key of the algorithm that it names) or an
            encrypted PKCS#8 container (which must name a password-based
            cipher; so no digest, signature or public key is reported),
* ``ssh``   an OpenSSH private key container, with its length-prefixed fields,
* ``token`` a signed token: header and payload are JSON objects and the header
            names its algorithm.

A run of base64 or hex characters goes on over line breaks (also written as a
backslash and n) with blanks around them. Every line of it that begins like a
secret is tried, and after a confirmed one the scan goes on where that ends.

Defined results: a null or empty text has no spans; overlapping spans of
different kinds are all reported; repeated rows and null ids each keep their
own row; a text is scanned whole whatever its length. Positions count code
points, the end is exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import table

#: In the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "token")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----(.*?)-----END \1-----", re.DOTALL)
_SIGNED = re.compile(r"(?<![A-Za-z0-9_.-])(ey[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_SSH_MAGIC = b"openssh-key-v1\x00"


def _unbase64(body: str) -> bytes | None:
    body = body.replace("-", "+").replace("_", "/").rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class Coding(NamedTuple):
    here: re.Pattern  # what begins like an encoded secret
    run: re.Pattern
    piece: re.Pattern
    bits: int  # of a character
    group: int  # so many characters are ``size`` bytes
    size: int
    padding: re.Pattern
    bytes_of: Callable[[str], bytes | None]

    @classmethod
    def of(cls, chars: str, prefixes: str, *rest) -> Coding:
        more = rf"(?:[\x20\t]*(?:\r?\n|\\n)[\x20\t]*{chars}+)*"
        return cls(re.compile(f"(?:{prefixes}){chars}{{30}}"), re.compile(f"{chars}+{more}"), re.compile(f"{chars}+"), *rest)


_CODINGS = (
    Coding.of("[A-Za-z0-9+/_-]", "M[A-P]|b3BlbnNzaC1r|LS0tLS1C", 6, 4, 3, re.compile("={0,2}"), lambda s: _unbase64(s[: len(s) - (len(s) % 4 == 1)])),
    Coding.of("[0-9A-Fa-f]", "30|6[Ff]70656[Ee]737368|(?:2[Dd]){5}42", 4, 2, 1, re.compile(""), lambda s: bytes.fromhex(s[: len(s) // 2 * 2])),
)


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the ASN.1 element at ``at``; None if its length does not fit."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= end else None


def _members(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All elements between ``at`` and ``end``; None unless they fill it exactly."""
    found = []
    while at < end:
        one = _element(data, at, end)
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


#: Object identifiers as ASN.1 has them.
_RSA, _RSA_PSS = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a")
_EC = bytes.fromhex("2a8648ce3d0201")
_INTEGER_KEYS = tuple(map(bytes.fromhex, ("2a8648ce380401", "2a864886f70d010301", "2a8648ce3e0201")))  # DSA, DH, X9.42 DH
_RAW_KEYS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}  # X25519, X448, Ed25519, Ed448
_SEALED = tuple(map(bytes.fromhex, ("2a864886f70d0105", "2a864886f70d010c01")))  # password-based encryption of PKCS#5 and PKCS#12 begins with these


def _number(data: bytes, part: tuple[int, int, int]) -> int | None:
    """A version number."""
    return data[part[1]] if part[2] - part[1] == 1 else None


def _one(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """The element that fills ``at`` to ``end``."""
    found = _element(data, at, end)
    return found if found and found[2] == end else None


def _is_rsa(data: bytes, parts: list) -> bool:
    tags = [p[0] for p in parts]
    return tags[:9] == [0x02] * 9 and (len(tags), _number(data, parts[0])) in ((9, 0), (9, 1)) or tags == [0x02] * 9 + [0x30] and _number(data, parts[0]) == 1


def _is_sec1(data: bytes, parts: list, bare: bool) -> bool:
    """``bare``: a key that stands alone names its curve or public key; inside PKCS#8 it need not."""
    tags = [p[0] for p in parts]
    if tags[:2] != [0x02, 0x04] or _number(data, parts[0]) != 1 or tags[2:] not in ([], [0xA0], [0xA1], [0xA0, 0xA1]) or bare and not tags[2:]:
        return False
    inner = {tag: _one(data, a, b) for tag, a, b in parts[2:]}
    return all(x and x[0] in ((0x06, 0x30) if tag == 0xA0 else (0x03,)) for tag, x in inner.items())


def _is_inner(data: bytes, identifier: bytes, at: int, end: int) -> bool:
    """Is the content of a PKCS#8 octet string a key of the algorithm?"""
    found = _one(data, at, end)
    if found is None:
        return False
    tag, a, b = found
    if identifier in _INTEGER_KEYS:
        return tag == 0x02
    if identifier in _RAW_KEYS:
        return tag == 0x04 and b - a == _RAW_KEYS[identifier]
    if identifier in (_RSA, _RSA_PSS, _EC):
        parts = _members(data, a, b) if tag == 0x30 else None
        return bool(parts) and (_is_sec1(data, parts, bare=False) if identifier == _EC else _is_rsa(data, parts))
    return tag in (0x02, 0x04) or tag == 0x30 and bool(_members(data, a, b))  # an algorithm unknown here: one whole element


def key_length(data: bytes, at: int = 0) -> int | None:
    """Bytes of the private key that begins at ``at``, or None."""
    outer = _element(data, at, len(data))
    if outer is None or outer[0] != 0x30:
        return None
    parts = _members(data, outer[1], outer[2])
    if not parts:
        return None
    tags = [p[0] for p in parts]
    found = _is_rsa(data, parts) or tags == [0x02] * 6 and _number(data, parts[0]) == 0 or _is_sec1(data, parts, bare=True)
    if not found and tags[:3] == [0x02, 0x30, 0x04] and _number(data, parts[0]) in (0, 1) and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        algorithm = _members(data, *parts[1][1:])
        found = bool(algorithm) and algorithm[0][0] == 0x06 and _is_inner(data, data[algorithm[0][1] : algorithm[0][2]], *parts[2][1:])
    if not found and tags == [0x30, 0x04] and parts[1][2] > parts[1][1]:
        algorithm = _members(data, *parts[0][1:])
        found = bool(algorithm) and [a[0] for a in algorithm] == [0x06, 0x30] and data.startswith(_SEALED, algorithm[0][1], algorithm[0][2]) and _members(data, *algorithm[1][1:]) is not None
    return outer[2] - at if found else None


def ssh_length(data: bytes, begin: int = 0) -> int | None:
    """Bytes of the OpenSSH container that begins at ``begin``, or None."""
    if not data.startswith(_SSH_MAGIC, begin):
        return None
    at = begin + len(_SSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    cipher, kdf, options = field(), field(), field()
    if not cipher or not kdf or options is None or at + 4 > len(data):
        return None
    n = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= n <= 16 or any(field() is None for _ in range(n)) or not field():
        return None
    return at - begin


def _json_object(part: str) -> dict | None:
    raw = _unbase64(part)
    try:
        out = json.loads(raw) if raw is not None else None
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def _armoured(body: str) -> bool:
    if "Proc-Type:" in body and "ENCRYPTED" in body:
        return True
    raw = _unbase64("".join(body.replace("\\n", "\n").split()))
    return raw is not None and (key_length(raw) is not None or ssh_length(raw) is not None)


class _Run:
    """A run of encoded characters from ``begin`` on, decoded once for each place in a group at which a candidate can begin."""

    def __init__(self, text: str, begin: int, coding: Coding):
        self.coding, self.end = coding, coding.run.match(text, begin).end()
        self.begins, self.places, parts, n = [], [], [], 0
        for p in coding.piece.finditer(text[begin : self.end].replace("\\n", "  ")):
            self.begins.append(n)
            self.places.append(begin + p.start())
            parts.append(p[0])
            n += len(p[0])
        self.body = "".join(parts)
        self.starts = [b for b, at in zip(self.begins, self.places, strict=True) if coding.here.match(text, at)]
        self.made: dict[int, tuple] = {}

    def place(self, k: int) -> int:
        """Where the run's character ``k`` stands in the text."""
        i = bisect_right(self.begins, k) - 1
        return self.places[i] + k - self.begins[i]

    def decoded(self, shift: int) -> tuple[bytes | None, list[tuple[int, int]]]:
        """The bytes from character ``shift`` on, and the spans of confirmed armours in them."""
        if shift not in self.made:
            raw = self.coding.bytes_of(self.body[shift:])
            found = _PEM.finditer(raw.decode("latin-1")) if raw and b"PRIVATE KEY-----" in raw else ()
            self.made[shift] = raw, [x.span() for x in found if _armoured(x[2])]
        return self.made[shift]

    def secret(self, k: int) -> tuple[int, str] | None:
        """Characters and kind of the secret that begins at character ``k``. The lengths in its bytes say where it ends."""
        shift = k % self.coding.group
        raw, armours = self.decoded(shift)
        if raw is None:
            return None
        byte = lambda c: (c - shift) // self.coding.group * self.coding.size
        at = byte(k)
        chars = lambda n: -(-n * 8 // self.coding.bits)
        for kind, length in (("der", key_length(raw, at)), ("ssh", ssh_length(raw, at))):
            if length is not None:
                return chars(length), kind
        armours = [x for x in armours if x[0] >= at]
        if not armours:
            return None
        end = armours[0][1]
        for a, b in armours[1:]:  # those of one encoded file are one span; a later candidate has its own
            if any(end <= byte(c) <= a for c in self.starts if c % self.coding.group == shift):
                break
            end = b
        return chars(re.compile(rb"[\x20\t\r\n]*").match(raw, end).end() - at), "pem"


def _encoded(text: str, coding: Coding) -> list[tuple[int, int, str]]:
    """The spans and kinds of all encoded secrets."""
    found, at = [], 0
    while m := coding.here.search(text, at):
        at = m.start()
        if at and coding.piece.match(text, at - 1, at) and not text.endswith("\\n", 0, at):  # amid other characters
            at += 1
            continue
        run = _Run(text, at, coding)
        todo, done = list(reversed(run.starts)), 0
        while todo:
            k = todo.pop()
            if k < done or (hit := run.secret(k)) is None:
                continue
            done = k + hit[0]
            end = run.place(done - 1) + 1
            found.append((run.place(k), coding.padding.match(text, end).end(), hit[1]))
            if done < len(run.body) and coding.here.match(text, run.place(done)):
                todo.append(done)
        at = run.end
    return found


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start and then in the order of KINDS."""
    if not text:
        return []
    found = []
    folded = text.lower()
    if any(w in folded for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), m.end(), "pem") for m in _PEM.finditer(text) if _armoured(m[2])]
    for coding in _CODINGS:
        found += _encoded(text, coding)
    if "ey" in text:
        for m in _SIGNED.finditer(text):
            header = _json_object(m[1])
            if header and isinstance(header.get("alg"), str) and _json_object(m[2]) is not None and (m[3] or header["alg"].lower() == "none"):
                found.append((m.start(), m.end(), "token"))
    return sorted(set(found), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in find_secrets(t)] for t in texts], dtype=object)


def redacted(text: str | None, mark: str = "[secret]") -> str | None:
    """``text`` with each maximal run of overlapping spans replaced by ``mark``; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, _ in find_secrets(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def _redacted(texts: pd.Series) -> pd.Series:
    return pd.Series([redacted(t) for t in texts], dtype=object)


def _digest(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        spans = find_secrets(t)
        kinds = [k for *_, k in spans]
        listed = [f"{k}:{a}:{b}" for a, b, k in spans]
        base = ",".join(s for s, k in zip(listed, kinds, strict=True) if k in KINDS[:3])
        rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(base.encode()).hexdigest(), ",".join(listed)))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``secrets`` of spans (an input column of that name is replaced)."""
    return docs.withColumn("secrets", F.pandas_udf(_spans, "array<struct<kind:string,start:long,end:long>>")(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mark."""
    return docs.withColumn(text, F.pandas_udf(_redacted, "string")(F.col(text)))


def op2_secrets(spark, sf_dir) -> DataFrame:
    digest = F.pandas_udf(_digest, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    docs = table(spark, sf_dir, "documents").select("doc_id", digest(F.col("text")).alias("d"))
    return docs.select("doc_id", "d.*")
