"""Operator 2: secret scans with structural confirmation."""

from __future__ import annotations

import base64
import binascii
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # whole runs; a shorter run holds no longer match
HEX = re.compile(r"[0-9a-f]{32,}")
FRAME = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
DEK = re.compile(r"(?i:DEK-Info:)[\x20\t]*([A-Za-z0-9-]+),[\x20\t]*([0-9A-Fa-f]+)\s*\Z")
#: The first of three parts, which may begin any JSON object: with a brace or with blanks before it.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(?=[CDIe])([A-Za-z0-9_-]{14,}+)(?=\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*+))")
#: Encodings in encodings are followed so deep.
DEPTH = 2
#: 19 and 28 characters are the least that hold `token=` and eight more, the shortest text that confirmed() takes.
B64 = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")
ANYHEX = re.compile(r"[0-9a-fA-F]{28,}")
#: Runs on lines that follow each other.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++=*+(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++=*+)++")
PIECE = re.compile(r"[A-Za-z0-9+/_-]+=*")

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem_key", "der_key", "ssh_key", "signed_token", "encoded_secret")


def unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the element at `at`; None if its length does not fit."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def der_key(data: bytes) -> bool:
    """An outer sequence that fills the data, whose parts fill it in turn as in a PKCS#1, PKCS#8 or SEC1 private key."""
    outer = der(data, 0, len(data))
    if not outer or outer[0] != 0x30 or outer[2] != len(data) or len(data) < 32:
        return False
    parts, at = [], outer[1]
    while at < outer[2]:
        part = der(data, at, outer[2])
        if not part:
            return False
        parts.append(part)
        at = part[2]
    tags = [t for t, _, _ in parts]
    if tags == [0x30, 0x04]:  # encrypted PKCS#8: an algorithm and its data
        oid = der(data, parts[0][1], parts[0][2])
        return oid is not None and oid[0] == 0x06 and parts[1][2] - parts[1][1] >= 16
    if len(parts) < 2 or tags[0] != 0x02:
        return False
    version = data[parts[0][1] : parts[0][2]]
    rsa = version in (b"\0", b"\1") and len(parts) >= 9 and set(tags[:9]) == {0x02}
    dsa = version == b"\0" and tags == [0x02] * 6
    pkcs8 = version in (b"\0", b"\1") and tags[1:3] == [0x30, 0x04] and (oid := der(data, parts[1][1], parts[1][2])) is not None and oid[0] == 0x06
    sec1 = version == b"\1" and tags[1] == 0x04
    return bool(rsa or dsa or pkcs8 or sec1)


#: Names of ciphers begin so, and these are the key derivations of the container (fixed values).
SSH_CIPHERS = (b"none", b"aes", b"chacha20-poly1305", b"3des")
SSH_DERIVATIONS = (b"none", b"bcrypt")


def ssh_key(data: bytes) -> bool:
    """An openssh-key-v1 container: the names of a cipher and a key derivation, its options, a number of keys, and as many public keys and a private part."""
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    at, fields = 15, []

    def take():
        nonlocal at
        if at + 4 > len(data):
            return None
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        field = data[at + 4 : end] if end <= len(data) else None
        at = end
        return field

    for _ in range(3):
        fields.append(take())
    if None in fields or not fields[0].startswith(SSH_CIPHERS) or fields[1] not in SSH_DERIVATIONS or at + 4 > len(data):
        return False
    many = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= many <= 16 and all(take() for _ in range(many + 1))


def signed(head: str, body: str) -> bool:
    raw = unbase64(head)
    try:
        fields = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return False
    return isinstance(fields, dict) and isinstance(fields.get("alg"), str) and unbase64(body) is not None


def confirmed(data: bytes | None, depth: int = DEPTH) -> str | None:
    """What data is: a key by its structure, or a text that holds a secret, itself encoded or not."""
    if not data:
        return None
    if der_key(data):
        return "der_key"
    if ssh_key(data):
        return "ssh_key"
    try:
        plain = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if plain.translate(BLANKS).isprintable() and any(KINDS[k] != "hex" for _, k, _ in find(plain, depth - 1)):
        return "encoded_secret"
    return None


BLANKS = str.maketrans("\t\r\n", "   ")


def pem_keys(text: str):
    """Places (start, end) of the PEM frames whose body parses as a private key."""
    begin = None
    for m in FRAME.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        else:
            if begin and begin[2] == m[2] and pem_body(text[begin.end() : m.start()]):
                yield begin.start(), m.end()
            begin = None


def pem_body(body: str) -> bool:
    """Base64 that parses as a key; or, below header lines that name a cipher, whole blocks of encrypted data. Line breaks and slashes may be escaped, as in JSON."""
    body = body.replace("\\r", "").replace("\\n", "\n").replace("\\/", "/")
    lines = body.strip().splitlines()
    head = [k for k, x in enumerate(lines) if ":" in x]
    if head:
        named = any(DEK.match(x.strip()) for x in lines[: head[-1] + 1])
        raw = unbase64("".join("".join(lines[head[-1] + 1 :]).split()))
        return bool(raw and (named and len(raw) >= 32 and len(raw) % 8 == 0 or der_key(raw) or ssh_key(raw)))
    raw = unbase64("".join(body.split()))
    return bool(raw and (der_key(raw) or ssh_key(raw)))


def wrapped(text: str):
    """Places of runs on lines that follow each other and may be one text that a tool has broken: lines of one width, with or without another first line and a shorter last one."""
    for m in WRAPPED.finditer(text):
        at = [(p.start(), p.end()) for p in PIECE.finditer(text, m.start(), m.end())]
        i = 0
        while i < len(at):
            j = i
            while j + 1 < len(at) and at[j + 1][1] - at[j + 1][0] == at[i][1] - at[i][0]:
                j += 1
            width = at[i][1] - at[i][0]
            tail = j + 1 < len(at) and at[j + 1][1] - at[j + 1][0] < width
            for a in (i - 1, i) if i else (i,):
                for b in (j, j + 1) if tail else (j,):
                    if b > a:
                        yield at[a : b + 1]
            i = j + 1


def find(text: str | None, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in order. What is encoded is looked into `depth` times."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    pem = list(pem_keys(text)) if "PRIVATE KEY" in text else []
    out += [(a, 3, b) for a, b in pem]
    out += [(m.start(), 6, m.end(3)) for m in SIGNED.finditer(text) if signed(m[1], m[2])]
    if not depth:
        return sorted(set(out))
    for m in B64.finditer(text):
        if kind := confirmed(unbase64(m[0]), depth):
            out.append((m.start(), KINDS.index(kind), m.end()))
    for m in ANYHEX.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := confirmed(bytes.fromhex(m[0]), depth)):
            out.append((m.start(), KINDS.index(kind), m.end()))
    for lines in wrapped(text):
        start, end = lines[0][0], lines[-1][1]
        if any(a <= start and end <= b for a, b in pem):
            continue
        run = "".join(text[a:b] for a, b in lines)
        kind = confirmed(unbase64(run), depth) if len(run) >= 19 else None
        if not kind and len(run) >= 28 and len(run) % 2 == 0 and ANYHEX.fullmatch(run):
            kind = confirmed(bytes.fromhex(run), depth)
        if kind:
            out.append((start, KINDS.index(kind), end))
    return sorted(set(out))


def scan_secrets(docs: DataFrame, text: str = "text", to: str = "secrets") -> DataFrame:
    """docs with `to`: an array of struct(kind, start, end), code points, end exclusive, by start and kind as in KINDS.

    The three base kinds come from patterns alone. All other candidates are decoded (base64 in either alphabet, hex)
    and reported only if what they hold parses: private keys by nested DER or length-prefixed fields that fill the
    data, signed tokens by a JSON header with an algorithm, encoded UTF-8 text by any of these inside, or an assign or an
    access key, themselves encoded or not, up to DEPTH times. PEM frames may stand in JSON, with escaped line breaks. Runs that a line break parts are joined too, if their lines are of one width but for the first and last. Null and empty texts
    have no spans. Every row is scanned whole, for itself; a column named like `to` is replaced.
    """

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t)] for t in texts])

    keep = without(docs, [to] if to.lower() != text.lower() else [])
    return keep.withColumn(to, of(F.col(text).cast("string")))


def redact(text: str | None, spans) -> str | None:
    """text with each merged span replaced by the name of the kind that begins it."""
    if text is None:
        return None
    out, at = [], 0
    for s in spans or []:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]
