"""Secret scan: patterns, then structural confirmation of encoded keys and signed tokens.

Base patterns report what they match. Base64 and hex runs are reported only if they decode to something with
the structure of a private key (DER with lengths that nest and fill their parents, or the
length-prefixed OpenSSH container), and dotted base64url runs only if they start with a JSON header of a signed token.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame, functions as F

from pitgrid.llm.common import find_package, map_rows

# fixed values: base patterns and the order of kinds
BASE = ("assign", "access", "hex")
CONFIRMED = ("jwt", "pem", "key64", "keyhex")
KINDS = BASE + CONFIRMED
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api")

_token = re.compile(r"(?<![A-Za-z0-9_-])e[w-z][A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_pem = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_pem_body = re.compile(r"(?:[A-Za-z0-9+/=:, \t\r\n-]|\\[rn])*?-----END ([A-Z0-9 ]*PRIVATE KEY)-----")
_b64 = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-P]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/]{30,}")
_b64_more = re.compile(r"[A-Za-z0-9+/=\r\n]*")
_hexrun = re.compile(r"(?<![0-9A-Fa-f])(?:30[0-9A-Fa-f]|6f70656e7373682d6b65792d7631)[0-9A-Fa-f]{60,}", re.A)
_MAGIC = b"openssh-key-v1\x00"


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER value at ``at``; None unless its length fits below ``end``."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        n = int.from_bytes(data[at : at + size], "big")
        if n < 0x80:
            return None
        at += size
    return (tag, at, at + n) if at + n <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Values that fill ``at``..``end`` without a gap."""
    found = []
    while at < end:
        v = _der(data, at, end)
        if v is None:
            return None
        found.append(v)
        at = v[2]
    return found


def _private_der(data: bytes) -> int:
    """Length of the DER private key at the start of ``data``; 0 if there is none."""
    outer = _der(data, 0, len(data))
    if outer is None or outer[0] != 0x30:
        return 0
    parts = _children(data, outer[1], outer[2])
    if not parts or len(parts) < 2:
        return 0
    tags = [p[0] for p in parts]
    first = data[parts[0][1] : parts[0][2]]
    if tags[0] == 2 and first == b"\x00" and len(parts) >= 6 and set(tags) == {2}:
        return outer[2]  # RSA or DSA integers
    if tags[0] == 2 and first in (b"\x00", b"\x01") and len(parts) >= 3 and tags[1] == 0x30 and tags[2] == 4:
        inner = _children(data, parts[1][1], parts[1][2])
        return outer[2] if inner and inner[0][0] == 6 else 0  # algorithm and wrapped key
    if tags[0] == 2 and first == b"\x01" and tags[1] == 4 and parts[1][2] - parts[1][1] >= 16:
        return outer[2]  # elliptic curve key
    if tags == [0x30, 4] and parts[1][2] - parts[1][1] >= 32:
        inner = _children(data, parts[0][1], parts[0][2])
        return outer[2] if inner and inner[0][0] == 6 else 0  # encrypted key
    return 0


def _openssh(data: bytes) -> int:
    """Length of the OpenSSH container at the start of ``data``; 0 if the nested lengths don't fit."""
    if not data.startswith(_MAGIC):
        return 0
    at = len(_MAGIC)

    def take(at: int) -> int:
        n = int.from_bytes(data[at : at + 4], "big")
        return at + 4 + n if at + 4 <= len(data) and at + 4 + n <= len(data) else -1

    for _ in range(3):  # cipher, key derivation, its options
        at = take(at)
        if at < 0:
            return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= keys <= 16:
        return 0
    at += 4
    for _ in range(keys + 1):  # public keys, then the private part
        at = take(at)
        if at < 0:
            return 0
    return at


def _key_bytes(data: bytes) -> int:
    return _private_der(data) or _openssh(data)


def _json_part(part: str) -> dict | None:
    try:
        value = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _jwt(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _token.finditer(text):
        header = _json_part(m.group().split(".", 1)[0])
        if header is not None and isinstance(header.get("alg"), str):
            out.append(("jwt", m.start(), m.end()))
    return out


def _decode(run: str) -> bytes:
    """Bytes of as many whole base64 groups as there are."""
    run = run.rstrip("=")
    run += "=" * (-len(run) % 4) if len(run) % 4 != 1 else ""
    try:
        return base64.b64decode(run[: len(run) // 4 * 4])
    except binascii.Error:
        return b""


def _pem_keys(text: str) -> list[tuple[str, int, int]]:
    out, free = [], 0
    begins = list(_pem.finditer(text))
    # a body ends before the next beginning, so no part of the text is read for two of them
    for m, limit in zip(begins, [*(n.start() for n in begins[1:]), len(text)], strict=True):
        if m.start() < free:
            continue
        body = _pem_body.match(text, m.end(), limit)
        if not body or body.group(1) != m.group(1):
            continue
        lines = re.split(r"[\r\n]+|\\r|\\n", body.group()[: body.group().rindex("-----END")])
        sealed = any(":" in x for x in lines)  # headers of an encrypted body
        data = _decode("".join("".join(x.split()) for x in lines if ":" not in x))
        if _key_bytes(data) or sealed and len(data) >= 32 and len(data) % 8 == 0:
            out.append(("pem", m.start(), body.end()))
            free = body.end()
    return out


def _base64_keys(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out, free, block = [], 0, 0
    taken = iter([*taken, ("", len(text), len(text))])
    _, begin, end = next(taken)
    for m in _b64.finditer(text):
        at = m.start()
        while at >= end:
            _, begin, end = next(taken)
        if at < free or begin <= at < end:
            continue
        if at >= block:  # end of the run of base64 lines that holds this place
            block = _b64_more.match(text, at).end()
        head = base64.b64decode(text[at : at + 24])
        if head[0] == 0x30:  # the outer length says how far to read
            n = head[1] & 0x7F
            size = 2 + head[1] if head[1] < 0x80 else 2 + n + int.from_bytes(head[2 : 2 + n], "big") if n <= 4 else 0
            inner = head[2:] if head[1] < 0x80 else head[2 + n :]
            # a key begins with a version number or, sealed, with its algorithm; and it must lie within its lines
            if not (inner[:3] in (b"\x02\x01\x00", b"\x02\x01\x01") or inner[:1] == b"\x30") or 4 * (size // 3) > block - at:
                continue
        else:
            # the name of the cipher comes first: a few characters
            if int.from_bytes(base64.b64decode(text[at : at + 28])[15:19], "big") > 64:
                continue
            size = block - at
        chars, stop, run = -(-size // 3) * 4, at, []
        more = _b64_more.match(text, at, min(len(text), at + 2 * chars + 64)).group()
        for line in re.findall(r"[A-Za-z0-9+/=]+|[\r\n]+", more):
            if line[0] not in "\r\n":
                run.append(line[: chars])
                chars -= len(run[-1])
                stop += len(run[-1])
                if not chars:
                    break
            else:
                stop += len(line)
        data = _decode("".join(run))
        used = _key_bytes(data)
        if used and head[0] == 0x30 and used >= 32:
            out.append(("key64", at, stop))
        elif used and head[0] != 0x30:
            out.append(("key64", at, _after(text, at, -(-used // 3) * 4)))
        else:
            continue
        free = out[-1][2]
    return out


def _after(text: str, at: int, chars: int) -> int:
    """Position after ``chars`` base64 characters, line breaks not counted."""
    while chars and at < len(text):
        chars -= text[at] not in "\r\n"
        at += 1
    return at


def _hex_keys(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _hexrun.finditer(text):
        run = m.group()
        used = _key_bytes(bytes.fromhex(run[: len(run) // 2 * 2]))
        if used >= 32:
            out.append(("keyhex", m.start(), m.start() + 2 * used))
    return out


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in a text, by start, then kind; offsets in code points."""
    if not text:
        return []
    low = text.lower()
    spans = []
    if any(k in low for k in KEYWORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    pem = _pem_keys(text) if "PRIVATE KEY-----" in text else []
    spans += _jwt(text) + pem + _base64_keys(text, pem) + _hex_keys(text)
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return spans


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) per row of ``docs``; spans is an ordered array of (kind, start, end, value).

    Null and empty texts have no spans. Rows with equal or null doc_id stay apart; other columns are not read.
    Memory is one text at a time; a text is scanned whole.
    """
    def found(i, text):
        return ((i, [{"kind": k, "start": s, "end": e, "value": text[s:e]} for k, s, e in scan(text)]),)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return map_rows(rows, lambda: found, "doc_id long, spans array<struct<kind:string,start:long,end:long,value:string>>")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; overlapping spans become one mark.

    ``length_col``, where the table has it, is set to the new length of changed texts. Null texts stay null.
    """
    def masked(text):
        spans = scan(text)
        if not spans:
            return ((None,),)
        out, at = [], 0
        for _, s, e in spans:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return (("".join([*out, text[at:]]),),)

    find_package(docs.sparkSession)

    # the scan is a column function here, so the other columns stay on the JVM side
    @F.pandas_udf("string")
    def changed(texts):
        return texts.map(lambda t: None if t is None else masked(t)[0][0])

    out = docs.withColumn("_masked", changed(F.col(text_col).cast("string")))
    new = {text_col: F.coalesce("_masked", F.col(text_col))}
    if length_col in docs.columns:
        new[length_col] = F.when(F.col("_masked").isNotNull(), F.char_length("_masked")).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
