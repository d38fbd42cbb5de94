"""Secrets in whole texts: pattern matches, and spans confirmed by their structure.

Three patterns (`assign`, `access`, `hex`) report every match. Longer base64 and hex candidates are decoded
first, and are reported only if what they decode to has the structure of a secret:

* `pem`: a PEM block whose body decodes to a private key, or is one encrypted by what its header lines say;
* `der`: base64 or hex of a DER key (nested tags and lengths that fill each other exactly, with the fields
  of a PKCS#1, DSA, SEC1 or PKCS#8 private key) or of an OpenSSH key file (length-prefixed strings);
* `jwt`: three base64url parts of which the first is a JSON header with an algorithm, the second JSON;
* `encoded`: base64 or hex of readable text in which an `assign` or `access` match stands.

Spans are (kind, start, end) in code points, end exclusive, ordered by start, then by kind as listed here.

Defined results: a null or empty text has no spans; repeated rows are scanned each; a null key is kept;
other columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.shared import ship

KINDS = ("assign", "access", "hex", "pem", "der", "jwt", "encoded")
# Patterns of the contract (fixed values); a shorter hex run or access match would be dropped anyway.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: One of these stands in lower-cased text wherever ASSIGN matches.
WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: The body may have header lines (Proc-Type, DEK-Info), and line ends may be escaped as in JSON.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----)[\x09-\x7e])+)-----END \1-----")
LINE_END = re.compile(r"(?:\\+[rn]|[\r\n])+")
PEM_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:.*")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: Breaks and tabs that readable text may hold.
NO_BREAKS = str.maketrans("", "", "\n\r\t")
ALL_HEX = re.compile(r"(?:[0-9a-f]{2}){12,}|(?:[0-9A-F]{2}){12,}")


def decoded(candidate: str) -> list[bytes]:
    """What a candidate decodes to, as hex and as base64 in either alphabet."""
    out = []
    if ALL_HEX.fullmatch(candidate):
        out.append(bytes.fromhex(candidate))
    bare = candidate.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 != 1:
        try:
            out.append(base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True))
        except binascii.Error:
            pass
    return out


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The DER elements that fill `data` exactly, or None."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length >= 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            length, at = int.from_bytes(data[at : at + size], "big"), at + size
        if at + length > len(data):
            return None
        found.append((tag, data[at : at + length]))
        at += length
    return found


def is_der_key(data: bytes) -> bool:
    """A PKCS#1, DSA, SEC1 or PKCS#8 private key, nested lengths included."""
    outer = elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    fields = elements(outer[0][1])
    if not fields or len(fields) < 2 or fields[0][0] != 0x02 or len(fields[0][1]) != 1:
        return False
    tags = [t for t, _ in fields]
    if fields[0][1] == b"\x00" and len(fields) >= 9 and set(tags[:9]) == {0x02}:
        return True  # PKCS#1
    if fields[0][1] == b"\x00" and tags == [0x02] * 6 and len(fields[1][1]) >= 64 and len(fields[2][1]) >= 16:
        return True  # DSA: version, p, q, g, public and private number
    if fields[0][1] == b"\x01" and tags[1] == 0x04 and len(fields[1][1]) >= 16:
        return True  # SEC1
    if tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 0x04:  # PKCS#8
        algorithm = elements(fields[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(fields[2][1]) >= 16
    return False


def is_encrypted_key(data: bytes) -> bool:
    """An encrypted PKCS#8 key: the algorithm, then the encrypted octets."""
    outer = elements(data)
    fields = elements(outer[0][1]) if outer and len(outer) == 1 and outer[0][0] == 0x30 else None
    if not fields or [t for t, _ in fields] != [0x30, 0x04] or len(fields[1][1]) < 16:
        return False
    algorithm = elements(fields[0][1])
    return bool(algorithm) and algorithm[0][0] == 0x06


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key file: its mark, then length-prefixed strings."""
    mark = b"openssh-key-v1\0"
    if not data.startswith(mark):
        return False
    at = len(mark)
    for _ in range(3):  # cipher, key derivation and its options
        length = int.from_bytes(data[at : at + 4], "big")
        at += 4 + length
        if at + 4 > len(data):
            return False
    return True


def is_pem_body(body: str) -> bool:
    """The lines between the marks of a PEM block: headers, then the base64 of a key, which is encrypted if a header says so."""
    lines = [line.strip() for line in LINE_END.split(body)]
    headers = [line for line in lines if PEM_HEADER.fullmatch(line)]
    rest = re.sub(r"\s", "", "".join(line for line in lines if not PEM_HEADER.fullmatch(line)))
    found = decoded(rest)
    if any(re.fullmatch(r"Proc-Type:\s*4,\s*ENCRYPTED", h) for h in headers):
        return any(len(d) >= 16 and len(d) % 8 == 0 for d in found)
    return any(is_der_key(d) or is_ssh_key(d) or is_encrypted_key(d) for d in found)


def is_token(header: str, claims: str) -> bool:
    """A signed token: JSON objects in both parts, an algorithm in the first."""
    try:
        parts = [json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in (header, claims)]
    except (ValueError, RecursionError):
        return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str)


def _assigned(text: str) -> Iterator[re.Match]:
    lower = text.lower()
    if any(w in lower for w in WORDS):
        yield from (m for m in ASSIGN.finditer(text) if len(m[1]) >= 12)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, in order."""
    spans = [(m.start(), 0, m.end()) for m in _assigned(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates whose decoded structure is that of a secret."""
    spans = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            if is_pem_body(m[2]):
                spans.append((m.start(), 3, m.end()))
    if "eyJ" in text:
        spans += [(m.start(), 5, m.end()) for m in JWT.finditer(text) if is_token(m[1], m[2])]
    for m in RUN.finditer(text):
        for data in decoded(m[0]):
            if is_der_key(data) or is_ssh_key(data):
                spans.append((m.start(), 4, m.end()))
                break
            if data.isascii() and (plain := data.decode()).translate(NO_BREAKS).isprintable() and (ACCESS.search(plain) or any(_assigned(plain))):
                spans.append((m.start(), 6, m.end()))
                break
    return spans


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    kinds = ("n_assign", "n_access", "n_hex")
    schema = T.StructType(
        [df.schema[key], *(T.StructField(k, T.LongType()) for k in kinds)]
        + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    )

    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["_text"]:
                base = base_spans(t)
                every = sorted({*base, *confirmed_spans(t)})
                counts = [sum(s[1] == k for s in base) for k in range(3)]
                rows.append([*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)])
            out = pd.DataFrame(rows, columns=schema.fieldNames()[1:])
            out.insert(0, key, batch[key].to_numpy())
            yield out

    given = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return given.mapInPandas(run, schema)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`df` with every span of its texts replaced by a mark; overlapping spans become one."""
    ship(df.sparkSession)

    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if not t or not (spans := sorted({(a, b) for a, _, b in base_spans(t) + confirmed_spans(t)})):
                return t
            out, at = [], 0
            for a, b in spans:
                if a >= at:
                    out += [t[at:a], mark]
                at = max(at, b)
            return "".join([*out, t[at:]])

        return texts.map(one, na_action="ignore")

    return df.withColumn(text, clean(F.col(text)))
