"""Functions that Spark has no expression for, as Arrow-batched UDFs over single values."""

from __future__ import annotations

import base64
import hashlib
import hmac
import ipaddress
import os
import struct
import unicodedata
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import argon2
from .blake3 import blake3_hash


def per_value(kind: str, deterministic: bool = True):
    """Turn a function of values into a function of columns: nulls in any argument and errors give null."""

    def wrap(fn):
        def call(*columns: Column) -> Column:
            def one(*values):
                if any(v is None for v in values):
                    return None
                try:
                    return fn(*values)
                except (ValueError, OverflowError, ArithmeticError, UnicodeError):
                    return None

            def run(*series: pd.Series) -> pd.Series:
                return pd.Series([one(*v) for v in zip(*series, strict=True)], dtype=object)

            def run1(a: pd.Series) -> pd.Series:
                return run(a)

            def run2(a: pd.Series, b: pd.Series) -> pd.Series:
                return run(a, b)

            udf = F.pandas_udf({1: run1, 2: run2}[len(columns)], kind)
            return (udf if deterministic else udf.asNondeterministic())(*columns)

        call.value = fn
        return call

    return wrap


def _bytes(v) -> bytes:
    return v.encode() if isinstance(v, str) else bytes(v)


@per_value("string")
def base32_enc(v):
    return base64.b32encode(_bytes(v)).decode()


@per_value("binary")
def base32_dec(v):
    return base64.b32decode(v)


@per_value("binary")
def base64_dec(v):
    return base64.b64decode(v, validate=True)


@per_value("binary")
def base64url_dec(v):
    if "+" in v or "/" in v:
        raise ValueError(v)
    return base64.b64decode(v.replace("-", "+").replace("_", "/"), validate=True)


@per_value("boolean")
def is_ipv6(v):
    if "%" in v:
        return False
    try:
        ipaddress.IPv6Address(v)
    except ValueError:
        return False
    return True


@per_value("string")
def normalize_nfc(v):
    return unicodedata.normalize("NFC", v)


@per_value("string")
def normalize_nfkc(v):
    return unicodedata.normalize("NFKC", v)


@per_value("binary")
def sha3_256(v):
    return hashlib.sha3_256(bytes(v)).digest()


@per_value("binary")
def blake3(v):
    return blake3_hash(bytes(v))


@per_value("binary")
def hmac_sha256(key, message):
    return hmac.new(bytes(key), bytes(message), hashlib.sha256).digest()


@per_value("binary", deterministic=False)
def random_bytes(n):
    return os.urandom(int(n)) if n >= 0 else None


@per_value("string")
def json_escape(v):
    short = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return "".join(short.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in v)


@per_value("double")
def jaro_winkler(a, b):
    """Jaro similarity with a bonus for a common prefix of up to four characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, u in zip(b, used, strict=True) if u]
    m, moved = len(hits), sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


#: The leading byte of each type in the canonical encoding.
CANONICAL_TAGS = {"null": 0x00, "bool": 0x01, "int": 0x02, "f64": 0x03, "str": 0x06, "bin": 0x07, "list": 0x08, "map": 0x0A}
PREVIOUS_HASH = "_prev_hash"


def _packed_key(key: str) -> bytes:
    """A string as MessagePack."""
    raw = key.encode()
    n = len(raw)
    head = bytes([0xA0 | n]) if n < 32 else b"\xd9" + bytes([n]) if n < 256 else b"\xda" + n.to_bytes(2, "big") if n < 65536 else b"\xdb" + n.to_bytes(4, "big")
    return head + raw


def canonical_bytes(v, top: bool = True) -> bytes:
    """A type-tagged encoding in which map entries are sorted by key; the previous hash at the top is left out."""
    sized = lambda b: len(b).to_bytes(8, "big") + b
    tag = lambda name: bytes([CANONICAL_TAGS[name]])
    if v is None:
        return tag("null")
    if isinstance(v, bool):
        return tag("bool") + bytes([v])
    if isinstance(v, int):
        return tag("int") + struct.pack(">q", v)
    if isinstance(v, float):
        return tag("f64") + (b"\x7f\xf8" + bytes(6) if v != v else struct.pack(">d", v or 0.0))
    if isinstance(v, (bytes, bytearray)):
        return tag("bin") + sized(bytes(v))
    if isinstance(v, dict):
        pairs = sorted((_packed_key(k), x) for k, x in v.items() if not (top and k == PREVIOUS_HASH))
        return tag("map") + len(pairs).to_bytes(8, "big") + b"".join(sized(k) + canonical_bytes(x, False) for k, x in pairs)
    if isinstance(v, (list, tuple)):
        return tag("list") + len(v).to_bytes(8, "big") + b"".join(canonical_bytes(x, False) for x in v)
    return tag("str") + sized(str(v).encode())


def canonical_hash(column: Column) -> Column:
    """BLAKE3 of the canonical encoding, in lower-case hex; structs count as maps."""

    def plain(v):
        if isinstance(v, datetime):
            return str(v.replace(tzinfo=None))
        return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v

    def run(values: pa.Array) -> pa.Array:
        return pa.array([blake3_hash(canonical_bytes(plain(v))).hex() for v in values.to_pylist(maps_as_pydicts="strict")], pa.string())

    return F.arrow_udf(run, "string")(column)


def argon2id(password: Column, salt: Column, *more: Column) -> Column:
    """Argon2id of a batch's passwords, those of equal parameters side by side; null where an argument is out of range."""

    def run(a: pd.Series, b: pd.Series, memory: pd.Series, time: pd.Series, lanes: pd.Series, length: pd.Series) -> pd.Series:
        out: list[bytes | None] = [None] * len(a)
        groups: dict[tuple, list[int]] = {}
        for i, row in enumerate(zip(a, b, memory, time, lanes, length, strict=True)):
            known = argon2.checked(*row)
            if known is not None:
                groups.setdefault(known, []).append(i)
        for known, places in groups.items():
            for i, tag in zip(places, argon2.argon2id([(bytes(a[i]), bytes(b[i])) for i in places], *known), strict=True):
                out[i] = tag
        return pd.Series(out, dtype=object)

    rest = [*more, *[F.lit(None).cast("bigint")] * (4 - len(more))]
    return F.pandas_udf(run, "binary")(password, salt, *rest)
