"""Argon2id, version 0x13, as RFC 9106 defines it, in NumPy.

Several passwords of equal parameters are filled side by side, so that a step
costs its interpreter time once for all of them.
"""

from __future__ import annotations

import struct
from hashlib import blake2b

import numpy as np

#: What is taken where a parameter is left out, and the largest allowed.
DEFAULTS = {"memory_kb": 19_456, "time": 2, "parallelism": 1, "length": 32}
LARGEST = {"memory_kb": 65_536, "time": 16, "parallelism": 16, "length": 256}
MIN_SALT, MIN_LENGTH = 8, 4
VERSION, KIND, SLICES = 0x13, 2, 4
#: Bytes of blocks filled side by side.
SIDE_BY_SIDE = 256 << 20

_LOW = np.uint64(0xFFFFFFFF)


def _le32(*values: int) -> bytes:
    return struct.pack(f"<{len(values)}I", *values)


def long_hash(data: bytes, size: int) -> bytes:
    """The variable-length hash H'."""
    if size <= 64:
        return blake2b(_le32(size) + data, digest_size=size).digest()
    v = blake2b(_le32(size) + data).digest()
    out = [v[:32]]
    for _ in range(-(-size // 32) - 3):
        v = blake2b(v).digest()
        out.append(v[:32])
    rest = size - 32 * len(out)
    return b"".join(out) + blake2b(v, digest_size=rest).digest()


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint64(by)) | (x << np.uint64(64 - by))


def _quarter(a, b, c, d):
    def plus(x, y):
        return x + y + np.uint64(2) * (x & _LOW) * (y & _LOW)

    a = plus(a, b)
    d = _rotated(d ^ a, 32)
    c = plus(c, d)
    b = _rotated(b ^ c, 24)
    a = plus(a, b)
    d = _rotated(d ^ a, 16)
    c = plus(c, d)
    return a, _rotated(b ^ c, 63), c, d


def _permuted(rows: np.ndarray) -> np.ndarray:
    """The permutation P of each row of 16 words; shape (..., 16)."""
    v = rows.reshape(*rows.shape[:-1], 4, 4)
    a, b, c, d = _quarter(v[..., 0, :], v[..., 1, :], v[..., 2, :], v[..., 3, :])
    a, b, c, d = _quarter(a, np.roll(b, -1, -1), np.roll(c, -2, -1), np.roll(d, -3, -1))
    return np.stack([a, np.roll(b, 1, -1), np.roll(c, 2, -1), np.roll(d, 3, -1)], axis=-2).reshape(rows.shape)


def compressed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The compression G of blocks of 128 words; shape (n, 128)."""
    r = x ^ y
    n = len(r)
    q = _permuted(r.reshape(n, 8, 16))
    columns = q.reshape(n, 8, 8, 2).transpose(0, 2, 1, 3).reshape(n, 8, 16)
    z = _permuted(columns).reshape(n, 8, 8, 2).transpose(0, 2, 1, 3).reshape(n, 128)
    return z ^ r


def argon2id(inputs: list[tuple[bytes, bytes]], memory_kb: int, time: int, parallelism: int, length: int, secret: bytes = b"", extra: bytes = b"") -> list[bytes]:
    """The tags of (password, salt) pairs."""
    each = max(1, SIDE_BY_SIDE // (memory_kb * 1024))
    if len(inputs) > each:
        return [t for i in range(0, len(inputs), each) for t in argon2id(inputs[i : i + each], memory_kb, time, parallelism, length, secret, extra)]
    n, lanes = len(inputs), parallelism
    segment = memory_kb // (SLICES * lanes)
    width = SLICES * segment
    blocks = np.zeros((n, lanes, width, 128), dtype=np.uint64)
    for i, (password, salt) in enumerate(inputs):
        head = _le32(lanes, length, memory_kb, time, VERSION, KIND)
        first = blake2b(head + b"".join(_le32(len(x)) + x for x in (password, salt, secret, extra))).digest()
        for lane in range(lanes):
            for at in (0, 1):
                blocks[i, lane, at] = np.frombuffer(long_hash(first + _le32(at, lane), 1024), dtype="<u8")
    everyone = np.arange(n)
    zero = np.zeros((1, 128), dtype=np.uint64)
    for turn in range(time):
        for part in range(SLICES):
            fixed = turn == 0 and part < SLICES // 2  # addresses that do not depend on the password
            for lane in range(lanes):
                words = None
                for at in range(2 if turn == 0 and part == 0 else 0, segment):
                    column = part * segment + at
                    before = blocks[:, lane, column - 1]
                    if fixed:
                        if words is None or at % 128 == 0:
                            z = np.zeros((1, 128), dtype=np.uint64)
                            z[0, :7] = turn, lane, part, lanes * width, time, KIND, at // 128 + 1
                            words = compressed(zero, compressed(zero, z))[0]
                        chosen = np.full(n, words[at % 128], dtype=np.uint64)
                    else:
                        chosen = before[:, 0]
                    other = np.full(n, lane) if turn == 0 and part == 0 else ((chosen >> np.uint64(32)) % np.uint64(lanes)).astype(np.int64)
                    done = part * segment if turn == 0 else width - segment
                    area = np.where(other == lane, done + at - 1, done - (at == 0)).astype(np.uint64)
                    j = chosen & _LOW
                    far = (area * ((j * j) >> np.uint64(32))) >> np.uint64(32)
                    start = 0 if turn == 0 or part == SLICES - 1 else (part + 1) * segment
                    ref = (start + (area - np.uint64(1) - far).astype(np.int64)) % width
                    made = compressed(before, blocks[everyone, other, ref])
                    blocks[:, lane, column] = made if turn == 0 else made ^ blocks[:, lane, column]
    last = np.bitwise_xor.reduce(blocks[:, :, -1], axis=1)
    return [long_hash(row.astype("<u8").tobytes(), length) for row in last]


def checked(password, salt, memory_kb, time, parallelism, length) -> tuple | None:
    """Parameters with their defaults, or None where they are out of range."""
    given = {"memory_kb": memory_kb, "time": time, "parallelism": parallelism, "length": length}
    p = {k: DEFAULTS[k] if v is None or v != v else int(v) for k, v in given.items()}
    if password is None or salt is None or len(salt) < MIN_SALT or any(p[k] > LARGEST[k] for k in p):
        return None
    if p["time"] < 1 or p["parallelism"] < 1 or p["length"] < MIN_LENGTH or p["memory_kb"] < 8 * p["parallelism"]:
        return None
    return p["memory_kb"], p["time"], p["parallelism"], p["length"]
