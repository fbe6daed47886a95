"""Rolling fingerprints of byte and word sequences, and packed sets of them, in NumPy.

A fingerprint is a polynomial over Z/2^64 with random coefficients per byte,
finished with a bijective mixer; every function works on whole arrays.
Arithmetic wraps at 64 bits by design.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U64 = np.uint64
BASE = 0xD1342543DE82EF95  # odd, so it has an inverse
FLAG_BITS = U64(2)
MULTI = U64(1)  # the value stands for two or more places
MARK = U64(2)  # the caller's own mark

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=2)
def _coefficients(other: bool = False) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93 if other else 0x9E3779B97F4A7C15))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        have = _POWERS[base] = np.cumprod(have, dtype=U64)
    return have[:n]


def _inverse_powers(n: int) -> np.ndarray:
    return _powers(pow(BASE, -1, 1 << 64), n)


class Rolling:
    """Fingerprints of any substrings of one sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, table: np.ndarray | None = None):
        """``values``, or with a ``table`` the places of the values in it; in blocks that fit a cache."""
        n, block = len(values), 1 << 15
        self.prefix, powers = np.zeros(n + 1, U64), _powers(BASE, n)
        for a in range(0, n, block):
            own, out = values[a : a + block], self.prefix[a + 1 : a + block + 1]
            np.cumsum((own if table is None else table[own]) * powers[a : a + block], dtype=U64, out=out)
            out += self.prefix[a]

    @classmethod
    def of_bytes(cls, data: np.ndarray, other: bool = False) -> Rolling:
        """Of bytes, by their random values."""
        return cls(data, _coefficients(other))

    def at(self, start: np.ndarray, length) -> np.ndarray:
        """Fingerprints of the substrings at ``start`` of ``length`` (a number or an array)."""
        if not len(start):
            return np.zeros(0, U64)
        raw = self.prefix[start + length] - self.prefix[start]
        raw *= _inverse_powers(len(self.prefix))[start]
        if isinstance(length, np.ndarray):
            raw += length.astype(U64) * U64(0x9E3779B97F4A7C15)
        return mix(raw)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column end to end, and each row's offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def byte_values(data: np.ndarray, other: bool = False) -> np.ndarray:
    """A random 64-bit value per byte; ``other`` ones for a second, independent fingerprint."""
    return _coefficients(other)[data]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of every word, and each row's offsets into them."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] |= inside[cuts]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] |= inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Rolling.of_bytes(data, other).at(start, end - start), np.searchsorted(start, offsets)


def row_ends(offsets: np.ndarray) -> np.ndarray:
    """For every element its row's end."""
    return np.repeat(offsets[1:], np.diff(offsets))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values without repeats; the low ``FLAG_BITS`` are flags: marks are joined, repeats set ``MULTI``."""
    if not len(values):
        return values
    values = np.sort(values)
    head = values >> FLAG_BITS
    starts = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
    flags = np.bitwise_or.reduceat(values & U64(3), starts)
    flags |= (np.diff(starts, append=len(values)) > 1).astype(U64) * MULTI
    return (head[starts] << FLAG_BITS) | flags


def member(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which ``values`` are in the sorted ``table``; a small bitmap turns most of them away first."""
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    mask = U64((1 << 22) - 1)
    seen = np.zeros(1 << 22, bool)
    seen[mix(table) & mask] = True
    out = seen[mix(values) & mask]
    at = np.flatnonzero(out)
    probe = values[at]
    place = np.minimum(np.searchsorted(table, probe), len(table) - 1)
    out[at] = table[place] == probe
    return out


_ZSTD = {}


def _zstd():
    if not _ZSTD:
        _ZSTD["c"], _ZSTD["d"], _ZSTD["text"] = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
    return _ZSTD["c"], _ZSTD["d"], _ZSTD["text"]


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes of each significance together, so that compression finds the empty ones."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return width, values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as bytes; the first must be ascending and is kept as differences."""
    n = len(columns[0])
    gaps = columns[0].copy()
    gaps[1:] -= columns[0][:-1]
    first, gaps[:1] = int(gaps[0]) if n else 0, 0
    parts, widths = [], []
    for column in (gaps, *columns[1:]):
        width, data = _planes(column)
        widths.append(width)
        parts.append(data)
    head = n.to_bytes(8, "little") + first.to_bytes(8, "little") + bytes(widths)
    return head + _zstd()[0].compress(b"".join(parts))


def unpack(blob: bytes, columns: int = 1) -> list[np.ndarray]:
    """What ``pack`` was given."""
    n, first = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    widths = blob[16 : 16 + columns]
    data, out, at = _zstd()[1].decompress(blob[16 + columns :]), [], 0
    for width in widths:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        out.append(wide.reshape(-1).view("<u8").astype(U64, copy=False))
    if n:
        out[0][0] = first
        np.cumsum(out[0], dtype=U64, out=out[0])
    return out


def by_bucket(values: np.ndarray, bits: int, buckets: int, *more: np.ndarray) -> list[tuple[int, bytes]]:
    """Ascending ``bits``-bit values (with further columns) cut into equal ranges, as (bucket, packed)."""
    edges = np.array([-(-(b << bits) // buckets) for b in range(1, buckets)], U64)
    cuts = [0, *np.searchsorted(values, edges).tolist(), len(values)]
    return [(b, pack(values[x:y], *(c[x:y] for c in more))) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]


def bundle(*parts: bytes) -> bytes:
    """Several byte strings as one."""
    return len(parts).to_bytes(4, "little") + b"".join(len(p).to_bytes(8, "little") for p in parts) + b"".join(parts)


def unbundle(blob: bytes) -> list[bytes]:
    """What ``bundle`` was given."""
    n = int.from_bytes(blob[:4], "little")
    out, at = [], 4 + 8 * n
    for i in range(n):
        size = int.from_bytes(blob[4 + 8 * i : 12 + 8 * i], "little")
        out.append(blob[at : at + size])
        at += size
    return out


def squeeze(array: np.ndarray) -> bytes:
    """An array's bytes, compressed as text is: harder than fingerprints."""
    return _zstd()[2].compress(np.ascontiguousarray(array).tobytes())


def stretch(data: bytes, kind, *shape: int) -> np.ndarray:
    """What ``squeeze`` was given."""
    return np.frombuffer(_zstd()[1].decompress(data), kind).reshape(shape)


def pack_aligned(values: np.ndarray) -> bytes:
    """Numbers in any order."""
    return pack(np.arange(len(values), dtype=U64), values.astype(U64))


def unpack_aligned(blobs) -> np.ndarray:
    """What ``pack_aligned`` was given, blob after blob."""
    return np.concatenate([np.zeros(0, np.int64), *(unpack(b, 2)[1].astype(np.int64) for b in blobs)])
