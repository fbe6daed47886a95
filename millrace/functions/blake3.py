"""The BLAKE3 hash function (unkeyed, 32 bytes), after the published specification."""

from __future__ import annotations

import struct

#: Fixed values of the specification: the initial state and the message permutation.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
MASK = 0xFFFFFFFF


def _compress(chain, block: bytes, counter: int, flags: int, size: int = 64) -> list[int]:
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    s = [*chain, *IV[:4], counter & MASK, counter >> 32, size, flags]

    def mix(a, b, c, d, x, y):
        s[a] = (s[a] + s[b] + x) & MASK
        t = s[d] ^ s[a]
        s[d] = (t >> 16 | t << 16) & MASK
        s[c] = (s[c] + s[d]) & MASK
        t = s[b] ^ s[c]
        s[b] = (t >> 12 | t << 20) & MASK
        s[a] = (s[a] + s[b] + y) & MASK
        t = s[d] ^ s[a]
        s[d] = (t >> 8 | t << 24) & MASK
        s[c] = (s[c] + s[d]) & MASK
        t = s[b] ^ s[c]
        s[b] = (t >> 7 | t << 25) & MASK

    for turn in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        if turn < 6:
            m = [m[i] for i in PERMUTATION]
    return [s[i] ^ s[i + 8] for i in range(8)]


def _chunk(data: bytes, counter: int, root: int) -> list[int]:
    blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    chain = list(IV)
    for i, block in enumerate(blocks):
        flags = (CHUNK_START if i == 0 else 0) | (CHUNK_END | root if i == len(blocks) - 1 else 0)
        chain = _compress(chain, block, counter, flags, len(block))
    return chain


def _tree(data: bytes, counter: int, root: int) -> list[int]:
    if len(data) <= 1024:
        return _chunk(data, counter, root)
    left = 1024 << ((len(data) - 1) // 1024).bit_length() - 1
    both = _tree(data[:left], counter, 0) + _tree(data[left:], counter + left // 1024, 0)
    return _compress(list(IV), struct.pack("<16I", *both), 0, PARENT | root)


def blake3_hash(data: bytes) -> bytes:
    """The 32-byte digest of ``data``."""
    return struct.pack("<8I", *_tree(data, 0, ROOT))
