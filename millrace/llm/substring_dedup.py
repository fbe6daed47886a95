"""Removal of repeated word sequences by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``block`` words,
and every rolling window of ``block`` words is probed against them. With
``2 * block - 1 <= window`` any repeat of ``window`` words holds a whole
reference block of one place, which the other place's rolling windows hit: no
repeat is missed. Hits are then extended: around each hit every window of
``window`` words is compared as a whole, so a maximal repeat is exactly the
union of the windows found, and no pair of places is written out.

The first round filters with short fingerprints (a false hit costs time, never
a result), the second decides with 126 bits of two fingerprints of whole
windows, made with different coefficients from the bytes up.

Defined results: null text has no words; texts shorter than a window lose
nothing; every copy of a repeat is removed, the first too; rows are judged one
by one, so repeated rows repeat each other's windows; ids may be null or repeat.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fingerprints as fp
from . import rounds

CHUNK_BYTES = 4_000_000
BUCKET_BYTES = 8_000_000


def _open(offsets: np.ndarray, length: int) -> np.ndarray:
    """Places where a window of ``length`` still lies in its row."""
    n = int(offsets[-1])
    return np.flatnonzero(np.arange(n) + length <= fp.row_ends(offsets))


def repeated_values(blobs: list[bytes], marked: bool = False) -> list[bytes | None]:
    """Per chunk the values that stand in two places or more, one of them marked if ``marked``."""
    parts = [fp.unpack(b)[0] for b in blobs]
    merged = fp.distinct(np.concatenate(parts))
    keep = (merged & fp.MULTI) > 0
    if marked:
        keep &= (merged & fp.MARK) > 0
    table = merged[keep] >> fp.FLAG_BITS
    out = []
    for part in parts:
        own = part >> fp.FLAG_BITS
        own = own[fp.member(table, own)]
        out.append(fp.pack(own) if len(own) else None)
    return out


def told_values(said: dict[int, bytes]) -> np.ndarray:
    """All answered values; a bucket is a range of them, so they are in order."""
    return np.concatenate([np.zeros(0, fp.U64), *(fp.unpack(b)[0] for b in said.values())])


def _sorted_pairs(value: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of (value, check), and where each distinct one begins in it."""
    order = np.argsort(value, kind="stable")
    same, other = value[order][1:] == value[order][:-1], check[order][1:] != check[order][:-1]
    if (same & other).any():  # two windows of one value: next to never
        order = np.lexsort((check, value))
        same, other = value[order][1:] == value[order][:-1], check[order][1:] != check[order][:-1]
    return order, np.flatnonzero(np.concatenate(([True], ~same | other))[: len(order)])


def repeated_pairs(blobs: list[bytes]) -> list[bytes | None]:
    """Per chunk the (value, check) that stand in two places or more."""
    parts = [fp.unpack(b, 2) for b in blobs]
    value, check = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order, new = _sorted_pairs(value >> fp.FLAG_BITS, check)
    group = np.zeros(len(order), np.int64)
    group[new[1:]] = 1
    group = np.cumsum(group)
    repeated = np.empty(len(order), bool)
    repeated[order] = (np.bincount(group) + np.bincount(group, weights=(value[order] & fp.MULTI) > 0) > 1)[group]
    out, at = [], 0
    for v, c in parts:
        own = repeated[at : at + len(v)]
        at += len(v)
        out.append(fp.pack(v[own] >> fp.FLAG_BITS, c[own]) if own.any() else None)
    return out


def told_pairs(said: dict[int, bytes], value: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Which (value, check) were answered."""
    parts = [fp.unpack(b, 2) for b in said.values()]
    values, checks = (np.concatenate([np.zeros(0, fp.U64), *(p[i] for p in parts)]) for i in (0, 1))
    out = fp.member(values, value)
    at = np.flatnonzero(out)
    place = np.searchsorted(values, value[at])
    found = checks[place] == check[at]
    for other in np.flatnonzero(values[1:] == values[:-1]) + 1:  # values that stand for two windows: next to none
        found |= (value[at] == values[other]) & (check[at] == checks[other])
    out[at] = found
    return out


def repeated_words(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row: id, n_words, n_removed, kept (the words left, joined by one space)."""
    if window < 1:
        raise ValueError("window must be positive")
    block = (window + 1) // 2
    plan = rounds.layout(docs, text_col, chunk_bytes, bucket_bytes)
    corpus = rounds.chunked(docs, id_col, text_col, plan)
    bits, buckets = plan.filter_bits, plan.buckets
    shift = fp.U64(64 - bits)

    def probes(offsets: np.ndarray, rolling: fp.Rolling):
        """The places where a rolling block starts, and the probe values."""
        places = _open(offsets, block)
        return places, rolling.at(places, block) >> shift

    def blocks_and_probes(rows: pa.Table, _, __):
        values, offsets = fp.words(*fp.text_bytes(rows.column("text")))
        places, value = probes(offsets, fp.Rolling(values))
        in_row = places - np.repeat(offsets[:-1], np.diff(offsets))[places]
        value = (value << fp.FLAG_BITS) | ((in_row % block == 0).astype(fp.U64) * fp.MARK)
        return fp.by_bucket(fp.distinct(value), bits + 2, buckets), None

    def extensions(rows: pa.Table, said: dict[int, bytes], _):
        text = fp.text_bytes(rows.column("text"))
        values, offsets = fp.words(*text)
        rolling = fp.Rolling(values)
        places, value = probes(offsets, rolling)
        hit = np.zeros(int(offsets[-1]) + 1, np.int64)
        hit[places[fp.member(told_values(said), value)] + 1] = 1
        before = np.cumsum(hit)
        start = _open(offsets, window)
        start = start[before[start + window - block + 1] > before[start]]
        if not len(start):
            return [], None
        value, check = rolling.at(start, window) >> fp.FLAG_BITS, fp.Rolling(fp.words(*text, other=True)[0]).at(start, window)
        order, new = _sorted_pairs(value, check)
        multi = (np.diff(new, append=len(order)) > 1).astype(fp.U64)
        first = order[new]
        return fp.by_bucket((value[first] << fp.FLAG_BITS) | multi, 64, buckets, check[first]), None

    def cut(rows: pa.Table, said: dict[int, bytes], _) -> pa.Table:
        text = fp.text_bytes(rows.column("text"))
        values, offsets = fp.words(*text)
        start = _open(offsets, window)
        if said:
            value, check = fp.Rolling(values).at(start, window) >> fp.FLAG_BITS, fp.Rolling(fp.words(*text, other=True)[0]).at(start, window)
            start = start[told_pairs(said, value, check)]
        else:
            start = start[:0]
        n = int(offsets[-1])
        left = np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(start + window, minlength=n + 1))[:n] == 0
        upto = np.concatenate(([0], np.cumsum(left)))
        n_words = np.diff(offsets)
        n_left = upto[offsets[1:]] - upto[offsets[:-1]]
        kept = []
        for i, text in enumerate(rows.column("text").cast(pa.binary()).to_pylist()):
            own = (text or b"").split()
            if n_left[i] < n_words[i]:
                own = compress(own, left[offsets[i] : offsets[i + 1]].tolist())
            kept.append(b" ".join(own))
        return pa.table({"id": rows.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_words - n_left, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    hits = rounds.answer(rounds.ask(corpus, blocks_and_probes), lambda blobs: repeated_values(blobs, True))
    repeats = rounds.answer(rounds.ask(corpus, extensions, hits), repeated_pairs)
    out = rounds.finish(corpus, repeats, cut, f"id {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept string")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")
