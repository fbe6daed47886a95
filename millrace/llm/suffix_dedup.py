"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A string of ``length`` bytes is repeated if the suffixes of two of its places
agree in their first ``length`` bytes. The suffixes of a corpus are sorted in
buckets of equal leading bytes, one bucket at a time, and long ties are
resolved by ranks of a sample that are computed before.

* Cover sample. The residues ``COVERS[v]`` modulo ``v`` are a difference cover:
  for any two places some ``k < v`` moves both onto sample places. The sample
  suffixes are cut to ``length - v + 1`` bytes, so that they lie in any string
  of ``length`` bytes that starts up to ``v - 1`` bytes before them.
* Pruning. A suffix that ties with no other can't lie in a repeat. Short
  fingerprints of the sample suffixes turn most of them away; a false hit
  costs time, never a result.
* Ranks. The other sample suffixes go to the buckets of their leading bytes,
  which sort them by their bytes: equal bytes, equal rank. Order is that of
  (leading bytes, rank), and those alone in their rank drop out.
* Whole ties. Sample suffixes of one rank are sorted by their context, all
  bytes that a string of ``length`` bytes through them can touch. Where two
  contexts are equal, all strings through them repeat.
* Long ties. Of a rank with several contexts one suffix of each context sends
  the bytes on either side. Two suffixes that start ``k`` bytes before sample
  suffixes tie in ``length`` bytes if they tie in their first ``k`` bytes, in
  the rank, and in the rest: for every ``k`` they are sorted by these three,
  and neighbours that tie are repeats. The answer is a bit for every ``k``.

Bytes decide the ranks; inside a rank the contexts are told apart by 64-bit
fingerprints, as are equal suffixes inside one chunk.

Memory is bounded by one chunk of text or one bucket of suffixes.

Defined results: null text has no bytes; texts shorter than ``length`` lose
nothing; every copy is removed, the first too; strings never cross rows; equal
rows repeat each other; ids may be null or repeat. What is left may end inside
a character, so it is binary; ``without_repeats`` drops such parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fingerprints as fp
from . import rounds
from .substring_dedup import repeated_values, told_values

#: Perfect difference sets (fixed values): every residue modulo the key is a difference of two of the numbers.
COVERS = {
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    31: (1, 5, 11, 24, 25, 27),
    13: (0, 1, 3, 9),
    7: (0, 1, 3),
    1: (0,),
}
CHUNK_BYTES = 2_000_000
BUCKET_BYTES = 16_000_000
#: Buckets of suffixes hold bytes, so there are more of them than of fingerprints.
MORE_BUCKETS = 4
LEADING = 16


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover that leaves a third of ``length`` for the sample suffixes: few samples, and few ties by chance."""
    period = max(v for v in COVERS if 3 * (v - 1) <= 2 * length)
    return period, COVERS[period]


class _Chunk:
    """One chunk's bytes."""

    def __init__(self, rows: pa.Table, length: int):
        self.period, self.residues = cover_for(length)
        self.length, self.prefix = length, length - self.period + 1
        self.data, self.offsets = fp.text_bytes(rows.column("text"))

    def sample_suffixes(self) -> None:
        """Sets the places of the cover sample and the fingerprints of their suffixes."""
        sizes = np.diff(self.offsets)
        places = (np.arange(0, int(sizes.max(initial=0)) + 1, self.period)[:, None] + np.array(self.residues)).reshape(-1)
        held = np.searchsorted(places, sizes - self.prefix, side="right")
        nth = np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)
        self.sample = np.repeat(self.offsets[:-1], held) + places[nth]
        self.rolling = fp.Rolling.of_bytes(self.data)
        self.key = self.rolling.at(self.sample, self.prefix)

    def list_suffixes(self, buckets: int) -> None:
        """The distinct sample suffixes by bucket and leading bytes: their places, buckets, whether they repeat, and which one each place holds."""
        key, first, of, count = np.unique(self.key, return_index=True, return_inverse=True, return_counts=True)
        place = self.sample[first]
        leading = self.rolling.at(place, min(LEADING, self.prefix)) >> fp.U64(32)
        home = ((leading * fp.U64(buckets)) >> fp.U64(32)).astype(np.int64)
        lead = np.zeros(len(place), fp.U64)
        for i in range(min(8, self.prefix)):
            lead = (lead << fp.U64(8)) | self.data[place + i].astype(fp.U64)
        order = np.lexsort((key, lead, home))
        nth = np.empty_like(order)
        nth[order] = np.arange(len(order))
        self.of, self.home, self.place, self.multi = nth[of], home[order], place[order], count[order] > 1

    def within(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the row of each sample place begins and ends."""
        row = np.searchsorted(self.offsets, self.sample, side="right") - 1
        return self.offsets[row], self.offsets[row + 1]

    def list_contexts(self, home: np.ndarray, rank: np.ndarray) -> None:
        """Given each place's bucket and rank, the distinct (bucket, rank, context) in order, whether they repeat, and which one each place holds."""
        first, end = self.within()
        low, high = np.maximum(first, self.sample - (self.period - 1)), np.minimum(end, self.sample + self.length)
        context = fp.mix(fp.Rolling.of_bytes(self.data).at(low, high - low) + (self.sample - low).astype(fp.U64) * fp.U64(0xC2B2AE3D27D4EB4F))
        order = np.lexsort((context, rank, home))
        home, rank, context = home[order], rank[order], context[order]
        new = np.concatenate(([True], (home[1:] != home[:-1]) | (rank[1:] != rank[:-1]) | (context[1:] != context[:-1])))[: len(order)]
        at = np.flatnonzero(new)
        self.of = np.empty_like(order)
        self.of[order] = np.cumsum(new) - 1
        self.home, self.rank, self.context, self.multi = home[at], rank[at], context[at], np.diff(at, append=len(order)) > 1

    def one_place_each(self, count: int) -> np.ndarray:
        """For each of ``count`` listed contexts the first place that holds it."""
        at = np.zeros(count, np.int64)
        at[self.of[::-1]] = np.arange(len(self.of))[::-1]
        return at


def _by_home(home: np.ndarray, send) -> list[tuple[int, bytes]]:
    """``send(a, b)`` for the range of every bucket in the ascending ``home``."""
    at = [0, *(np.flatnonzero(home[1:] != home[:-1]) + 1).tolist(), len(home)]
    return [(int(home[a]), send(a, b)) for a, b in zip(at, at[1:], strict=False) if b > a]


def rank_suffixes(prefix: int):
    """Sorts a bucket's suffixes by their bytes; per chunk the rank of each one that it sent, 0 for those that are alone."""

    def resolve(blobs: list[bytes]) -> list[bytes]:
        parts = [fp.unbundle(b) for b in blobs]
        rows = [fp.stretch(p[1], np.uint8, -1, prefix) for p in parts]
        sizes = [len(r) for r in rows]
        multi = np.concatenate([np.unpackbits(np.frombuffer(p[0], np.uint8), count=n) for p, n in zip(parts, sizes, strict=True)])
        rows = np.concatenate(rows)
        order = np.argsort(rows.view(f"S{prefix}").reshape(-1), kind="stable")
        rows = rows[order]
        group = np.cumsum(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))) - 1
        tied = np.bincount(group) + np.bincount(group, weights=multi[order]) > 1
        rank = np.empty(len(order), np.int64)
        rank[order] = np.where(tied[group], group + 1, 0)
        return [fp.pack_aligned(r) for r in np.split(rank, np.cumsum(sizes)[:-1])]

    return resolve


def resolve_contexts(blobs: list[bytes]) -> list[bytes]:
    """Per chunk flags of each (rank, context). MULTI: it is in two places or more. MARK: its rank has other contexts, and this chunk speaks for it."""
    parts = [fp.unpack(b, 2) for b in blobs]
    sizes = [len(p[0]) for p in parts]
    value, context = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    rank, multi = value >> fp.FLAG_BITS, (value & fp.MULTI) > 0
    order = np.lexsort((context, rank))
    rank, context, multi = rank[order], context[order], multi[order]
    new_rank = np.concatenate(([True], rank[1:] != rank[:-1]))
    new = new_rank | np.concatenate(([True], context[1:] != context[:-1]))
    group, of_rank = np.cumsum(new) - 1, np.cumsum(new_rank) - 1
    full = (np.bincount(group) + np.bincount(group, weights=multi) > 1)[group]
    several = (np.bincount(of_rank[new]) > 1)[of_rank]
    flags = np.empty(len(order), fp.U64)
    flags[order] = full * fp.MULTI + (several & new) * fp.MARK
    return [fp.pack_aligned(f) for f in np.split(flags, np.cumsum(sizes)[:-1])]


def _extended(side: np.ndarray) -> list[np.ndarray]:
    """Fingerprints of the first 0, 1, .. bytes of every row."""
    values, out = fp.byte_values(side), [np.zeros(len(side), fp.U64)]
    for i in range(side.shape[1]):
        out.append(out[-1] * fp.U64(fp.BASE) + values[:, i])
    return out


def resolve_long_ties(span: int):
    """Per chunk, for each suffix that it sent, ``span + 1`` bits: whether the string that starts k bytes before it repeats."""

    def resolve(blobs: list[bytes]) -> list[bytes]:
        parts = [fp.unbundle(b) for b in blobs]
        ranks = [fp.unpack(p[0])[0] for p in parts]
        sizes = [len(r) for r in ranks]
        rank, room = np.concatenate(ranks), np.concatenate([fp.stretch(p[1], np.uint8, -1, 2) for p in parts])
        before, after = (_extended(np.concatenate([fp.stretch(p[i], np.uint8, n, span) for p, n in zip(parts, sizes, strict=True)])) for i in (2, 3))
        out = np.zeros((len(rank), span + 1), bool)
        named = fp.mix(rank * fp.U64(0x9E3779B97F4A7C15))
        for k in range(span + 1):
            some = np.flatnonzero((room[:, 0] >= k) & (room[:, 1] >= span - k))
            string = fp.mix(fp.mix(before[k][some] ^ named[some]) + after[span - k][some] * fp.U64(0xC2B2AE3D27D4EB4F))
            order = np.argsort(string)
            string = string[order]
            tie = np.concatenate((string[1:] == string[:-1], [False]))[: len(order)]
            tie[1:] |= tie[:-1].copy()
            out[some[order], k] = tie
        return [fp.squeeze(np.packbits(x, axis=1)) for x in np.split(out, np.cumsum(sizes)[:-1])]

    return resolve


def repeated_bytes(
    docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), characters: bool = False, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, span_starts and span_ends (maximal removed runs, in bytes), kept (binary),
    and ``row``, a struct of the columns in ``keep``. With ``characters`` kept is text, without the parts of characters
    that a removal has cut; a null text stays null."""
    if length < 1:
        raise ValueError("length must be positive")
    plan = rounds.layout(docs, text_col, chunk_bytes, bucket_bytes)
    corpus = rounds.chunked(docs, id_col, text_col, plan, **({"row": F.struct(*keep)} if keep else {}))
    shift, buckets, homes = fp.U64(64 - plan.filter_bits), plan.buckets, plan.buckets * MORE_BUCKETS
    period, _ = cover_for(length)
    prefix, span = length - period + 1, period - 1

    # What a chunk remembers: its tied places, and which listed suffix, later which listed context, each one holds.

    def prune(rows: pa.Table, _, __):
        chunk = _Chunk(rows, length)
        chunk.sample_suffixes()
        return fp.by_bucket(fp.distinct((chunk.key >> shift) << fp.FLAG_BITS), plan.filter_bits + 2, buckets), None

    def suffixes(rows: pa.Table, said: dict[int, bytes], _):
        if not said:
            return [], None
        chunk = _Chunk(rows, length)
        chunk.sample_suffixes()
        tied = fp.member(told_values(said), chunk.key >> shift)
        chunk.sample, chunk.key = chunk.sample[tied], chunk.key[tied]
        chunk.list_suffixes(homes)

        def send(a: int, b: int) -> bytes:
            return fp.bundle(np.packbits(chunk.multi[a:b]).tobytes(), fp.squeeze(chunk.data[chunk.place[a:b, None] + np.arange(prefix)]))

        return _by_home(chunk.home, send), fp.bundle(fp.pack(chunk.sample.astype(fp.U64)), fp.pack_aligned(chunk.of))

    def remembered(rows: pa.Table, state: bytes) -> tuple[_Chunk, list[bytes]]:
        chunk, parts = _Chunk(rows, length), fp.unbundle(state)
        chunk.sample, chunk.of = fp.unpack(parts[0])[0].astype(np.int64), fp.unpack_aligned(parts[1:2])
        return chunk, parts[2:]

    def answered(said: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each listed one's bucket and answer."""
        values = [fp.unpack_aligned([b]) for b in said.values()]
        return np.repeat(list(said), [len(v) for v in values]), np.concatenate(values)

    def contexts(rows: pa.Table, said: dict[int, bytes], state: bytes | None):
        if not said:
            return [], None
        chunk, _ = remembered(rows, state)
        home, rank = (x[chunk.of] for x in answered(said))
        chunk.sample = chunk.sample[rank > 0]
        chunk.list_contexts(home[rank > 0], rank[rank > 0])

        def send(a: int, b: int) -> bytes:
            return fp.pack((chunk.rank[a:b].astype(fp.U64) << fp.FLAG_BITS) | chunk.multi[a:b].astype(fp.U64), chunk.context[a:b])

        return _by_home(chunk.home, send), fp.bundle(fp.pack(chunk.sample.astype(fp.U64)), fp.pack_aligned(chunk.of), fp.pack_aligned(chunk.rank))

    def long_ties(rows: pa.Table, said: dict[int, bytes], state: bytes | None):
        if not said:
            return [], None
        chunk, (rank,) = remembered(rows, state)
        home, flags = answered(said)
        speaks = np.flatnonzero(flags & 2)
        at = chunk.one_place_each(len(flags))[speaks]
        first, end = (x[at] for x in chunk.within())
        rank, home, place, nth = fp.unpack_aligned([rank])[speaks].astype(fp.U64), home[speaks], chunk.sample[at], np.arange(span)
        room = np.minimum(np.stack((place - first, end - place - prefix), axis=1), span).astype(np.uint8)

        def send(a: int, b: int) -> bytes:
            before = np.where(nth < room[a:b, :1], chunk.data[np.maximum(place[a:b, None] - 1 - nth, 0)], np.uint8(0))
            after = np.where(nth < room[a:b, 1:], chunk.data[np.minimum(place[a:b, None] + prefix + nth, len(chunk.data) - 1)], np.uint8(0))
            return fp.bundle(fp.pack(rank[a:b]), fp.squeeze(room[a:b]), fp.squeeze(before), fp.squeeze(after))

        return _by_home(home, send), fp.bundle(*fp.unbundle(state)[:2], fp.pack_aligned(flags))

    def repeats(chunk: _Chunk, flags: np.ndarray, said: dict[int, bytes]) -> np.ndarray:
        """A mark for every byte of the chunk that a repeat covers."""
        first, end = chunk.within()
        low, high = np.maximum(first, chunk.sample - span), np.minimum(chunk.sample, end - length)
        full = np.flatnonzero(((flags & 1)[chunk.of] > 0) & (high >= low))
        width = -(-(span + 1) // 8)
        bits = np.concatenate([np.zeros((0, width), np.uint8), *(fp.stretch(b, np.uint8, -1, width) for b in said.values())])
        who, k = np.nonzero(np.unpackbits(bits, axis=1, count=span + 1))
        found = chunk.sample[chunk.one_place_each(len(flags))[np.flatnonzero(flags & 2)]][who] - k
        low, high = np.concatenate((low[full], found)), np.concatenate((high[full], found)) + length
        n = len(chunk.data)
        return np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1))[:n] > 0

    def cut(rows: pa.Table, said: dict[int, bytes], state: bytes | None) -> pa.Table:
        if state is None:
            chunk = _Chunk(rows, length)
            gone = np.zeros(len(chunk.data), bool)
        else:
            chunk, (flags,) = remembered(rows, state)
            gone = repeats(chunk, fp.unpack_aligned([flags]), said)
        data, offsets = chunk.data, chunk.offsets
        upto = np.concatenate(([0], np.cumsum(gone)))
        sizes, removed = np.diff(offsets), upto[offsets[1:]] - upto[offsets[:-1]]
        first, last = gone.copy(), gone.copy()
        first[1:] &= ~gone[:-1]
        last[:-1] &= ~gone[1:]
        heads, tails = offsets[:-1][sizes > 0], offsets[1:][sizes > 0] - 1
        first[heads] |= gone[heads]
        last[tails] |= gone[tails]
        first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
        of = np.searchsorted(offsets, first, side="right") - 1
        spans = pa.array(np.searchsorted(first, offsets), pa.int32())
        left = np.concatenate(([0], np.cumsum(sizes - removed)))
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[~gone])]).cast(pa.binary())
        if characters:
            texts = zip(rows.column("text"), kept, removed, strict=True)
            kept = pa.array([None if text.as_py() is None else part.as_py().decode("utf-8", "ignore") if n else text.as_py() for text, part, n in texts], pa.string())
        return pa.table({
            "id": rows.column("id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "span_starts": pa.ListArray.from_arrays(spans, pa.array(first - offsets[of], pa.int64())),
            "span_ends": pa.ListArray.from_arrays(spans, pa.array(last - offsets[of], pa.int64())),
            "kept": kept, **({"row": rows.column("row")} if keep else {}),
        })

    candidates = rounds.answer(rounds.ask(corpus, prune), repeated_values)
    ranks = rounds.answer(rounds.ask(corpus, suffixes, candidates), rank_suffixes(prefix))
    flags = rounds.answer(rounds.ask(corpus, contexts, ranks), resolve_contexts)
    bits = rounds.answer(rounds.ask(corpus, long_ties, flags), resolve_long_ties(span))
    kinds = dict(docs.dtypes)
    more = f", row {docs.select(F.struct(*keep).alias('row')).schema['row'].dataType.simpleString()}" if keep else ""
    out = rounds.finish(corpus, bits, cut, f"id {kinds[id_col]}, n_bytes long, n_removed long, span_starts array<long>, span_ends array<long>, kept {'string' if characters else 'binary'}{more}")
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """``docs`` with repeated bytes removed from the texts; rows and columns as they are, but for ``n_chars``, which follows."""
    keep = tuple(c for c in docs.columns if c != text_col)
    found = repeated_bytes(docs, length, id_col, text_col, keep=keep, characters=True, **sizes)
    out = {c: F.col("row")[c] for c in keep} | {text_col: F.col("kept")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return found.select(*(out[c].alias(c) for c in docs.columns))
