"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counting. Chunks of the corpus send their distinct tokens and bigrams with
counts to buckets (``rounds``); buckets add them up. Token counts are exact
and go back to the chunks that hold the token. Bigram counts are quantised,
level 1 + floor(log2(count / least)), and a bigram of level n is put into the
filter n times, with the levels 1 .. n.

Filter. It has two parts. The head holds the bigrams that occur at least once in
every ``2 * head_entries`` bytes of text: however large the corpus, they are a
few times ``head_entries`` at most, and their filter is broadcast to all workers. It is
the smaller part of the bigrams but answers for most of the places where one
stands. The tail holds all others, those seen once too; it grows with the
corpus and can't be broadcast, so it stays where it is counted, in one filter a
bucket: each chunk sends its distinct bigrams that are not in the head, the
buckets probe, and answer with levels. No bigram is left out at any size.

Scoring. A bigram's level is found by probing levels until one is absent; the
least count c2 of the level stands for the bigram's. It is interpolated with the
token's own add-half estimate P1, P(w | v) = weight * min(c2 / c(v), 1) + (1 -
weight) * P1(w), and a text's score is the sum of log10 P over its tokens. The
history of the first token is the end token; an unseen history leaves P1. As no
level's count is over the true one, the P of all tokens after a history add up
to one at most, but for the false hits of the filter (under 1 in 100 bigrams of
the tail, which then count as seen once, and under 1 in 10,000 in the head).
The weight of 0.5 gives the held-out texts of 10,000 documents the highest
probability of 0.25, 0.5 and 0.75 and of Dirichlet priors from 1 to 1,000 tokens.

Tokens are the words with A-Z in lower case, then one end token per text.

Defined results: null and empty texts have the end token only; rows are counted
and scored one by one; a null id counts as empty text for the split; with no
training text every probability is that of the empty counts (log10 of 1).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fingerprints as fp
from . import rounds
from .shared import written

CHUNK_BYTES = 4_000_000
BUCKET_BYTES = 8_000_000
HEAD_ENTRIES = 1 << 20
#: Bits an entry and hashes of the two parts; a false hit in the head would take a rare bigram for a frequent one.
TAIL_BITS, TAIL_HASHES = 10, 7
HEAD_BITS, HEAD_HASHES = 20, 14
WEIGHT = 0.5
END = 0x9A3F5C7E1B2D4F68
_PAIR = fp.U64(0xA24BAED4963EE407)
_STEP = fp.U64(0x9FB21C651E98DF25)


def tokens(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token fingerprints with an end token after each row's words, the token before each, and the rows' offsets."""
    data, offsets = fp.text_bytes(rows.column("text"))
    values, offsets = fp.words(fp.lower_ascii(data), offsets)
    values = np.insert(values, offsets[1:], fp.U64(END))
    offsets = offsets + np.arange(len(offsets))
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[offsets[:-1]] = END
    return values >> fp.FLAG_BITS, before >> fp.FLAG_BITS, offsets


def pairs(before: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Bigram fingerprints of ``bits`` bits."""
    return fp.mix(before * _PAIR + fp.mix(values)) >> fp.U64(64 - bits)


def _positions(keys: np.ndarray, level: int, i: int, sizes) -> np.ndarray:
    """The i-th bit of each key at a level, in a filter part of ``sizes`` bits."""
    a = fp.mix(keys + _STEP * np.full(1, level, fp.U64))
    return (a + np.full(1, i, fp.U64) * (fp.mix(a) | fp.U64(1))) % sizes


def levels_of(counts: np.ndarray, least: int) -> np.ndarray:
    """Quantised counts: 0 below ``least``, then one more for each doubling."""
    ratio = counts.astype(np.int64) // least
    return np.where(ratio > 0, 1 + np.floor(np.log2(np.maximum(ratio, 1) + 1e-9)).astype(np.int64), 0)


def least_count(level: np.ndarray, least: int) -> np.ndarray:
    """The smallest count of a level; 0 for level 0."""
    return np.where(level > 0, least * np.exp2(level - 1.0), 0.0)


def build_part(keys: np.ndarray, counts: np.ndarray, least: int, bits_per_entry: int = TAIL_BITS, hashes: int = TAIL_HASHES) -> bytes:
    """One bucket's part of a filter: the keys counted ``least`` times or more."""
    level = levels_of(counts, least)
    keys, level = keys[level > 0], level[level > 0]
    size = max(64, int(level.sum()) * bits_per_entry)
    bits = np.zeros(-(-size // 8) * 8, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        own = keys[level >= j]
        for i in range(hashes):
            bits[_positions(own, j, i, fp.U64(size))] = True
    return size.to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Some buckets' parts of a filter, for probing."""

    def __init__(self, parts: dict[int, bytes], bits: int, buckets: int, hashes: int = TAIL_HASHES):
        self.hashes = hashes
        self.sizes, self.base = np.ones(buckets, fp.U64), np.zeros(buckets, np.int64)
        self.held, data, at = np.zeros(buckets, bool), [], 0
        for b, part in parts.items():
            self.sizes[b], self.base[b], self.held[b] = int.from_bytes(part[:8], "little"), at, True
            data.append(np.frombuffer(part, np.uint8, offset=8))
            at += len(part) - 8
        self.data = np.concatenate(data) if data else np.zeros(1, np.uint8)
        self.edges = np.array([-(-(b << bits) // buckets) for b in range(1, buckets)], fp.U64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key; 0 where its bucket is not here."""
        bucket = np.searchsorted(self.edges, keys, side="right")
        level = np.zeros(len(keys), np.int64)
        alive, j = np.flatnonzero(self.held[bucket]), 1
        while len(alive) and j <= 62:
            for i in range(self.hashes):
                of = bucket[alive]
                place = _positions(keys[alive], j, i, self.sizes[of]).astype(np.int64)
                alive = alive[(self.data[self.base[of] + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1]
            level[alive] = j
            j += 1
        return level


def _head(shared) -> Filter:
    """The broadcast head, laid out once per worker; its name tells models apart."""
    name, *parts = shared.value
    if name not in _HEADS:
        _HEADS.clear()
        _HEADS[name] = Filter(*parts, HEAD_HASHES)
    return _HEADS[name]


_HEADS: dict[str, Filter] = {}


def score(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", weight: float = WEIGHT,
    chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, head_entries: int = HEAD_ENTRIES,
) -> DataFrame:
    """Per row: id, train, n_tokens, n_known, train_tokens, base_score, score. The model is learned from rows where ``train``."""
    plan = rounds.layout(docs, text_col, chunk_bytes, bucket_bytes)
    corpus = rounds.chunked(docs, id_col, text_col, plan, train=F.coalesce(train, F.lit(False)))
    bits, buckets = plan.filter_bits, plan.buckets
    frequent = max(1, plan.total_bytes // (2 * head_entries))

    def count(rows: pa.Table, _, __):
        values, before, offsets = tokens(rows)
        learned = np.repeat(rows.column("train").to_numpy().astype(bool), np.diff(offsets))
        every = np.unique(values)
        own, n = np.unique(values[learned], return_counts=True)
        counts = np.zeros(len(every), fp.U64)
        counts[np.searchsorted(every, own)] = n
        two, m = np.unique(pairs(before[learned], values[learned], bits), return_counts=True)
        return fp.by_bucket(every, 62, buckets, counts) + [(b + buckets, x) for b, x in fp.by_bucket(two, bits, buckets, m.astype(fp.U64))], None

    def add_up(key, rows):
        bucket = key[0].as_py()
        parts = [fp.unpack(b, 2) for b in rows.column("blob").to_pylist()]
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        if bucket >= buckets:
            rare = counts < frequent
            out = [(bucket, -1, build_part(keys, counts, frequent, HEAD_BITS, HEAD_HASHES), "head", 0, 0), (bucket, -1, build_part(keys[rare], counts[rare], 1), "tail", 0, 0)]
        else:
            out = [(bucket, -1, b"", "size", int(counts.sum()), int((counts > 0).sum()))]
            out += [(bucket, c, fp.pack_aligned(counts[np.searchsorted(keys, p[0])]), "counts", 0, 0) for c, p in zip(rows.column("chunk").to_pylist(), parts, strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "chunk", "blob", "kind", "n", "v"])

    said = written(rounds.ask(corpus, count).groupBy("bucket").applyInArrow(add_up, f"{rounds.SENT}, kind string, n long, v long"), "lm-counts")
    n_train, n_types = said.where("kind = 'size'").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    head = {r["bucket"] - buckets: bytes(r["blob"]) for r in said.where("kind = 'head'").select("bucket", "blob").collect()}  # bounded by head_entries
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, head, bits, buckets))

    def questions(rows: pa.Table, _, __):
        values, before, _ = tokens(rows)
        two = np.unique(pairs(before, values, bits))
        return [(b + buckets, x) for b, x in fp.by_bucket(two[_head(shared).levels(two) == 0], bits, buckets)], None

    def probe(key, rows, held):
        bucket = key[0].as_py()
        part = Filter({bucket - buckets: held.column("blob")[0].as_py()} if held.num_rows else {}, bits, buckets)
        out = [fp.squeeze(part.levels(fp.unpack(blob)[0]).astype(np.uint8)) for blob in rows.column("blob").to_pylist()]
        return pa.table({"bucket": rows.column("bucket"), "chunk": rows.column("chunk"), "blob": pa.array(out, pa.binary())})

    tail = said.where("kind = 'tail'").select("bucket", "blob")
    levels = rounds.ask(corpus, questions).groupBy("bucket").cogroup(tail.groupBy("bucket")).applyInArrow(probe, rounds.SENT)
    answers = said.where("kind = 'counts'").select("bucket", "chunk", "blob").unionByName(levels)

    def scored(rows: pa.Table, heard: dict[int, bytes], _) -> pa.Table:
        values, before, offsets = tokens(rows)
        keys, counts = np.unique(values), fp.unpack_aligned(b for k, b in heard.items() if k < buckets).astype(np.float64)
        c = counts[np.searchsorted(keys, values)]
        place = np.minimum(np.searchsorted(keys, before), len(keys) - 1)  # every history is a token here, the end token too
        history = counts[place]
        p1 = (c + 0.5) / (n_train + 0.5 * (n_types + 1))
        two, back = np.unique(pairs(before, values, bits), return_inverse=True)
        level = _head(shared).levels(two)
        seen = least_count(level, frequent)
        rare = [np.frombuffer(fp.stretch(b, np.uint8, -1), np.uint8) for k, b in heard.items() if k >= buckets]
        seen[level == 0] = least_count(np.concatenate([np.zeros(0, np.int64), *rare]).astype(np.int64), 1)
        share = np.minimum(seen[back] / np.maximum(history, 1.0), 1.0)
        log_p = np.log10(np.where(history > 0, weight * share + (1 - weight) * p1, p1))
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        total = lambda x: np.bincount(row, weights=x, minlength=len(offsets) - 1)
        return pa.table({
            "id": rows.column("id"), "train": rows.column("train"), "n_tokens": pa.array(np.diff(offsets), pa.int64()),
            "n_known": pa.array(total(c > 0).astype(np.int64)), "base_score": pa.array(total(np.log10(p1))), "score": pa.array(total(log_p)),
        })

    rows = rounds.finish(corpus, answers, scored, f"id {dict(docs.dtypes)[id_col]}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return rows.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
