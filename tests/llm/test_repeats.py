"""Repeated words and bytes against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from millrace.llm import fingerprints as fp
from millrace.llm import rounds
from millrace.llm.substring_dedup import repeated_pairs, repeated_words, told_pairs
from millrace.llm.suffix_dedup import COVERS, cover_for, rank_suffixes, repeated_bytes, without_repeats


def brute(items, n):
    """Kept items and removed positions of each sequence."""
    seen = Counter(tuple(x[i : i + n]) for x in items for i in range(len(x) - n + 1))
    out = []
    for x in items:
        gone = [False] * len(x)
        for i in range(len(x) - n + 1):
            if seen[tuple(x[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append(gone)
    return out


def corpus(seed, words=False):
    """Random texts with copies, near copies, shared passages, nulls and a very long one."""
    r = random.Random(seed)
    unit = (lambda n: " ".join(r.choice(["ab", "é", "zz", "q\n", "w\t"]) + r.choice("abcdefgh") for _ in range(n))) if words else (lambda n: "".join(r.choice("abcdefgh é\n") for _ in range(n)))
    base = [unit(r.randrange(0, 400)) for _ in range(25)]
    passage = unit(150)
    for i in range(12):
        cut = r.randrange(0, 150)
        base.append(unit(50) + " " + passage[cut : cut + r.randrange(20, 600)] + unit(r.randrange(60)))
    for i in range(8):
        x = r.choice(base)
        k = r.randrange(len(x) + 1)
        base += [x, x[:k] + r.choice(["é", " zq ", ""]) + x[k + 1 :]]
    base += [None, "", "   ", unit(3000), (unit(40) + " ") * 6]
    return [(r.choice([i, i, None]) if i % 9 == 0 else i, t) for i, t in enumerate(base)] + [(3, base[3]), (3, base[3])]


@pytest.mark.parametrize(("seed", "window"), [(1, 35), (2, 35), (3, 4), (4, 1)])
def test_words(spark, seed, window):
    rows = corpus(seed, words=True)
    got = repeated_words(spark.createDataFrame(rows, "doc_id long, text string"), window, chunk_bytes=4_000, bucket_bytes=3_000).collect()
    items = [(t or "").encode().split() for _, t in rows]
    want = []
    for (i, _), x, gone in zip(rows, items, brute(items, window), strict=True):
        want.append((i, len(x), sum(gone), b" ".join(w for w, g in zip(x, gone, strict=True) if not g).decode()))
    assert Counter(map(tuple, got)) == Counter(want)
    assert window > 30 or sum(w[2] for w in want)


@pytest.mark.parametrize(("seed", "length"), [(1, 200), (2, 200), (5, 200), (3, 120), (4, 20), (6, 1)])
def test_bytes(spark, seed, length):
    rows = corpus(seed)
    got = repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), length, chunk_bytes=2_000, bucket_bytes=1_000).collect()
    items = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), x, gone in zip(rows, items, brute(items, length), strict=True):
        edges = [k for k in range(len(x) + 1) if (k > 0 and gone[k - 1]) != (k < len(x) and gone[k])]
        want.append((i, len(x), sum(gone), tuple(edges[::2]), tuple(edges[1::2]), hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    mine = [(g[0], g[1], g[2], tuple(g[3]), tuple(g[4]), hashlib.sha256(bytes(g[5])).hexdigest()) for g in got]
    assert Counter(mine) == Counter(want)
    assert sum(w[2] for w in want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, chunk string, blob int")
    assert repeated_words(empty).collect() == []
    assert repeated_bytes(empty).collect() == []


def test_cover():
    for period, residues in COVERS.items():
        assert {(a - b) % period for a in residues for b in residues} == set(range(period))
    assert [cover_for(n)[0] for n in (200, 198, 197, 50, 1)] == [133, 133, 91, 31, 1]


def test_ranks_are_the_order_of_the_bytes():
    """Sample suffixes of several chunks, ranked in one bucket: equal bytes have equal ranks, and the ranks ascend with the bytes."""
    prefix, r = 110, random.Random(4)
    pool = sorted({bytes(r.choice(b"ab\x00\xff") for _ in range(prefix)) for _ in range(40)} | {b"a" * 60 + bytes([c]) * 50 for c in (0, 7, 255)} | {b"a" * 109 + bytes([c]) for c in (0, 255)})
    chunks = [r.sample(pool, 25) for _ in range(4)]
    multi = [[r.random() < 0.1 for _ in c] for c in chunks]
    blobs = [fp.bundle(np.packbits(m).tobytes(), fp.squeeze(np.frombuffer(b"".join(c), np.uint8))) for c, m in zip(chunks, multi, strict=True)]
    ranks = [fp.unpack_aligned([b]).tolist() for b in rank_suffixes(prefix)(blobs)]
    places = Counter()
    for c, m in zip(chunks, multi, strict=True):
        for suffix, twice in zip(c, m, strict=True):
            places[suffix] += 1 + twice
    order = {s: i + 1 for i, s in enumerate(sorted(places))}
    for c, own in zip(chunks, ranks, strict=True):
        assert own == [order[s] if places[s] > 1 else 0 for s in c]


def test_repeated_rows_lie_in_several_chunks(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text)] * 5000, "doc_id long, text string").coalesce(2)
    plan = rounds.layout(df, "text", 50_000, 50_000)
    assert rounds.chunked(df, "doc_id", "text", plan).count() > 15
    got = repeated_words(df, 35, chunk_bytes=50_000, bucket_bytes=50_000).groupBy("doc_id", "n_words", "n_removed", "kept").count().collect()
    assert [tuple(g) for g in got] == [(None, 60, 60, "", 5000)]
    got = repeated_bytes(df, 150, chunk_bytes=50_000, bucket_bytes=50_000).groupBy("n_removed").count().collect()
    assert [tuple(g) for g in got] == [(len(text), 5000)]


def test_pairs_are_told_apart_by_their_checks():
    """Two windows of one value but different checks are not a repeat."""
    a = fp.pack(np.array([5 << 2, 9 << 2], np.uint64), np.array([1, 1], np.uint64))
    b = fp.pack(np.array([5 << 2, 9 << 2], np.uint64), np.array([2, 1], np.uint64))
    assert [[x.tolist() for x in fp.unpack(o, 2)] for o in repeated_pairs([a, b])] == [[[9], [1]], [[9], [1]]]
    told = {0: fp.pack(np.array([5, 5, 9], np.uint64), np.array([1, 2, 1], np.uint64))}
    value, check = np.array([5, 5, 5, 9, 8], np.uint64), np.array([1, 2, 3, 1, 1], np.uint64)
    assert told_pairs(told, value, check).tolist() == [True, True, False, True, False]


def test_clashing_columns_and_lost_characters(spark):
    text = "é" * 150
    rows = [(1, text + "x", "a", 151, 7), (2, "y" + text, "b", 151, 8), (3, None, None, 0, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, n_chars long, chunk int")
    got = {r["doc_id"]: tuple(r) for r in without_repeats(df, 200).collect()}
    assert got == {1: (1, "x", "a", 1, 7), 2: (2, "y", "b", 1, 8), 3: (3, None, None, 0, 9)}
