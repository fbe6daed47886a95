"""The other operators against brute force, round trips and edge cases."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from millrace.llm import byte_bpe, lm_score, media, minhash, mixing, quality, token_counts, warc
from millrace.llm.safe_split import pieces, space_runs
from pyspark.sql import functions as F

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " ", "   \n\t ", "a", "The quick  brown\n\n fox's tail", "é 日本語 😀 ́x", "x<|endoftext|>y <|endoftext|>", " " * 5000 + "end", "tab\t" * 2000, "w" * 30_000, "ab cd " * 20_000, "a\r\nb\x0bc\x0cd",
    "\x00\x01 null", "'s 're'' it's", "1234567 89", "a b c　d",
]


def docs(spark, texts, **more):
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    return df.select("doc_id", "text", F.col("n").alias("id"), F.lit("x").alias("chunk"), *(F.lit(v).alias(k) for k, v in more.items()))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, chunk string, n_chars long, id int")


# token counts and byte pairs


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    df = docs(spark, ODD)
    for piece in (50, 100_000):
        own = token_counts.counter(JSON, PATTERN)
        assert [own.count(t or "", piece) for t in ODD] == [len(library.encode(t or "", add_special_tokens=False)) for t in ODD]
    got = token_counts.token_counts(df, JSON, PATTERN).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(library.encode(t or "", add_special_tokens=False)) for t in ODD)
    assert sum(r["doc_id"] is None for r in got) == 3 and all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.token_counts(empty(spark), JSON, PATTERN).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(name):
    path = public_tokenizers.path(name)
    own = token_counts.counter(path, None)
    assert own.count("", 10) == 0 and own.count("Hello world", 10) == own.count("Hello world", 100) > 0


def test_safe_pieces():
    r = random.Random(0)
    for _ in range(200):
        t = "".join(r.choice("ab1 \n é'") for _ in range(r.randrange(200)))
        assert "".join(pieces(t, 20)) == t and "".join(x for _, x in space_runs(t, 2)) == t
        own = byte_bpe.codec(RANKS, PATTERN)
        ids = [i for is_run, x in space_runs(t, 2) for i in (own.library._encode_single_piece(x) if is_run else sum((own.library.encode_ordinary(p) for p in pieces(x, 20)), []))]
        assert ids == own.library.encode_ordinary(t)


def test_byte_bpe(spark):
    own = byte_bpe.codec(RANKS, PATTERN)
    for t in ODD:
        ids = own.encode(t or "", 100)
        assert own.decode(ids) == (t or "").encode() and ids == own.library.encode_ordinary(t or "")
    assert own.decode(own.encode(" " * 1_000_000 + "x")) == b" " * 1_000_000 + b"x"
    got = byte_bpe.round_trip(docs(spark, ODD), RANKS, PATTERN).collect()
    want = Counter(hashlib.sha256((t or "").encode()).hexdigest() for t in ODD)
    assert Counter(r["decoded_sha256"] for r in got) == want
    ids = own.library.encode_ordinary(ODD[5])
    assert hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() in {r["ids_sha256"] for r in got}
    df = docs(spark, ODD[:8])
    back = byte_bpe.decode(byte_bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN)
    assert Counter(bytes(r["decoded"]).decode() for r in back.collect()) == Counter(t or "" for t in ODD[:8])
    assert byte_bpe.round_trip(empty(spark), RANKS, PATTERN).collect() == []


# quality


def brute_measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(spark):
    r = random.Random(5)
    texts = [*ODD, "a b c d e a b c d e f", "x " * 300, "line one\n" * 30, "A!! B!! " * 20, "a# b# c# " * 5]
    texts += [" ".join(r.choice(["aa", "bb", "cc\n", "D#"]) for _ in range(r.randrange(60))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        g = got[i]
        n, chars, symbols, dup, rep = brute_measures(t)
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (n, chars, symbols, dup, rep), t
        assert g["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert not (g["kept"] and g["base_failed"])
    kept = quality.keep_quality(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, g in got.items() if g["kept"]} and kept.columns == ["doc_id", "text"]
    assert quality.judge(empty(spark)).collect() == [] and quality.keep_quality(empty(spark)).collect() == []


def test_rules_are_asked_only_where_no_earlier_one_rejects(spark):
    df = spark.createDataFrame([("few words",), ("a # b # c # " * 9,)], "text string")
    bomb = quality.Rule("bomb", lambda m: F.raise_error(F.lit("asked")).cast("boolean"))
    asked = df.select(quality.rejected_by([quality.BASE[0], quality.RULES[0], bomb], quality.measures(F.col("text"))).alias("by"))
    assert [r["by"] for r in asked.collect()] == ["few_words", "symbols"]
    plan = quality.judge(df.withColumn("doc_id", F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.split("\n") if r"\p{L" in x]
    assert lines and all("CASE WHEN" in x[: x.index(r"\p{L")] for x in lines)


def test_cascade_order(spark):
    df = spark.createDataFrame([("a" * 50,)] * 40 + [("b",)] * 10, "text string")
    cheap = quality.Rule("cheap", lambda m: m["n_symbols"] >= 0)
    never = quality.Rule("never", lambda m: m["n_repeat_words"] < 0)
    assert [r.name for r in quality.order_rules(df, (never, cheap))] == ["cheap", "never"]


# mixing


def test_apportion(spark):
    parties = spark.createDataFrame([("a", 53.0, 10), ("b", 24.0, 10), ("c", 23.0, 10), ("z", 0.0, 10)], "key string, v double, s long")
    got = {r["key"]: r["n"] for r in mixing.apportion(parties, ["s"], ["key"], "v", "s", "n").collect()}
    assert got == {"a": 5, "b": 3, "c": 2, "z": 0} or sum(got.values()) == 10
    r = random.Random(2)
    for seats in (1, 7, 100):
        votes = {f"p{i}": float(r.randrange(1, 1000) ** r.choice([1, 2])) for i in range(12)}
        won = Counter(k for _, k in sorted(((-v / (2 * i + 1), k) for k, v in votes.items() for i in range(seats + 1)))[:seats])
        df = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "key string, v double, s long")
        assert {x["key"]: x["n"] for x in mixing.apportion(df, ["s"], ["key"], "v", "s", "n").collect()} == {k: won.get(k, 0) for k in votes}


def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = float(sum(sizes.values())), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > repeats * sizes[s]]
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
            free.discard(s)
    return target


def test_mixing(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        s = r.choice(["a", "a", "a", "b", "é", None, "tiny"] if i % 40 else ["tiny"])
        s = "a" if s == "tiny" and i % 40 else s
        rows.append((i, " ".join(["w"] * (r.randrange(1, 5) if s == "tiny" else r.randrange(0, 300))), s))
    rows += [(None, None, "b"), (1, "dup dup", "a"), (1, "dup dup", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block_words=8, shard_words=5_000).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = brute_targets(sizes), Counter()
    assert len(got) == len(rows)
    for g in got:
        assert g["source_size"] == sizes[g["source"]] and math.isclose(g["target"], want[g["source"]]) and 0 <= g["taken"] <= 3 * g["size"]
        taken[g["source"]] += g["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 8 * 10, (s, taken[s], t)
    again = mixing.mix(df.repartition(5), block_words=8, shard_words=5_000).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    made = mixing.mixed_documents(df.withColumn("n_chars", F.length("text").cast("long")), block_words=8, shard_words=5_000)
    assert made.columns == ["doc_id", "text", "source", "n_chars"]
    assert made.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.mix(empty(spark)).collect() == []
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()] == [0, 0]


# archives


def read_warc(data):
    """A record's fields, block and what follows it, as a reader of the format sees them."""
    head, rest = data.split(b"\r\n\r\n", 1)
    first, *lines = head.decode().split("\r\n")
    assert first == "WARC/1.1"
    fields = dict(x.split(": ", 1) for x in lines)
    assert len(fields) == len(lines)
    n = int(fields["Content-Length"])
    assert rest[n:] == b"\r\n\r\n"
    return fields, rest[:n]


def test_warc(spark):
    long, other = "é" * 600, "z" * 1000
    rows = [(1, "http://a/", long), (2, "http://b/\r\nX: y", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", other), (None, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"address": F.lit(1), "copies": F.lit("x"), "id": F.lit(2), "salt": F.lit(3)})
    archive = warc.write_archive(df, date="2024-05-06T07:08:09Z")
    got = {r["id"]: r for r in warc.read_records(spark, archive).collect()}
    assert len(got) == len(rows) and archive.payloads(spark).count() == 4
    ids = {}
    for i, url, html in rows:
        g, data = got[i], (html or "").encode()
        assert bytes(g["payload"]) == data and g["payload_bytes"] == len(data) and g["payload_sha1"] == hashlib.sha1(data).hexdigest()
        revisit = i in (1, 2, None)
        assert (g["record_type"], g["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
        assert bytes(g["record"]) == bytes(g["header"]) + (b"" if revisit else data) + b"\r\n\r\n"
        fields, block = read_warc(bytes(g["record"]))
        ids[i] = fields
        assert fields["WARC-Date"] == "2024-05-06T07:08:09Z" and fields["Content-Type"] == "application/http; msgtype=response" and fields["WARC-Type"] == g["record_type"]
        http, body = block.split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and body == (b"" if revisit else data) and fields["WARC-Payload-Digest"] == "sha1:" + g["payload_sha1"]
        assert ("WARC-Refers-To" in fields) == revisit
    assert len({f["WARC-Record-ID"] for f in ids.values()}) == len(rows) and {ids[i]["WARC-Refers-To"] for i in (1, 2, None)} == {ids[3]["WARC-Record-ID"]}
    assert "X" not in ids[2] and ids[1]["WARC-Refers-To-Target-URI"] == ids[3]["WARC-Target-URI"] == ""
    none = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_records(spark, none).collect() == []


def test_warc_text_ids_and_hot_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES_PER_SALT", 3)
    page = "<p>" * 400
    rows = [("p1", "u1", page), ("p:2 %", "u2", page), ("-", "u3", page), (None, "u4", page), ("i", "u5", "x")] + [(f"q{i}", f"v{i}", "") for i in range(20)]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id string, url string, html string"))
    got = warc.read_records(spark, archive).collect()
    assert Counter((r["id"], r["url"], bytes(r["payload"]).decode()) for r in got) == Counter(rows)
    assert {r["id"]: r["refers_to"] for r in got if r["record_type"] == "revisit"} == {"p1": "p:2 %", "-": "p:2 %", None: "p:2 %"}
    assert archive.headers(spark).select("salt").distinct().count() > 2


def test_damaged_payload(spark):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"))
    spark.createDataFrame([(hashlib.sha256(b"y").digest(), 1, b"not y")], "address binary, copies long, payload binary").write.mode("append").parquet(f"{archive.path}/payloads")
    with pytest.raises(Exception, match="differs from its address"):
        archive.payloads(spark).collect()


def test_media(spark):
    texts = [*ODD, "same", "same"]
    folder = media.write_archives(docs(spark, texts), archive_bytes=2_000)
    members = media.read_archives(spark, folder, range_bytes=300)
    assert members.rdd.getNumPartitions() > 5
    got = media.features(members).collect()
    assert len(got) == len(texts)
    by = {(r["payload_sha256"]): r for r in got}
    for t in texts:
        data = (t or "").encode()
        padded = media.pad(data)
        r = by[hashlib.sha256(padded).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(padded), zlib.crc32(padded[-64:])) and len(padded) % 64 == 0 and len(padded) >= 64
        assert media.decode_png(media.encode_png(padded)).tobytes() == padded
    same = [tuple(r)[1:] for r in got if r["payload_sha256"] == hashlib.sha256(media.pad(b"same")).hexdigest()]
    assert len(same) == 2 and same[0] == same[1]
    assert media.features(media.read_archives(spark, media.write_archives(empty(spark)))).collect() == []


def test_member_retry(tmp_path):
    import pyarrow.fs as pafs

    path = str(tmp_path / "a")
    (tmp_path / "a").write_bytes(b"0123456789")
    fs = pafs.LocalFileSystem()

    class Flaky:
        calls = 0

        def read_at(self, size, offset):
            Flaky.calls += 1
            raise OSError("gone")

        def close(self):
            pass

    got, _ = media.read_member(fs, path, Flaky(), 3, 4, zlib.crc32(b"3456"))
    assert got == b"3456" and Flaky.calls == 1
    with pytest.raises(OSError, match="checksum"):
        media.read_member(fs, path, fs.open_input_file(path), 3, 4, 1)


# near duplicates


def bag(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows):
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            if a and b:
                both = sum((a & b).values())
                if both >= 0.8 * (sum(a.values()) + sum(b.values()) - both) - 1e-9:
                    parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def near_corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnopqrst") + r.choice("uvwxyz")
    base = [" ".join(word() for _ in range(r.choice([3, 40, 120, 300]))) for _ in range(25)]
    rows = list(base)
    for b in base:
        for _ in range(r.randrange(4)):
            w = b.split(" ")
            for _ in range(r.choice([0, 1, 2, 5])):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w))
    for i in range(60):  # a large group of near copies around one text, and a shared passage in unlike texts
        w = base[3].split(" ") + [word() for _ in range(100)] if False else (base[4] + " tail " + base[5]).split(" ")
        w[r.randrange(len(w))] = word()
        rows.append(" ".join(w))
        rows.append(base[6] + " " + " ".join(word() for _ in range(200)))
    rows += [None, "", "  ", "one two", "one two", "a a a a a a a a a a a a a", ("spam eggs " * 60), ("spam eggs " * 59)]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = near_corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tid", F.lit("clash")).withColumn("comp", F.lit(1))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    names, classes = brute_classes(rows), {}
    for (i, _), c in zip(rows, names, strict=True):
        classes.setdefault(c, set()).add(i)
    for (i, _), c in zip(rows, names, strict=True):
        assert got[i]["class_id"] == min(classes[c]) and got[i]["class_rows"] == len(classes[c]) and got[i]["keep"] == (i == min(classes[c]))
    left = minhash.deduplicated(df)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {min(c) for c in classes.values()}


def test_settling_many_outsiders(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SETTLE", 2)
    rows = near_corpus(3)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names, first = brute_classes(rows), {}
    for (i, _), c in zip(rows, names, strict=True):
        first.setdefault(c, i)
        assert got[i] == first[c]


def templated_corpus(seed, bands, rows):
    """Texts of one template, too unlike to be links, and for many a near copy that shares one band with it, which is the template's."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    edited = lambda words, places: " ".join(word() if i in places else w for i, w in enumerate(words))
    base, texts = [word() for _ in range(150)], []
    for i in range(160):
        one = edited(base, r.sample(range(150), 5))
        texts.append(one)
        if i < 50:
            near = [edited(one.split(" "), [r.randrange(10, 45), r.randrange(55, 90), r.randrange(100, 140)]) for _ in range(60)]
            signed = minhash.signatures(*minhash.shingles(pa.array([" ".join(base), one, *near]), 5), bands * rows).reshape(-1, bands, rows)
            same = (signed[2:] == signed[1]).all(axis=2)
            good = np.flatnonzero((same.sum(axis=1) == 1) & (same & (signed[1] == signed[0]).all(axis=1)).any(axis=1))
            texts += [near[k] for k in good[:1]]
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [1000, 40])
def test_links_within_a_templated_group(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block, raising=False)
    rows = templated_corpus(1, 8, 4)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=8, rows=4).collect()}
    names, first = brute_classes(rows), {}
    for (i, _), c in zip(rows, names, strict=True):
        first.setdefault(c, i)
    assert len(rows) > 180 and len(first) < len(rows) - 15
    assert [i for (i, _), c in zip(rows, names, strict=True) if got[i] != first[c]] == []


def test_clashing_names_survive(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text, "mine", 5, "r"), (2, text, "yours", 6, "s")], "doc_id long, text string, tid string, nth int, row string")
    assert [tuple(r) for r in minhash.deduplicated(df).collect()] == [(1, text, "mine", 5, "r")]


def test_recall_on_documents(spark):
    """Against all pairs of a whole table: every row's class is the brute-force one."""
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    df = spark.read.parquet(path)
    rows = sorted((r["doc_id"], r["text"]) for r in df.collect())
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    names, first = brute_classes(rows), {}
    for (i, _), c in zip(rows, names, strict=True):
        first.setdefault(c, i)
    assert [i for (i, _), c in zip(rows, names, strict=True) if got[i] != first[c]] == []


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 2), (None, "x y z", 3), (None, "x y z", 4), (5, None, 5), (None, "", 6)], "doc_id long, text string, n long")
    left = sorted(r["n"] for r in minhash.deduplicated(df).collect())
    assert left == [1, 3, 5, 6]
    assert minhash.near_duplicates(df).count() == 6
    assert minhash.near_duplicates(empty(spark)).collect() == [] and minhash.deduplicated(empty(spark)).collect() == []


def test_signatures_are_unbiased():
    r = random.Random(1)
    a = [f"w{r.randrange(500)}" for _ in range(400)]
    b = list(a)
    for _ in range(12):
        b[r.randrange(400)] = "q"
    texts = [" ".join(a), " ".join(b), " ".join(["a b c d e f g"] * 30 + a[:50]), " ".join(["a b c d e f g"] * 20 + a[:50])]
    row, key, weight, total = minhash.shingles(pa.array(texts), 5)
    signed = minhash.signatures(row, key, weight, total, 4096)
    for i, j in ((0, 1), (2, 3), (0, 2)):
        x, y = bag(texts[i]), bag(texts[j])
        both = sum((x & y).values())
        true = both / (sum(x.values()) + sum(y.values()) - both)
        assert abs(float((signed[i] == signed[j]).mean()) - true) < 0.04


# language model


def lm_rows(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(60)]
    return [(i if i % 11 else None, None if i == 5 else "" if i == 6 else " ".join(vocabulary[min(59, int(r.expovariate(0.1)))] for _ in range(r.randrange(1, 80)))) for i in range(n)]


def brute_base(rows, held):
    tok = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] + [None]
    count = Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            count.update(tok(t))
    n, v = sum(count.values()), len(count)
    return [(len(tok(t)), sum(count[w] > 0 for w in tok(t)), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t))) for _, t in rows]


def brute_scores(rows, held, weight=0.5, frequent=1 << 60):
    """The interpolated model with true counts, quantised to the least of their level."""
    tok = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] + [None]
    one, two = Counter(), Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            one.update(tok(t))
            two.update(zip([None, *tok(t)], tok(t), strict=False))
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))

    def least(c):
        unit = frequent if c >= frequent else 1
        return unit * 2 ** ((c // unit).bit_length() - 1) if c else 0

    def p(a, w):
        return weight * min(least(two[a, w]) / one[a], 1) + (1 - weight) * p1(w) if one[a] else p1(w)

    return [sum(math.log10(p(a, w)) for a, w in zip([None, *tok(t)], tok(t), strict=False)) for _, t in rows]


@pytest.mark.parametrize("head_entries", [1 << 20, 20, 1])
def test_lm_score(spark, head_entries):
    rows = lm_rows(1)
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit("clash"))
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    got = lm_score.score(df, train, chunk_bytes=1_500, bucket_bytes=1_000, head_entries=head_entries).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted((a, b, c, round(d, 6)) for a, b, c, d in brute_base(rows, held))
    size = sum(len((t or "").encode()) for _, t in rows)
    want = {(r[0], round(b, 6)): s for r, (*_, b), s in zip(rows, brute_base(rows, held), brute_scores(rows, held, frequent=max(1, size // (2 * head_entries))), strict=True)}
    apart = [r["score"] - want[r["doc_id"], round(r["base_score"], 6)] for r in got]
    assert min(apart) > -1e-6 and np.mean(np.abs(apart) < 1e-6) > 0.5 and max(apart) < 6  # false hits only raise a score


def test_lm_without_training(spark):
    df = spark.createDataFrame(lm_rows(1), "doc_id long, text string")
    nothing = lm_score.score(df, F.lit(False)).collect()
    assert {r["train_tokens"] for r in nothing} == {0} and all(r["base_score"] == 0 and r["score"] == 0 for r in nothing)
    assert lm_score.score(empty(spark), F.lit(True)).collect() == []


def test_lm_probabilities_add_up(spark):
    """The probabilities of all texts of no or one word, the unseen one too, are at most 1 in all."""
    vocabulary = [f"w{i}" for i in range(30)]
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(vocabulary[: 1 + i % 30]) for _ in range(20))) for i in range(60)]
    probes = [(1000 + i, w) for i, w in enumerate([*vocabulary, "never"])]
    got = {x["doc_id"]: x["score"] for x in lm_score.score(spark.createDataFrame([*rows, *probes, (2000, "")], "doc_id long, text string"), F.col("doc_id") < 1000).collect()}
    assert all(s < 0 for s in got.values())
    first = 10 ** got[2000]  # the end token after the end token
    assert first + sum(10 ** got[i] for i, _ in probes) <= 1.001


def test_lm_prefers_seen_order(spark):
    seen = [(i, "the cat sat on the mat and the dog lay by the door") for i in range(20)]
    rows = [*seen, (100, "the cat sat on the mat"), (101, "mat the on sat cat the")]
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 100).collect()}
    assert got[100]["base_score"] == pytest.approx(got[101]["base_score"]) and got[100]["score"] > got[101]["score"] + 2


def test_lm_knows_bigrams_seen_once(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(i, "the cat sat on the mat") for i in range(20)] + [(50, " ".join(words)), (100, " ".join(words)), (101, " ".join(words[::-1]))]
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 100).collect()}
    n, types = got[100]["train_tokens"], 5 + 30 + 1
    once, end = 1.5 / (n + 0.5 * (types + 1)), 21.5 / (n + 0.5 * (types + 1))
    true = math.log10(0.5 / 21 + 0.5 * once) + 29 * math.log10(0.5 + 0.5 * once) + math.log10(0.5 + 0.5 * end)
    assert got[100]["score"] == pytest.approx(true) == pytest.approx(got[50]["score"])
    assert got[101]["base_score"] == pytest.approx(got[100]["base_score"]) and got[101]["score"] < got[100]["score"] - 10


def test_filter_levels():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5_000).astype(np.uint64))
    counts = np.random.default_rng(2).integers(1, 200, len(keys))
    true = lm_score.levels_of(counts, 2)
    for bits, hashes, exact in ((lm_score.TAIL_BITS, lm_score.TAIL_HASHES, 0.97), (lm_score.HEAD_BITS, lm_score.HEAD_HASHES, 0.999)):
        level = lm_score.Filter({0: lm_score.build_part(keys, counts, 2, bits, hashes)}, 40, 1, hashes).levels(keys)
        assert (level >= true).all() and (level == true).mean() > exact
    assert lm_score.levels_of(np.array([0, 1, 2, 3, 4, 7, 8]), 2).tolist() == [0, 0, 1, 1, 2, 2, 3]
    assert lm_score.least_count(np.array([0, 1, 2, 3]), 2).tolist() == [0.0, 2.0, 4.0, 8.0]
