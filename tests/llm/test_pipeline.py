"""The pipeline's stages against brute force on a small corpus, each on what the one before kept."""

import hashlib
import random

import corpus_pipeline
import pytest
from millrace.llm import byte_bpe, mixing
from millrace.llm.shared import written
from pyspark.sql import functions as F
from test_operators import PATTERN, RANKS, WORD, brute_classes, brute_measures
from test_repeats import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda: r.choice("abcdéfghij") + r.choice("klmnopqrst") * r.randrange(1, 4) + r.choice("uvwxyz")
    passage = " ".join(word() for _ in range(80))
    texts = [" ".join(word() for _ in range(r.randrange(60, 200))) for _ in range(40)]
    texts += [t.replace("a", "a", 1) for t in texts[:5]] + [texts[6] + " extra words here"]
    texts += [passage + " " + " ".join(word() for _ in range(90)) for _ in range(6)]
    texts += ["too short", "# % & | < " * 30, "again and again " * 60, None, ""]
    rows = [(i, t, "en", r.choice(["a", "b", "c", None]), len(t) if t else 0) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def passes(text):
    n, chars, symbols, dup, rep = brute_measures(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    letters, capitals = sum(c.isalpha() for c in text or ""), sum(c.isupper() for c in text or "")
    return not (n < 10 or 100 * rep > 20 * n or 5 * symbols > n or chars > 15 * n or chars < 2 * n or 10 * dup > 3 * len(lines) or 2 * capitals > letters)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "mixing", "byte_bpe"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], corpus), name))
    for kept in seen[1:-1]:
        assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
    rows = [{r["doc_id"]: r for r in x.collect()} for x in seen[:4]]
    assert set(rows[1]) == {i for i, r in rows[0].items() if passes(r["text"])} and len(rows[1]) < len(rows[0])
    ordered = sorted((i, r["text"]) for i, r in rows[1].items())
    first = {}
    for (i, _), c in zip(ordered, brute_classes(ordered), strict=True):
        first.setdefault(c, i)
    assert set(rows[2]) == set(first.values()) and len(rows[2]) < len(rows[1])
    items = [(i, r["text"].encode()) for i, r in sorted(rows[2].items())]
    cut = 0
    for (i, data), gone in zip(items, brute([d for _, d in items], 200), strict=True):
        want = bytes(b for b, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
        assert rows[3][i]["text"] == want and rows[3][i]["n_chars"] == len(want)
        cut += any(gone)
    assert cut >= 5
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(seen[3]).collect()}
    mixed = seen[4].groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in mixed} == {i: n for i, n in taken.items() if n}
    own = byte_bpe.codec(RANKS, PATTERN)
    want = sorted((r["doc_id"], len(own.encode(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in seen[4].collect())
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in seen[5].collect()) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, corpus).collect())) == sorted(map(tuple, seen[5].collect()))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
