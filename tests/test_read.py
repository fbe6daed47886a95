"""Reads: projections, grouping, ordering, pages, vectors, explain, on hand-made rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from millrace.functions.stemmers import STEMMERS
from millrace.functions.stemming import stem
from millrace.operators import fts, vector
from millrace.operators.vector_index import VectorIndex
from millrace.plans import explain
from millrace.plans.errors import QueryError
from millrace.sources.catalog import Engine
from pyspark.sql import functions as F

TRIPS = [("t1", "ines", 12, "n"), ("t2", "omar", 340, "s"), ("t3", "ines", 8, "s"), ("t4", "ines", 31, "n"), ("t5", "yuki", 90, "n"), ("t6", "omar", 5, "s")]
DEPTHS = [("a", None), ("b", 4), ("c", -1), ("d", None), ("e", 9)]
GRADES = [("k1", 3), ("k2", 3), ("k3", 8), ("k4", 8), ("k5", 8), ("k6", 8), ("k7", 21)]


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.register("trips", spark.createDataFrame(TRIPS, "id string, driver string, km long, zone string"), id_col="id")
    e.register("depths", spark.createDataFrame(DEPTHS, "id string, metres long"), id_col="id")
    e.register("grades", spark.createDataFrame(GRADES, "id string, grade long"), id_col="id")
    return e


def rows(engine, **spec):
    return [tuple(r) for r in engine.read(spec).df.collect()]


def agg(func, field, alias, **more):
    return {"type": "aggregate", "func": func, "field": [field], "alias": alias, **more}


def lib(name, field, *args, **more):
    return {"type": "aggregate_fn", "name": name, "field": [field], "args": list(args), "alias": name, **more}


def test_aggregates(engine):
    assert rows(engine, **{"from": "trips", "select": [agg("sum", "km", "s"), agg("avg", "km", "a"), agg("count", "km", "n"), {"type": "count_all"}]}) == [(486, 81.0, 6, 6)]
    by = {"from": "trips", "group_by": {"fields": [["driver"]]}, "select": ["driver", agg("sum", "km", "s")], "order_by": ["driver"]}
    assert rows(engine, **by) == [("ines", 51), ("omar", 345), ("yuki", 90)]
    by["group_by"] = {"fields": [["driver"]], "having": {"op": "gt", "field": ["s"], "value": 60}}
    assert rows(engine, **by) == [("omar", 345), ("yuki", 90)]
    none = {"op": "eq", "field": ["driver"], "value": "nobody"}
    got = rows(engine, **{"from": "trips", "where": none, "select": [agg("sum", "km", "s"), agg("avg", "km", "a"), lib("string_agg", "driver"), lib("array_agg", "driver"), lib("range", "km"), lib("median", "km")]})
    assert got == [(0, None, "", [], 0, None)]


def test_library_aggregates(engine, spark):
    t = spark.createDataFrame([("1", 35, None, True), ("2", 30, "b", True), ("3", None, "a", False), ("4", 35, "b", None)], "id string, n int, s string, f boolean")
    engine.register("t", t, id_col="id")
    got = engine.read({"from": "t", "select": [lib("median", "n"), lib("percentile", "n", 0.9), lib("mode", "n"), lib("first", "s"), lib("last", "s"), lib("string_agg", "s", "+"), lib("array_agg", "s"), lib("bool_and", "f"), lib("bool_or", "f"), lib("count_distinct", "s"), lib("stddev", "n"), lib("variance", "n"), lib("range", "n")]}).df.first()
    assert tuple(got[:10]) == (35, 35, 35, "b", "b", "b+a+b", [None, "b", "a", "b"], False, True, 2)
    assert math.isclose(got[10] ** 2, got[11]) and got[12] == 5
    two = spark.createDataFrame([("1", 30), ("2", 35)], "id string, n long")
    engine.register("two", two, id_col="id")
    assert rows(engine, **{"from": "two", "select": [lib("median", "n"), lib("min", "n"), lib("max", "n"), lib("sum", "n"), lib("avg", "n"), lib("count", "n")]}) == [(30, 30, 35, 65, 32.5, 2)]
    with pytest.raises(QueryError):
        engine.read({"from": "two", "select": [lib("percentile", "n", 2)]})
    with pytest.raises(QueryError):
        engine.read({"from": "two", "select": [lib("nonsense", "n")]})


def test_order_and_nulls(engine):
    base = {"from": "depths", "select": ["id"]}
    order = lambda **k: "".join(r[0] for r in rows(engine, **base, order_by=[{"field": ["metres"], **k}]))
    base["select"] = ["id", "metres"]
    assert order() == "cbead"
    assert order(direction="desc") == "adebc"
    assert order(nulls="first") == "adcbe"
    assert order(direction="desc", nulls="last") == "ebcad"


def test_pages(engine):
    page = lambda **k: engine.read({"from": "grades", "select": ["id", "grade"], "order_by": ["grade"], "count_total": True, "pagination": k})
    first = page(mode="Page", page=2, page_size=3)
    assert [r["id"] for r in first.df.collect()] == ["k4", "k5", "k6"]
    assert first.pagination == {"total_count": 7, "total_pages": 3, "current_page": 2, "page_size": 3, "has_next": True, "has_prev": True}
    assert [r["id"] for r in page(mode="After", key=[8], limit=5).df.collect()] == ["k7"]
    assert [r["id"] for r in page(mode="After", key=[8], after_id="k4", limit=3).df.collect()] == ["k5", "k6", "k7"]
    assert [r["id"] for r in page(mode="LimitOffset", limit=2, offset=5).df.collect()] == ["k6", "k7"]
    unknown = engine.read({"from": "grades", "pagination": {"mode": "LimitOffset", "limit": 2}})
    assert unknown.pagination["has_next"] is False
    with pytest.raises(QueryError):
        page(mode="Page", page=0, page_size=3)
    assert [len(c) for c in engine.cursor({"from": "grades"}, size=3)] == [3, 3, 1]


def test_projection_rules(engine):
    assert engine.read({"from": "trips", "select": [{"type": "all"}]}).df.columns == ["id", "driver", "km", "zone"]
    for bad in ([{"type": "all"}, "id"], ["id", "id"], [{"type": "field", "path": ["id"], "alias": "x"}, {"type": "field", "path": ["driver"], "alias": "x"}]):
        with pytest.raises(QueryError):
            engine.read({"from": "trips", "select": bad})
    with pytest.raises(QueryError):
        engine.read({"from": "trips", "select": ["driver", {"type": "count_all"}]})
    with pytest.raises(QueryError):
        engine.read({"from": "nowhere"})
    half = {"type": "expr", "alias": "half", "expr": {"op": "div", "left": {"op": "field", "path": ["km"]}, "right": {"op": "literal", "value": 0}}}
    assert rows(engine, **{"from": "trips", "select": [half], "pagination": {"mode": "LimitOffset", "limit": 1}}) == [(None,)]
    assert len(rows(engine, **{"from": "trips", "select": {"items": ["zone"], "distinct": True}})) == 2


def test_vectors(spark, engine):
    t = spark.createDataFrame([("p", [3.0, 4.0]), ("q", [0.0, 2.0]), ("r", [-1.0, 0.0]), ("none", None)], "id string, v array<float>")
    engine.register("vectors", t, id_col="id")
    search = lambda **k: [r["id"] for r in engine.read({"from": "vectors", "where": {"op": "vector_similarity", "field": ["v"], "query": [0.0, 1.0], **k}}).df.collect()]
    assert search(k=2) == ["q", "r"]
    assert search(k=0) == []
    assert search(k=3, metric="dot") == ["p", "q", "r"]
    assert search(k=3, metric="cosine") == ["q", "p", "r"]
    with pytest.raises(QueryError):
        search(k=1, metric="nonsense")
    only = {"op": "and", "filters": [{"op": "vector_similarity", "field": ["v"], "query": [0.0, 1.0], "k": 1}, {"op": "ne", "field": ["id"], "value": "q"}]}
    assert [r["id"] for r in engine.read({"from": "vectors", "where": only}).df.collect()] == ["r"]
    assert vector.split({"op": "or", "filters": []})[0] is None


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_vector_index(spark, tmp_path, metric):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(30, 12)) * 2
    points = [(i, (middle[i % 30] + rng.normal(size=12)).tolist(), i % 3) for i in range(1500)] + [(1500, None, 0)]
    t = spark.createDataFrame(points, "id long, v array<float>, kind long")
    e = Engine(spark)
    e.register("points", t, id_col="id")
    index = e.create_vector_index("points", "cells", "v", f"file://{tmp_path}/x", metric)
    assert index.near([0.0] * 12, len(index.centres)).count() == 1500 and VectorIndex.open(spark, index.path).metric == metric
    found = total = 0
    for i in range(0, 1500, 250):
        search = {"op": "vector_similarity", "field": ["v"], "query": points[i][1], "k": 10, "metric": metric}
        exact = [r["id"] for r in e.read({"from": "points", "where": search}).df.collect()]
        found += len(set(exact) & {r["id"] for r in index.search(points[i][1], 10).collect()})
        total += 10
        assert [r["id"] for r in index.search(points[i][1], 10, probes=1500).collect()] == exact
    assert found / total >= 0.9
    only = {"op": "and", "filters": [{**search, "probes": 1500}, {"op": "eq", "field": ["kind"], "value": 1}]}
    got = e.read({"from": "points", "where": only}).df
    assert {r["kind"] for r in got.collect()} == {1} and got.columns[:3] == ["id", "v", "kind"]
    assert "Filter (" not in index.near([0.0] * 12, 1)._jdf.queryExecution().executedPlan().toString()  # folders are chosen, rows are not tested
    with pytest.raises(QueryError, match="no_vector_index"):
        e.read({"from": "points", "where": {**search, "metric": "l2" if metric != "l2" else "dot", "probes": 2}})


def test_vector_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id long, v array<double>")
    assert VectorIndex.build(none, f"file://{tmp_path}/n", "v", "id").search([1.0], 3).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "id long, v array<double>")
    assert [r["id"] for r in VectorIndex.build(same, f"file://{tmp_path}/s", "v", "id").search([1.0, 0.0], 3, probes=9).collect()] == [0, 1, 2]
    with pytest.raises(QueryError, match="several_dimensions"):
        VectorIndex.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), f"file://{tmp_path}/d", "v", "id")


def test_full_text(spark):
    t = spark.createDataFrame([(1, "Tall ships sail west"), (2, "Ships, ships and harbours!"), (3, "No harbour here"), (4, None)], "id long, body string")
    got = fts.ranked(t, "ships harbours", "id", "body").collect()
    assert [r["id"] for r in got] == [2, 1]
    tokens = lambda kind, s, **k: spark.range(1).select(fts.tokens(F.lit(s), kind, **k).alias("t")).first()["t"]
    assert tokens("unicode", "Ёж, Tin-9!") == ["ёж", "tin", "9"]
    assert tokens("ngram", "abcd xy", n=3) == ["abc", "bcd", "xy"]
    assert tokens("ngram", "ab", n=0) == ["a", "b"]
    assert tokens("full", "The owl is on it") == ["owl"]
    assert tokens("full", "и кот", language="russian") == ["кот"]
    assert tokens("full", "The owls were landing softly", stems=True) == ["owl", "were", "land", "soft"]
    with pytest.raises(QueryError):
        fts.tokens(F.lit("x"), "full", language="tamil", stems=True)


def test_posting_index(spark, tmp_path):
    t = spark.createDataFrame([(1, "Tall ships sail west"), (2, "Ships, ships and harbours!"), (3, "No harbour here"), (4, None), (5, "west ships")], "id long, body string")
    ranks = fts.PostingIndex.build(t, f"file://{tmp_path}/r", "id", "body")
    for q in ("ships harbours", "west", "absent", ""):
        assert ranks.ranked(q).collect() == fts.ranked(t, q, "id", "body").collect()
    assert ranks.ranked("ships", limit=1).collect() == fts.ranked(t, "ships", "id", "body", 1).collect()
    words = fts.PostingIndex.build(t, f"file://{tmp_path}/w", "id", "body", "whitespace")
    ids = lambda *a: sorted(r["id"] for r in words.matches(*a).collect())
    assert ids("West SHIPS") == [1, 5] and ids("west and", "or") == [1, 2, 5] and ids("") == [] and ids("", "or") == []
    assert "PushedFilters: [IsNotNull(token)" in words.matches("west")._jdf.queryExecution().executedPlan().toString()
    nothing = fts.PostingIndex.build(t.limit(0), f"file://{tmp_path}/n", "id", "body")
    assert nothing.docs == 0 and nothing.ranked("west").count() == 0


def stages(spark, store):
    """What Spark tells of all stages so far."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = store.stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


@pytest.mark.parametrize("kind", ["whitespace", "unicode"])
def test_posting_index_traffic(spark, tmp_path, kind):
    """A posting is shuffled once and packed: building moves and writes less than two and a half times the texts."""
    pick = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in (pick.zipf(1.3, 250) % 4000).tolist()) for _ in range(600)]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    store = spark.sparkContext._jsc.sc().statusStore()
    seen = {s.stageId() for s in stages(spark, store)}
    index = fts.PostingIndex.build(t, f"file://{tmp_path}/p", "id", "body", kind)
    done = [s for s in stages(spark, store) if s.stageId() not in seen]
    moved = sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in done)
    assert 0 < moved < 2.5 * sum(map(len, texts))
    assert index.ranked("w2 w77").collect() == fts.ranked(t, "w2 w77", "id", "body", kind=kind).collect()


def test_posting_index_writers(spark, tmp_path, monkeypatch):
    """A folder gets as many writers as the words need, and its postings are those of the texts."""
    monkeypatch.setattr(fts, "WORDS", 2)
    texts = [*(" ".join(["ox"] * (i % 3 + 1) + [f"n{i % 7}"]) for i in range(200)), "", " \t\n ", None, "9 9\t9 12", "9"]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    index = fts.PostingIndex.build(t, f"file://{tmp_path}/p", "id", "body", "whitespace")
    kept = spark.read.parquet(f"{index.path}/postings")
    want = sorted((w, i, len(ws), ws.count(w)) for i, ws in enumerate((x or "").split() for x in texts) for w in set(ws))
    assert sorted(tuple(r) for r in kept.select("token", "id", "n", "tf").collect()) == want
    assert index.words == sum(len((x or "").split()) for x in texts) and index.docs == len(texts)
    assert kept.where("token = 'ox'").select(F.input_file_name()).distinct().count() > 4


def test_inverted_index(spark):
    """Words are counted in a document's row: postings are not shuffled where ids are unique, and equal ids are added up."""
    texts = ["Ox ox, OX and ash", "", None, " \t\n ", "9 9 12", "ash"]
    want = lambda ids: sorted(Counter((str(i), w) for i, x in zip(ids, texts, strict=True) for w in re.findall(r"[^\W_]+", (x or "").lower())).items())
    for ids in ([*range(5), None], [1, 2, 3, 4, 1, 1], [None, 2, 3, 4, None, 5]):
        t = spark.createDataFrame(list(zip(ids, texts, strict=True)), "own long, body string")
        got = fts.inverted_index(t, "own", "body")
        assert got.dtypes == [("token", "string"), ("own", "bigint"), ("tf", "bigint")]
        assert sorted(((str(r["own"]), r["token"]), r["tf"]) for r in got.collect()) == want(ids)
        assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == (len(set(ids)) < len(ids))


@pytest.mark.parametrize(("word", "want"), [
    ("consigned", "consign"), ("consolingly", "consol"), ("conspicuously", "conspicu"), ("knackeries", "knackeri"), ("knightly", "knight"), ("generously", "generous"), ("hoping", "hope"), ("hopping", "hop"), ("flies", "fli"), ("dies", "die"),
    ("nationality", "nation"), ("relational", "relat"), ("conditional", "condit"), ("ties", "tie"), ("gas", "gas"), ("sky", "sky"), ("say", "say"), ("agreed", "agre"), ("controlling", "control"), ("communication", "communic"), ("a", "a"),
])
def test_stems(word, want):
    assert stem(word) == want


@pytest.mark.parametrize(("language", "pairs"), [
    ("german", "aufeinander:aufeinand aufgeblasenen:aufgeblas jungen:jung freundlichkeit:freundlich verständnisse:verstandnis"), ("spanish", "torear:tor cheques:chequ torneo:torne comiéndolo:com nacionalidades:nacional"),
    ("portuguese", "boato:boat quilômetros:quilômetr quieto:quiet"), ("italian", "pronunciare:pronunc amici:amic"), ("swedish", "flickorna:flick vänligt:vän"), ("norwegian", "havnedistrikter:havnedistrikt opning:opning"),
    ("dutch", "bomen:bom mannen:mann lopen:lop"), ("russian", "пальто:пальт падшие:падш важничал:важнича важную:важн её:е"), ("danish", "indtage:indtag"),
    ("french", "mystérieusement:mystéri continuait:continu contradictoirement:contradictoir maison:maison malgré:malgr constamment:const patiemment:patient"),
])
def test_other_stems(language, pairs):
    for pair in pairs.split():
        word, want = pair.split(":")
        assert STEMMERS[language](word) == want
    assert all(STEMMERS[language](w) is not None for w in ("", "a", "y", "'", "-", "日本", "x" * 500))


@pytest.mark.parametrize(("spec", "want"), [
    ({}, "FullScan"), ({"select": [{"type": "count_all"}]}, "CounterShortcut"), ({"select": [{"type": "aggregate", "func": "min", "field": ["age"]}]}, "MinMaxIndex"),
    ({"where": {"op": "eq", "field": ["status"], "value": "x"}}, "IndexScan"), ({"where": {"op": "gt", "field": ["age"], "value": 1}}, "SortedIndexScan"),
    ({"where": {"op": "and", "filters": [{"op": "gt", "field": ["age"], "value": 1}, {"op": "ne", "field": ["x"], "value": 1}]}}, "AndRangeIndexScan"),
    ({"order_by": ["age"], "pagination": {"mode": "LimitOffset", "limit": 5}}, "OrderLimitFast"), ({"order_by": ["age"], "pagination": {"mode": "After", "key": [1]}}, "KeysetSeek"),
    ({"where": {"op": "fts", "field": ["body"], "query": "a"}}, "Index2"),
])
def test_explain(spec, want):
    indexes = {"by_status": {"kind": "hash", "fields": ["status"]}, "by_age": {"kind": "sorted", "fields": ["age"]}, "body": {"kind": "fts", "fields": ["body"]}}
    assert explain.plan_type({"from": "users", **spec}, indexes)[0] == want


def test_explain_and_shortcuts(engine):
    out = engine.read({"from": "trips", "explain": True})
    assert out.plan["plan_type"] == "FullScan" and out.df.count() == 0 and out.plan["physical"]
    assert engine.count("trips").first()[0] == 6
    assert tuple(engine.extremes("trips", "km").first()) == (5, 340)
    engine.create_index("trips", "u", "hash", ["driver"])
    assert engine.read({"from": "trips", "where": {"op": "eq", "field": ["driver"], "value": "omar"}, "explain": True}).plan["index"] == "u"
    assert engine.list_tables() == ["depths", "grades", "trips"]
    with pytest.raises(QueryError, match="not_pure"):
        engine.create_index("trips", "r", "functional", ["km"], scalar="gen/random")
    engine.register_aggregate("spread", lambda c: F.max(c) - F.min(c))
    assert rows(engine, **{"from": "trips", "select": [lib("spread", "km")]}) == [(335,)]
    computed = lambda o, v, *a: [r[0] for r in rows(engine, **{"from": "trips", "select": ["id"], "where": {"op": "computed", "expr_op": o, "field": ["driver"] if o != "mod" else ["km"], "expr_args": list(a), "cmp": "eq", "value": v}})]
    assert computed("substring", "ne", 1, 2) == ["t1", "t3", "t4"] and computed("concat", "omar!", "!") == ["t2", "t6"] and computed("mod", 90, 100) == ["t5"] and computed("coalesce", "yuki", "x") == ["t5"]
    engine.register_scalar("user/twice", lambda c: c * 2, 1)
    assert rows(engine, **{"from": "trips", "where": {"op": "eq", "field": ["id"], "value": "t3"}, "select": [{"type": "function", "name": "user/twice", "args": [{"$ref": ["km"]}], "alias": "x"}]}) == [(16,)]
