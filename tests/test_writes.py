"""Versioned tables, schemas, batches and subscriptions."""

import pytest
from millrace.operators.batch import parse_path, plan
from millrace.operators.schema import violations
from millrace.operators.writes import ForeignKey, VersionedTable
from millrace.plans.errors import QueryError
from millrace.sources.catalog import Engine
from millrace.streaming import subscribe as sub
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = T.StructType([T.StructField("name", T.StringType()), T.StructField("qty", T.LongType())])


def eq(f, v):
    return {"op": "eq", "field": [f], "value": v}


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", FIELDS)
    t.insert(spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "_id string, name string, qty long"), now_ms=1000)
    return t


def state(df):
    return sorted((r["_id"], r["name"], r["qty"]) for r in df.collect())


def test_history(table):
    table.update(eq("_id", "1"), {"qty": {"$expr": {"op": "add", "args": [{"$ref": ["qty"]}, 10]}}}, now_ms=2000)
    table.delete(eq("_id", "2"), now_ms=3000)
    table.upsert({"name": "c"}, {"qty": 7}, now_ms=4000)
    table.upsert({"name": "c"}, {"qty": 8}, now_ms=5000)
    assert [(n, q) for _, n, q in state(table.latest())] == [("a", 11), ("c", 8)] or sorted((n, q) for _, n, q in state(table.latest())) == [("a", 11), ("c", 8)]
    assert state(table.as_of({"version": 1})) == [("1", "a", 1), ("2", "b", 2)]
    assert state(table.as_of({"version": 2})) == [("1", "a", 11), ("2", "b", 2)]
    assert state(table.as_of({"timestamp": 3500})) == [("1", "a", 11)]
    with pytest.raises(QueryError):
        table.as_of({"timestamp": 5})
    changes, gap = table.changes_since(2)
    assert [(r["op"], r["commit_version"]) for r in changes.collect()] == [("delete", 3), ("put", 4), ("put", 5)] and gap is None
    assert table.versions() == [1, 2, 3, 4, 5]


def test_update_modes_and_cas(table):
    out = table.update(None, {"qty": 1}, now_ms=2000)
    assert [r["_id"] for r in out["changed"].collect()] == ["2"] and [r["_id"] for r in out["unchanged"].collect()] == ["1"]
    with pytest.raises(QueryError, match="version_conflict"):
        table.update(eq("_id", "2"), {"qty": 5}, expected_version=1)
    with pytest.raises(QueryError):
        table.update(None, {"absent": 1})
    with pytest.raises(QueryError):
        table.delete(None)


def test_engine_time_travel(spark, table):
    table.update(eq("_id", "1"), {"qty": 50}, now_ms=2000)
    e = Engine(spark)
    e.register("t", table)
    past = e.read({"from": "t", "where": eq("qty", 1), "temporal": {"kind": "as_of", "at": {"version": 1}}})
    assert [r["_id"] for r in past.df.collect()] == ["1"]
    history = e.read({"from": "t", "where": eq("qty", 50), "temporal": {"kind": "history", "order": "desc"}})
    assert [(r["qty"], r["_version"]) for r in history.df.collect()] == [(50, 2), (1, 1)]
    table.rewrite(table.history().where("_version >= 2"))
    assert table.changes_since(0)[1] == 2 and state(table.latest()) == [("1", "a", 50)]


def test_rewrite_that_was_cut_off(spark, table, tmp_path, monkeypatch):
    table.update(eq("_id", "1"), {"qty": 50}, now_ms=2000)
    monkeypatch.setattr(VersionedTable, "_replace", lambda self, top: None)
    table.rewrite(table.history().where("_version >= 2"))
    monkeypatch.undo()
    again = VersionedTable(spark, f"file://{tmp_path}/t", FIELDS)
    assert again.versions() == [2] and state(again.latest()) == [("1", "a", 50)]


def test_schema(spark, tmp_path):
    rules = [{"path": "name", "required": True, "min_len": 2, "format": "email"}, {"path": "qty", "unsigned": True, "default": 3, "max": 10}, {"path": "name", "unique": True}]
    t = VersionedTable(spark, f"file://{tmp_path}/s", FIELDS, rules)
    frame = lambda *rows: spark.createDataFrame(list(rows), "_id string, name string, qty long")
    t.insert(frame(("1", "a@b.co", None)))
    assert state(t.latest()) == [("1", "a@b.co", 3)]
    for row in (("2", None, 1), ("2", "x@y.zz", -1), ("2", "x@y.zz", 11), ("2", "nope", 1), ("2", "a@b.co", 1)):
        with pytest.raises(QueryError):
            t.insert(frame(row))
    bad = violations(frame(("9", "x", -5)), rules).collect()
    assert sorted((r["path"], r["code"]) for r in bad) == [("name", "format"), ("name", "min_len"), ("qty", "unsigned")]


@pytest.mark.parametrize(("action", "left"), [("cascade", []), ("set_null", [("c1", None, 1)]), ("restrict", None), ("no_action", None)])
def test_foreign_keys(spark, tmp_path, action, left):
    parent = VersionedTable(spark, f"file://{tmp_path}/p", FIELDS)
    child = VersionedTable(spark, f"file://{tmp_path}/c", FIELDS)
    fk = ForeignKey(child, "name", parent, "name", action)
    parent.children.append(fk)
    child.parents.append(fk)
    frame = lambda *rows: spark.createDataFrame(list(rows), "_id string, name string, qty long")
    parent.insert(frame(("p1", "x", 1)))
    child.insert(frame(("c1", "x", 1)))
    with pytest.raises(QueryError, match="foreign_key_missing"):
        child.insert(frame(("c2", "zzz", 1)))
    if left is None:
        with pytest.raises(QueryError, match="restrict"):
            parent.delete(eq("name", "x"))
    else:
        parent.delete(eq("name", "x"))
        assert state(child.latest()) == left


def test_paths_and_plan():
    assert parse_path("[0].a.b").keys == ("a", "b") and parse_path("[].f").kind == "all" and parse_path(".count").kind == "count" and parse_path(None).kind == "root"
    limits = {"max_queries": 3, "max_dependency_depth": 2}
    stages, edges = plan({"a": {"from": "t"}, "b": {"from": "t", "after": ["a"], "where": eq("x", {"$query": "@a", "path": "[0].x"})}, "c": {"from": "t"}}, limits)
    assert stages == [["a", "c"], ["b"]] and edges == {"b": {"a": "both"}}
    for bad in ({"a": {"after": ["b"]}, "b": {"after": ["a"]}}, {"a": {"after": ["zzz"]}}, {c: {} for c in "abcd"}, {"a": {}, "b": {"after": ["a"]}, "c": {"after": ["b"]}}):
        with pytest.raises(QueryError):
            plan(bad, limits)


@pytest.fixture
def yard(spark, tmp_path):
    e = Engine(spark)
    e.register("depots", spark.createDataFrame([("N", "Kiruna"), ("S", "Malmo"), ("W", "Goteborg")], "id string, town string"), id_col="id")
    e.register("pallets", spark.createDataFrame([("x9", "S", 410), ("x4", "N", 75), ("x7", "S", 12), ("x1", "W", 230), ("x3", "S", 88)], "id string, depot string, kg long"), id_col="id")
    e.register("audit", VersionedTable(spark, f"file://{tmp_path}/audit", FIELDS))
    return e


def test_batch(yard):
    out = yard.batch({"queries": {
        "u": {"from": "depots", "where": eq("town", "Malmo"), "order_by": ["id"]},
        "o": {"from": "pallets", "where": eq("depot", {"$query": "@u", "path": "[0].id"}), "order_by": ["id"]},
        "others": {"from": "pallets", "where": {"op": "not_in", "field": ["depot"], "values": [{"$query": "@u", "path": "[].id"}]}, "order_by": ["id"]},
        "skip": {"from": "depots", "when": {"op": "value_compare", "left": {"$query": "@o", "path": ".count"}, "cmp": "gt", "right": 5}},
        "after_skip": {"from": "pallets", "where": eq("depot", {"$query": "@skip", "path": "[0].id"})},
        "empty": {"from": "depots", "where": eq("town", "Nowhere")},
        "all": {"from": "pallets", "where": {"op": "not_in", "field": ["depot"], "values": [{"$query": "@empty", "path": "[].id"}]}},
    }})
    r = out["results"]
    assert [x["id"] for x in r["o"].df.collect()] == ["x3", "x7", "x9"] and [x["id"] for x in r["others"].df.collect()] == ["x1", "x4"]
    assert r["skip"].skipped and r["after_skip"].skipped and r["all"].df.count() == 5
    assert out["execution_plan"][0] == ["u", "empty"]


def test_for_each_and_transactions(yard):
    body = {"queries": {"w": {"insert_into": "audit", "values": [{"name": {"$param": "row"}, "qty": 1}]}}}
    yard.batch({"queries": {"o": {"from": "pallets", "select": ["id"], "order_by": ["id"]}, "each": {"over": {"$query": "@o", "path": "[].id"}, "bind_row": "row", "for_each": body}}})
    assert sorted(r["name"] for r in yard.table("audit").rows().collect()) == ["x1", "x3", "x4", "x7", "x9"]
    before = yard.table("audit").source.version()
    bad = {"queries": {"a": {"insert_into": "audit", "values": [{"name": "x", "qty": 1}]}, "b": {"from": "nowhere", "after": ["a"]}}, "transactional": True}
    with pytest.raises(QueryError):
        yard.batch(bad)
    assert yard.table("audit").source.version() == before
    good = {"queries": {"a": {"insert_into": "audit", "values": [{"_id": "n", "name": "x", "qty": 1}]}, "b": {"update": "audit", "where": eq("_id", "n"), "set": {"qty": 9}, "after": ["a"]}, "c": {"from": "audit", "where": eq("_id", "n"), "after": ["b"]}}, "transactional": True}
    assert yard.batch(good)["results"]["c"].df.first()["qty"] == 9
    assert yard.table("audit").source.version() == before + 1
    yard.batch({"queries": {"d": {"delete_from": "audit", "where": eq("_id", "n")}, "s": {"set": "audit", "key": {"name": "k"}, "value": {"qty": 2}}}})
    assert yard.table("audit").rows().where("_id = 'n'").isEmpty()


def test_sub_batch_and_call(yard):
    yard.register_procedure("sum_two", lambda engine, p: p["a"] + p["b"])
    out = yard.batch({"queries": {
        "s": {"batch": {"queries": {"u": {"from": "depots", "where": eq("id", {"$param": "who"})}}}, "bind": {"who": "W"}},
        "c": {"call": "sum_two", "params": {"a": 1, "b": {"$expr": {"op": "mul", "args": [2, 3]}}}},
    }})["results"]
    assert out["s"].extra["value"]["u"].df.first()["town"] == "Goteborg" and out["c"].extra["value"] == 7


def test_subscription(spark, tmp_path):
    value = T.StructType([T.StructField("room", T.LongType()), T.StructField("body", T.StringType())])
    schema = sub.change_schema(value)
    rows = [("m", "put", "1", 1, (3, "in")), ("m", "put", "2", 2, (11, "out")), ("m", "delete", "3", 3, None), ("other", "put", "4", 4, (3, "up")), ("m", "put", "5", 5, (3, "down"))]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/log")
    spec = {"subscribe": [{"table": "m", "filter": eq("room", 3), "events": "all"}], "initial": True}
    got = []
    stream = sub.change_stream(spark, f"{tmp_path}/log", schema)
    initial = spark.createDataFrame(rows[:1], schema)
    q = sub.subscribe(stream, spec, lambda df, n: got.append((n, [r["key"] for r in df.collect()])), f"{tmp_path}/ck", initial, once=True)
    q.awaitTermination(60)
    sub.unsubscribe(q)
    sub.unsubscribe(q)
    assert got[0] == (-1, ["1"]) and sum((k for _, k in got[1:]), []) == ["1", "3", "5"]
    keys = sub.matching(spark.createDataFrame(rows, schema), {"subscribe": [{"table": "m", "events": "put"}], "deliver": "keys", "from_version": 2})
    assert keys.columns == ["table", "op", "key", "commit_version"] and sorted(r["key"] for r in keys.collect()) == ["2", "5"]
    with pytest.raises(QueryError, match="filter_not_allowed"):
        sub.check_filter({"op": "not", "filter": {"op": "like", "field": ["x"], "pattern": "a"}})


def test_windows(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:30"), (2, "2024-01-01 00:05:00")], "user long, t string").select("user", F.to_timestamp("t").alias("t")).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("user long, t timestamp").parquet(f"{tmp_path}/e")
    for name, df in (("w", sub.windowed_counts(stream, "t", ["user"], "1 minute")), ("s", sub.sessions(stream, "t", ["user"], "1 minute"))):
        q = df.writeStream.outputMode("complete" if name == "w" else "append").format("memory").queryName(f"out_{name}").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted((r["user"], r["n"]) for r in spark.table("out_w").collect()) == [(1, 2), (2, 1)]


def test_computed_values_fail_closed(yard):
    table = yard.table("audit").source
    fn = lambda name, *args: {"$fn": {"name": name, "args": list(args)}}
    yard.batch({"queries": {"i": {"insert_into": "audit", "values": [{"_id": "k", "name": fn("strings/upper", "ok"), "qty": 4}, {"_id": "l", "name": "plain", "qty": fn("math/abs", {"$param": "p"})}]}}}, {"p": -6})
    assert state(table.latest()) == [("k", "OK", 4), ("l", "plain", 6)]
    before = table.version()
    for bad in ({"name": fn("strings/repeat", "x", -1), "qty": 1}, {"name": fn("strings/upper", {"$ref": ["qty"]}), "qty": 1}, {"name": fn("strings/upper", {"$ref": ["name2"]})}, {"name": fn("strings/upper", {"$ref": ["name"]})}):
        with pytest.raises(QueryError, match="computed_value_failed"):
            yard.batch({"queries": {"i": {"insert_into": "audit", "values": [bad]}}})
    with pytest.raises(QueryError, match="computed_value_failed: qty"):
        table.update(eq("_id", "k"), {"qty": fn("math/mod", {"$ref": ["qty"]}, 0)})
    assert table.version() == before and len(table.versions()) == before
    table.update(eq("_id", "k"), {"name": fn("null/nullif", {"$ref": ["name"]}, "OK")})
    assert state(table.latest())[0] == ("k", None, 4)


def test_isolation(spark, yard, tmp_path):
    table = yard.table("audit").source
    yard.batch({"queries": {"i": {"insert_into": "audit", "values": [{"_id": "k", "name": "a", "qty": 1}]}}})
    other = VersionedTable(spark, table.path, FIELDS)
    seen = []

    def intrude(engine, params):
        other.update(eq("_id", "k"), {"qty": 50})
        seen.append(state(engine.table("audit").rows()))

    yard.register_procedure("intrude", intrude)
    request = lambda level: {"transactional": True, "isolation": level, "queries": {"r": {"from": "audit"}, "c": {"call": "intrude", "after": ["r"]}, "u": {"update": "audit", "where": eq("_id", "k"), "set": {"name": level}, "after": ["c"]}}}
    with pytest.raises(QueryError, match="transaction_conflict"):
        yard.batch(request("serializable"))
    assert seen[0] == [("k", "a", 1)] and state(table.latest()) == [("k", "a", 50)]
    other.update(eq("_id", "k"), {"qty": 2})
    yard.batch(request("snapshot"))
    assert state(table.latest()) == [("k", "snapshot", 2)]  # the last writer wins
    with pytest.raises(QueryError, match="unknown_isolation"):
        yard.batch({"transactional": True, "isolation": "chaos", "queries": {}})


def test_batch_limits(yard):
    read = {"queries": {"p": {"from": "pallets"}}}
    assert yard.batch({**read, "limits": {"max_result_size": 1000}})["results"]["p"].df.count() == 5
    with pytest.raises(QueryError, match="result_too_large"):
        yard.batch({**read, "limits": {"max_result_size": 100}})
    yard.limits["max_execution_time_secs"] = -1
    with pytest.raises(QueryError, match="timeout"):
        yard.batch(read)


def test_cursors(yard):
    spec = {"from": "pallets", "order_by": ["id"]}
    key, page, more = yard.open_cursor(spec, 2)
    assert [r["id"] for r in page] == ["x1", "x3"] and more
    page, more = yard.fetch(key, 1)
    assert [r["id"] for r in page] == ["x4"] and more
    page, more = yard.fetch(key, 9)
    assert [r["id"] for r in page] == ["x7", "x9"] and not more
    with pytest.raises(QueryError, match="unknown_cursor"):
        yard.fetch(key)
    key, _, _ = yard.open_cursor(spec, 1)
    yard.cancel(key)
    yard.cancel(key)
    with pytest.raises(QueryError, match="unknown_cursor"):
        yard.fetch(key)
    idle, _, _ = yard.open_cursor(spec, 1)
    yard.open_cursor(spec, 1, idle_seconds=0)
    assert idle not in yard.cursors
    with pytest.raises(QueryError, match="cursor_unsupported"):
        yard.open_cursor({"from": "audit", "temporal": {"kind": "as_of", "at": {"version": 1}}})


def test_rename_and_describe(yard):
    yard.rename("depots", "sites")
    assert "depots" not in yard.list_tables() and yard.describe("sites")["columns"] == {"id": "string", "town": "string"}
    assert yard.describe("audit")["version"] == 0 and yard.describe("audit")["columns"]["qty"] == "bigint"
    with pytest.raises(QueryError, match="table_exists"):
        yard.rename("sites", "audit")


def test_reactive_delivery(spark, yard, tmp_path):
    value = T.StructType([T.StructField("kg", T.LongType())])
    changes = spark.createDataFrame([("pallets", "put", "x7", 2, (12,)), ("pallets", "delete", "x9", 3, None), ("depots", "put", "N", 1, (0,))], sub.change_schema(value))
    answers = []
    spec = {"subscribe": [{"table": "pallets"}], "deliver": {"batch": {"batch": {"queries": {"p": {"from": "pallets", "where": eq("id", {"$param": "$event.key"})}}}}}}
    sub.reacting(yard, spec, lambda event, out: answers.append((event["op"], out["p"].df.first()["kg"])))(sub.matching(changes, spec).orderBy("commit_version"), 0)
    assert answers == [("put", 12), ("delete", 410)]
    yard.register_procedure("tell", lambda engine, p: p["what"])
    spec = {"subscribe": [{"table": "pallets", "events": "delete"}], "deliver": {"call": {"call": "tell", "params": {"what": {"$param": "$event.op"}}}}}
    answers.clear()
    sub.reacting(yard, spec, lambda event, out: answers.append((event["key"], out)))(sub.matching(changes, spec), 0)
    assert answers == [("x9", "delete")]
    with pytest.raises(QueryError, match="unknown_deliver"):
        sub.matching(changes, {**spec, "deliver": {"mail": {}}})
