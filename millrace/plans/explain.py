"""EXPLAIN: the access path that a query's shape stands for, and Spark's plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

PLANS = ("KeysetSeek", "OrderLimitFast", "Index2", "IndexScan", "SortedIndexScan", "AndRangeIndexScan", "CounterShortcut", "MinMaxIndex", "FullScan")
EQUALITY = ("eq", "field", "in")
RANGE = ("between", "gt", "gte", "lt", "lte")


def _first(path) -> str:
    return path if isinstance(path, str) else path[0]


def _indexed(indexes: dict, kinds: tuple, name: str) -> str | None:
    return next((i for i, d in indexes.items() if d["kind"] in kinds and d["fields"][0] == name), None)


def plan_type(spec: dict, indexes: dict) -> tuple[str, str | None]:
    """The plan's kind and the index that it would use."""
    f, page = spec.get("where"), spec.get("pagination") or {}
    order = spec.get("order_by") or {}
    order = order if isinstance(order, list) else order.get("items", [])
    items = spec.get("select") or {}
    items = items if isinstance(items, list) else items.get("items", [])
    items = [i for i in items if isinstance(i, dict)]
    distinct = isinstance(spec.get("select"), dict) and spec["select"].get("distinct")
    plain = not (f or spec.get("group_by") or distinct or spec.get("count_total"))
    if len(order) == 1:
        index = _indexed(indexes, ("sorted",), _first(order[0]["field"] if isinstance(order[0], dict) else order[0]))
        if index and page.get("mode") == "After" and not f:
            return "KeysetSeek", index
        if index and plain and page.get("limit") is not None:
            return "OrderLimitFast", index
    if plain and len(items) == 1 and items[0]["type"] == "count_all":
        return "CounterShortcut", None
    if plain and items and all(i["type"] == "aggregate" and i["func"] in ("min", "max") for i in items):
        index = _indexed(indexes, ("sorted",), _first(items[0]["field"]))
        if index:
            return "MinMaxIndex", index
    if f is None:
        return "FullScan", None
    leaves = f["filters"] if f["op"] == "and" else [f]
    for leaf in leaves:
        kinds = {"fts": ("fts",), "vector_similarity": ("vector",), "computed": ("functional",)}.get(leaf["op"])
        if kinds and (index := _indexed(indexes, kinds, _first(leaf["field"]))):
            return "Index2", index
    equal = {_first(x["field"]) for x in leaves if x["op"] in EQUALITY}
    for name, d in indexes.items():
        if d["kind"] in ("hash", "index") and set(d["fields"]) <= equal:
            return "IndexScan", name
    for leaf in leaves:
        if leaf["op"] in RANGE and (index := _indexed(indexes, ("sorted",), _first(leaf["field"]))):
            return ("SortedIndexScan" if len(leaves) == 1 else "AndRangeIndexScan"), index
    return "FullScan", None


def explain(spec: dict, indexes: dict, df: DataFrame) -> dict:
    """The plan's kind, its index and the physical plan as text."""
    kind, index = plan_type(spec, indexes)
    return {"plan_type": kind, "index": index, "physical": df._jdf.queryExecution().executedPlan().toString()}
