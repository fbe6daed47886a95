"""Batches: a graph of named queries that feed each other.

Results stay lazy frames. A column of one result in another's in/not_in becomes
a semi or anti join; a single value or a count is the only thing fetched.
Entries run in topological order; a guard that fails skips its entry and all
that use its data.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MISSING
from ..plans.compiler import Scope, _one_row, predicate, value
from ..plans.errors import QueryError
from .read import Result
from .writes import ISOLATION, VersionedTable, computed

#: Time (seconds) and result size (bytes) are limited where the engine or the request says so.
LIMITS = {"max_queries": 50, "max_dependency_depth": 10, "max_execution_time_secs": None, "max_result_size": None, "max_nesting": 4, "max_iterations": 1000}


@dataclass(frozen=True)
class Path:
    """A parsed reference into a result: all rows, a row, a field of one, a column or the count."""

    kind: str
    index: int = 0
    keys: tuple = ()


def parse_path(path: str | None) -> Path:
    """``None``, ``[0]``, ``[0].a.b``, ``[].a``, ``a`` (of the first row) or ``.count``."""
    if not path:
        return Path("root")
    if path in (".count", "count"):
        return Path("count")
    m = re.fullmatch(r"\[(\d*)\](?:\.(.+))?", path)
    if m:
        keys = tuple(m[2].split(".")) if m[2] else ()
        return Path("all" if not m[1] else "index", int(m[1] or 0), keys)
    return Path("index", 0, tuple(path.lstrip(".").split(".")))


def references(node) -> set[str]:
    """The aliases that a query refers to."""
    if isinstance(node, dict):
        own = {node["$query"].lstrip("@")} if isinstance(node.get("$query"), str) else set()
        return own.union(*map(references, node.values()))
    return set().union(*map(references, node)) if isinstance(node, (list, tuple)) else set()


def plan(queries: dict[str, dict], limits: dict) -> tuple[list[list[str]], dict[str, dict[str, str]]]:
    """Stages of entries that depend on earlier stages only, and each edge's kind: explicit, data_flow or both."""
    if len(queries) > limits["max_queries"]:
        raise QueryError("too_many_queries", str(len(queries)))
    edges: dict[str, dict[str, str]] = {}
    for alias, entry in queries.items():
        after, data = set(entry.get("after", [])), references({k: v for k, v in entry.items() if k not in ("after",)}) & (set(queries) | {alias})
        for other in after | data:
            if other not in queries:
                raise QueryError("unknown_query", other)
            edges.setdefault(alias, {})[other] = "both" if other in after and other in data else "explicit" if other in after else "data_flow"
    left, stages = set(queries), []
    while left:
        ready = [a for a in queries if a in left and not set(edges.get(a, {})) & left]
        if not ready:
            raise QueryError("cycle", ", ".join(sorted(left)))
        stages.append(ready)
        left -= set(ready)
        if len(stages) > limits["max_dependency_depth"]:
            raise QueryError("too_deep", str(len(stages)))
    return stages, edges


class Batch:
    """One run of a batch."""

    def __init__(self, engine, params: dict, limits: dict, depth: int, outer: dict | None = None):
        self.engine, self.params, self.limits, self.depth = engine, params, limits, depth
        self.results: dict[str, Result] = dict(outer or {})

    def lookup(self, alias: str, path: str | None):
        """What a reference stands for: a value, or a column as a frame."""
        result = self.results.get(alias.lstrip("@"))
        if result is None:
            return None
        if result.skipped:
            return "value", None
        p = parse_path(path)
        if result.df is None:
            return "value", reduce(lambda v, k: v.get(k) if isinstance(v, dict) else None, p.keys, result.extra.get("value"))
        if p.kind == "count":
            return "value", result.df.count()
        if p.kind in ("root", "all"):
            columns = result.df.columns
            name = p.keys[0] if p.keys else columns[0]
            if name not in columns:
                return "value", []
            scope = Scope(result.df)
            return "column", result.df.select(scope.path(list(p.keys) or [name]).c.alias("v"))
        rows = result.df if result.ordered or p.index == 0 and not p.keys else self._ordered(result)
        row = rows.offset(p.index).limit(1).collect()
        out = row[0].asDict(recursive=True) if row else None
        return "value", reduce(lambda v, k: v.get(k) if isinstance(v, dict) else None, p.keys, out)

    @staticmethod
    def _ordered(result: Result) -> DataFrame:
        """Without ORDER BY the first row is the first by id, or by all columns."""
        df = result.df
        return df.orderBy("_id") if "_id" in df.columns else df.orderBy(*(F.col(f"`{c}`") for c, k in df.dtypes if not k.startswith(("map", "variant"))))

    def holds(self, condition: dict | None) -> bool:
        """A guard, against no record."""
        if condition is None:
            return True
        scope = Scope(None, self.params, self.lookup)
        return bool(_one_row().select(predicate(condition, scope, seen=True).alias("x")).first()["x"])

    def plain(self, v, row: dict | None = None):
        """A value of a write or binding, with its markers resolved."""
        if isinstance(v, dict) and any(k in v for k in ("$query", "$param", "$fn", "$expr", "$cond")):
            if "$param" in v and v["$param"] in self.params:
                return self.params[v["$param"]]
            if "$query" in v:
                found = self.lookup(v["$query"], v.get("path"))
                if found is None:
                    raise QueryError("unknown_query", v["$query"])
                return [r["v"] for r in found[1].limit(self.limits["max_iterations"] + 1).collect()] if found[0] == "column" else found[1]
            made = value(v, Scope(None, self.params, self.lookup))
            return made.lit if made.lit is not MISSING else _one_row().select(made.c.alias("x")).first()["x"]
        if isinstance(v, dict):
            return {k: self.plain(x) for k, x in v.items()}
        return [self.plain(x) for x in v] if isinstance(v, list) else v

    def _versioned(self, ref) -> VersionedTable:
        table = self.engine.table(ref).source
        if not isinstance(table, VersionedTable):
            raise QueryError("not_writable", str(ref))
        return table

    def execute(self, entry: dict) -> Result:
        """One entry by its kind."""
        if "from" in entry:
            return self.engine.read(entry, self.params, self.lookup)
        if "insert_into" in entry:
            table = self._versioned(entry["insert_into"])
            rows = [{k: v if computed(v) else self.plain(v) for k, v in r.items()} for r in entry["values"]]
            return Result(_returned(table.insert_records(rows, self.params, self.lookup), entry.get("select")))
        if "update" in entry:
            table = self._versioned(entry["update"])
            chosen = entry.get("select") or {}
            out = table.update(entry.get("where"), entry["set"], entry.get("expected_version"), self.params, self.lookup)
            return Result(_returned(out[chosen.get("return_mode", "changed")], chosen))
        if "delete_from" in entry:
            table = self._versioned(entry["delete_from"])
            return Result(_returned(table.delete(entry.get("where"), entry.get("expected_version"), self.params, self.lookup), entry.get("select")))
        if "set" in entry and "key" in entry:
            table = self._versioned(entry["set"])
            table.upsert(self.plain(entry["key"]), self.plain(entry["value"]))
            return Result(table.latest())
        if "for_each" in entry:
            return self._for_each(entry)
        if "batch" in entry:
            bound = {k: self.plain(v) for k, v in entry.get("bind", {}).items()}
            return Result(None, extra={"value": run_batch(self.engine, entry["batch"], {**self.params, **bound}, self.depth + 1)["results"]})
        if "call" in entry:
            fn = self.engine.procedures.get(entry["call"])
            if fn is None:
                raise QueryError("unknown_function", entry["call"])
            return Result(None, extra={"value": fn(self.engine, {k: self.plain(v) for k, v in entry.get("params", {}).items()})})
        raise QueryError("unknown_operation", ", ".join(entry))

    def _for_each(self, entry: dict) -> Result:
        """The body once per element of a list that is resolved once."""
        elements = self.plain(entry["over"])
        elements = elements if isinstance(elements, list) else [] if elements is None else [elements]
        if len(elements) > self.limits["max_iterations"]:
            raise QueryError("too_many_iterations", str(len(elements)))
        done = [run_batch(self.engine, entry["for_each"], {**self.params, entry["bind_row"]: e}, self.depth + 1)["results"] for e in elements]
        return Result(None, extra={"value": done})


def _returned(df: DataFrame, chosen: dict | None) -> DataFrame:
    fields = (chosen or {}).get("fields")
    return df.select(*(F.col(f"`{f}`") for f in fields)) if fields else df


def run_batch(engine, request: dict, params: dict, depth: int = 1) -> dict:
    """Results by alias (lazy), the stages, the edges' kinds and the time taken."""
    limits = {**LIMITS, **engine.limits, **(request.get("limits") or {})}
    if depth > limits["max_nesting"]:
        raise QueryError("nested_too_deep", str(depth))
    queries, began = request["queries"], time.monotonic()
    stages, edges = plan(queries, limits)
    run = Batch(engine, params, limits, depth)
    isolation = request.get("isolation") or "snapshot"
    if isolation not in ISOLATION:
        raise QueryError("unknown_isolation", str(isolation))
    held = [t.source for t in engine.tables.values() if isinstance(t.source, VersionedTable) and t.source.pending is None] if request.get("transactional") else []
    for table in held:
        table.begin()
    try:
        for stage in stages:
            for alias in stage:
                if limits["max_execution_time_secs"] is not None and time.monotonic() - began > limits["max_execution_time_secs"]:
                    raise QueryError("timeout", alias)
                entry = queries[alias]
                fed = [run.results[o] for o, kind in edges.get(alias, {}).items() if kind != "explicit"]
                if any(r.skipped for r in fed) or not run.holds(entry.get("when")):
                    run.results[alias] = Result(None, skipped=True)
                else:
                    run.results[alias] = run.execute(entry)
        for table in held:
            table.validate(isolation)
        for table in held:
            table.commit()
    except Exception:
        for table in held:
            table.rollback()
        raise
    shown = request.get("return_only") or [a for a in queries if request.get("return_all", True) and queries[a].get("return_result", True)]
    results = {a: run.results[a] for a in shown}
    if limits["max_result_size"] is not None:
        check_size(results, limits["max_result_size"])
    return {"results": results, "execution_plan": stages, "edge_provenance": edges, "execution_time_us": int((time.monotonic() - began) * 1e6)}


def check_size(results: dict[str, Result], most: int) -> None:
    """Raise if the rows of all results take more than ``most`` bytes as JSON, counted where the rows are.

    Results are frames that may never be fetched, so counting them is a job of its own.
    """
    total = 0
    for alias, result in results.items():
        if result.df is not None:
            size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in result.df.columns))))
            total += result.df.agg(F.sum(size).alias("n")).first()["n"] or 0
        elif isinstance(result.extra.get("value"), dict) and all(isinstance(r, Result) for r in result.extra["value"].values()):
            check_size(result.extra["value"], most - total)
        if total > most:
            raise QueryError("result_too_large", f"{alias}: over {most} bytes")
