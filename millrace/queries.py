"""The driver's queries: one per operator over the test tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import fts, schema, temporal, vector
from .operators.writes import ForeignKey, VersionedTable
from .plans.compiler import Scope, value
from .plans.errors import QueryError
from .sources.catalog import Engine
from .sources.folders import new_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations")
IDS = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the test tables; a table is opened when a query names it."""

    class Lazy(Engine):
        def table(self, ref):
            if self._key(ref) not in self.tables:
                self.register_files(ref, f"{sf_dir}/{ref}.parquet", id_col=IDS.get(ref, "_id"))
            return super().table(ref)

    return Lazy(spark)


def read_query(name: str, spec: dict, sql: str | None = None) -> None:
    """Register a read."""
    QUERIES[name] = lambda spark, d: engine(spark, d).read(spec).df
    if sql:
        ORACLE[name] = sql


def batch_query(name: str, request: dict, alias: str, sql: str) -> None:
    """Register one result of a batch."""
    QUERIES[name] = lambda spark, d: engine(spark, d).batch(request)["results"][alias].df
    ORACLE[name] = sql


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return wrap


def eq(f, v):
    return {"op": "eq", "field": [f], "value": v}


def op(kind, f, v):
    return {"op": kind, "field": [f], "value": v}


def every(*fs):
    return {"op": "and", "filters": list(fs)}


def some(*fs):
    return {"op": "or", "filters": list(fs)}


def negate(f):
    return {"op": "not", "filter": f}


def fields(*names):
    return {"items": list(names)}


def call(name, *args, alias=None):
    return {"type": "function", "name": name, "args": list(args), "alias": alias or name.split("/")[1]}


def ref(f):
    return {"$ref": [f]}


def expr(o, *args):
    return {"$expr": {"op": o, "args": list(args)}}


# -- scans, projections, paging

FLAGSHIP = {
    "from": "orders", "where": every(eq("o_orderstatus", "F"), op("gte", "o_totalprice", 100000)),
    "group_by": {"fields": [["o_orderpriority"]], "having": op("gt", "n", 10)},
    "select": {"items": [{"type": "field", "path": ["o_orderpriority"]}, {"type": "count_all", "alias": "n"}, {"type": "aggregate", "func": "max", "field": ["o_totalprice"], "alias": "top"}, {"type": "aggregate", "func": "min", "field": ["o_totalprice"], "alias": "low"}]},
    "order_by": {"items": [{"field": ["o_orderpriority"]}]},
}
read_query("group_having", FLAGSHIP, """
    SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top, min(o_totalprice) AS low FROM orders
    WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 GROUP BY 1 HAVING count(*) > 10""")
read_query("table_scan", {"from": "nation"}, "SELECT * FROM nation")
read_query("project_fields", {"from": "part", "select": {"items": ["p_partkey", {"type": "field", "path": ["p_name"], "alias": "name"}, {"type": "field", "path": ["absent"], "alias": "nothing"}]}}, "SELECT p_partkey, p_name AS name, NULL AS nothing FROM part")
read_query("count_all", {"from": "lineitem", "select": {"items": [{"type": "count_all"}]}}, 'SELECT count(*) AS "count" FROM lineitem')
read_query("min_max", {"from": "lineitem", "select": {"items": [{"type": "aggregate", "func": f, "field": ["l_shipdate"], "alias": f} for f in ("min", "max")]}}, 'SELECT min(l_shipdate) AS "min", max(l_shipdate) AS "max" FROM lineitem')
read_query("distinct_values", {"from": "orders", "select": {"items": ["o_orderstatus", "o_orderpriority"], "distinct": True}}, "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
read_query("order_limit", {"from": "orders", "select": fields("o_orderkey", "o_totalprice"), "order_by": [{"field": ["o_totalprice"], "direction": "desc"}], "pagination": {"mode": "LimitOffset", "limit": 10}}, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
read_query("limit_offset", {"from": "orders", "select": fields("o_orderkey", "o_orderdate"), "order_by": ["o_orderdate", "o_orderkey"], "pagination": {"mode": "LimitOffset", "limit": 25, "offset": 50}}, "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 50")
read_query("page", {"from": "part", "select": fields("p_partkey", "p_retailprice"), "order_by": [{"field": ["p_retailprice"], "direction": "desc"}], "pagination": {"mode": "Page", "page": 3, "page_size": 20}}, "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
read_query("keyset_after", {"from": "part", "select": fields("p_partkey", "p_size"), "order_by": ["p_size"], "pagination": {"mode": "After", "key": [25], "limit": 30}}, "SELECT p_partkey, p_size FROM part WHERE p_size > 25 ORDER BY p_size, p_partkey LIMIT 30")
read_query("keyset_after_id", {"from": "part", "select": fields("p_partkey", "p_size"), "order_by": ["p_size"], "pagination": {"mode": "After", "key": [25], "after_id": 100, "limit": 30}}, "SELECT p_partkey, p_size FROM part WHERE p_size > 25 OR (p_size = 25 AND p_partkey > 100) ORDER BY p_size, p_partkey LIMIT 30")
NULL_ORDER = {"items": ["c_custkey", {"type": "function", "name": "null/nullif", "args": [ref("c_mktsegment"), "BUILDING"], "alias": "seg"}]}
read_query("order_nulls_default", {"from": "customer", "select": NULL_ORDER, "order_by": [{"field": ["seg"], "direction": "desc"}], "pagination": {"mode": "LimitOffset", "limit": 40}}, "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer ORDER BY seg DESC NULLS FIRST, c_custkey LIMIT 40")
read_query("order_nulls_given", {"from": "customer", "select": NULL_ORDER, "order_by": [{"field": ["seg"], "nulls": "first"}], "pagination": {"mode": "LimitOffset", "limit": 40}}, "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer ORDER BY seg ASC NULLS FIRST, c_custkey LIMIT 40")
read_query("select_expression", {"from": "lineitem", "select": {"items": ["l_orderkey", "l_linenumber", {"type": "expr", "alias": "net", "expr": {"op": "mul", "left": {"op": "field", "path": ["l_extendedprice"]}, "right": {"op": "sub", "left": {"op": "literal", "value": 1}, "right": {"op": "field", "path": ["l_discount"]}}}}]}}, "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
read_query("select_cond", {"from": "orders", "select": {"items": ["o_orderkey", {"type": "function", "name": "null/coalesce", "alias": "tier", "args": [{"$cond": {"if": op("gte", "o_totalprice", 300000), "then": "high", "else": {"$cond": {"if": op("lt", "o_totalprice", 100000), "then": "low", "else": "middle"}}}}]}]}}, "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice < 100000 THEN 'low' ELSE 'middle' END AS tier FROM orders")

# -- filters

LINES = fields("l_orderkey", "l_linenumber")
for _name, _filter, _sql in (
    ("eq", eq("l_returnflag", "R"), "l_returnflag = 'R'"),
    ("ne", op("ne", "l_returnflag", "R"), "l_returnflag <> 'R'"),
    ("gt", op("gt", "l_quantity", 45), "l_quantity > 45"),
    ("gte", op("gte", "l_quantity", 45.0), "l_quantity >= 45"),
    ("lt", op("lt", "l_quantity", 5), "l_quantity < 5"),
    ("lte_exact", op("lte", "l_orderkey", 100.5), "l_orderkey <= 100"),
    ("in", {"op": "in", "field": ["l_linenumber"], "values": [1, 3, 7]}, "l_linenumber IN (1, 3, 7)"),
    ("not_in", {"op": "not_in", "field": ["l_returnflag"], "values": ["A", "N"]}, "l_returnflag NOT IN ('A', 'N')"),
    ("between", {"op": "between", "field": ["l_quantity"], "from": 10, "to": 12}, "l_quantity BETWEEN 10 AND 12"),
    ("and_or", every(some(eq("l_returnflag", "A"), eq("l_linestatus", "O")), op("gt", "l_tax", 0.05)), "(l_returnflag = 'A' OR l_linestatus = 'O') AND l_tax > 0.05"),
    ("not", negate(some(eq("l_returnflag", "A"), op("gt", "l_quantity", 10))), "NOT (l_returnflag = 'A' OR l_quantity > 10)"),
    ("field_ref", op("lt", "l_partkey", ref("l_suppkey")), "l_partkey < l_suppkey"),
    ("field_eq", {"op": "field", "field": ["l_linenumber"], "value": 2}, "l_linenumber = 2"),
    ("mixed_types", some(eq("l_returnflag", 1), eq("l_linenumber", 4)), "l_linenumber = 4"),
    ("unknown_field", some(eq("absent", 1), {"op": "is_null", "field": ["absent"]}), "true"),
    ("value_compare", {"op": "value_compare", "left": expr("add", ref("l_linenumber"), 1), "cmp": "gt", "right": 6}, "l_linenumber + 1 > 6"),
    ("is_not_null", {"op": "is_not_null", "field": ["l_shipdate"]}, "l_shipdate IS NOT NULL"),
    ("exists", every({"op": "exists", "field": ["l_tax"]}, {"op": "not_exists", "field": ["absent"]}, eq("l_linenumber", 1)), "l_linenumber = 1"),
    ("time_range", every(op("gte", "l_shipdate", 800_000_000_000), op("lt", "l_shipdate", 850_000_000_000)), "epoch_ms(l_shipdate) >= 800000000000 AND epoch_ms(l_shipdate) < 850000000000"),
):
    read_query(f"filter_{_name}", {"from": "lineitem", "select": LINES, "where": _filter}, f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_sql}")
for _name, _filter, _sql in (
    ("like", {"op": "like", "field": ["p_name"], "pattern": "%a_e%"}, "p_name LIKE '%a_e%'"),
    ("ilike", {"op": "i_like", "field": ["p_type"], "pattern": "%BRASS"}, "p_type ILIKE '%BRASS'"),
    ("regex", {"op": "regex", "field": ["p_brand"], "pattern": "#[12][0-9]$"}, "regexp_matches(p_brand, '#[12][0-9]$')"),
    ("computed", {"op": "computed", "expr_op": "lower", "field": ["p_brand"], "cmp": "eq", "value": "brand#11"}, "lower(p_brand) = 'brand#11'"),
    ("computed_length", {"op": "computed", "expr_op": "length", "field": ["p_name"], "cmp": "gt", "value": 12}, "strlen(p_name) > 12"),
    ("fn_value", op("gt", "p_retailprice", {"$fn": {"name": "math/mod", "args": [ref("p_partkey"), 1500]}}), "p_retailprice > p_partkey % 1500"),
    ("expr_value", op("gt", "p_retailprice", expr("mul", ref("p_size"), 50)), "p_retailprice > p_size * 50"),
):
    read_query(f"filter_{_name}", {"from": "part", "select": fields("p_partkey"), "where": _filter}, f"SELECT p_partkey FROM part WHERE {_sql}")
for _name, _filter, _sql in (
    ("contains", {"op": "contains", "field": ["tags"], "value": "the"}, "list_contains(w, 'the')"),
    ("contains_any", {"op": "contains_any", "field": ["tags"], "values": ["la", "und"]}, "list_has_any(w, ['la', 'und'])"),
    ("contains_all", {"op": "contains_all", "field": ["tags"], "values": ["the", "and"]}, "list_has_all(w, ['the', 'and'])"),
):

    def _tagged(spark, d, f=_filter):
        e = engine(spark, d)
        e.register("tagged", e.table("documents").rows().select("doc_id", F.split("text", " ").alias("tags")), id_col="doc_id")
        return e.read({"from": "tagged", "select": fields("doc_id"), "where": f}).df

    QUERIES[f"filter_{_name}"] = _tagged
    ORACLE[f"filter_{_name}"] = f"SELECT doc_id FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) WHERE {_sql}"


@query("filter_variant_path", "SELECT event_id FROM events WHERE (props->>'$.k')::BIGINT > 50")
def _variant(spark, d):
    e = engine(spark, d)
    e.register("parsed", e.table("events").rows().select("event_id", F.from_json("props", "k bigint").alias("props")), id_col="event_id")
    return e.read({"from": "parsed", "select": fields("event_id"), "where": {"op": "gt", "field": ["props", "k"], "value": 50}}).df


# -- aggregates

SUMMARY = [("count", "n"), ("min", "low"), ("max", "high"), ("avg", "mean"), ("sum", "total")]
read_query("aggregate_global", {"from": "part", "select": {"items": [{"type": "aggregate", "func": f, "field": ["p_size"], "alias": a} for f, a in SUMMARY]}}, "SELECT count(p_size) AS n, min(p_size) AS low, max(p_size) AS high, avg(p_size) AS mean, sum(p_size)::BIGINT AS total FROM part")
read_query("aggregate_distinct", {"from": "lineitem", "group_by": {"fields": [["l_returnflag"]]}, "select": {"items": ["l_returnflag", {"type": "aggregate", "func": "count", "field": ["l_partkey"], "distinct": True, "alias": "parts"}, {"type": "aggregate", "func": "sum", "field": ["l_linenumber"], "distinct": True, "alias": "numbers"}]}}, "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY 1")
read_query("aggregate_empty", {"from": "part", "where": op("lt", "p_size", 0), "select": {"items": [{"type": "count_all", "alias": "n"}, *({"type": "aggregate", "func": f, "field": ["p_size"], "alias": f} for f in ("sum", "avg", "min"))]}}, 'SELECT 0::BIGINT AS n, 0::BIGINT AS "sum", NULL::DOUBLE AS "avg", NULL::INTEGER AS "min"')
read_query("pricing_summary", {
    "from": "lineitem", "where": op("lte", "l_shipdate", "1998-09-02T00:00:00"), "group_by": {"fields": [["l_returnflag"], ["l_linestatus"]]},
    "select": {"items": ["l_returnflag", "l_linestatus", {"type": "aggregate", "func": "sum", "field": ["l_quantity"], "alias": "sum_qty"}, {"type": "aggregate", "func": "max", "field": ["l_extendedprice"], "alias": "max_price"}, {"type": "count_all", "alias": "n"}]},
}, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, max(l_extendedprice) AS max_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
LIBRARY = {
    "count": ("p_size", [], "count(p_size)"), "count_distinct": ("p_size", [], "count(DISTINCT p_size)"), "sum": ("p_size", [], "sum(p_size)::BIGINT"), "avg": ("p_size", [], "avg(p_size)"),
    "min": ("p_name", [], "min(p_name)"), "max": ("p_name", [], "max(p_name)"), "median": ("p_size", [], "quantile_disc(p_size, 0.5)"), "percentile": ("p_partkey", [0.9], "quantile_disc(p_partkey, 0.9)"),
    "stddev": ("p_size", [], "round(stddev_pop(p_size), 6)"), "variance": ("p_size", [], "round(var_pop(p_size), 6)"), "first": ("p_name", [], "arg_min(p_name, p_partkey)"), "last": ("p_name", [], "arg_max(p_name, p_partkey)"),
    "string_agg": ("p_type", ["|"], "string_agg(p_type, '|' ORDER BY p_partkey)"), "array_agg": ("p_size", [], "list(p_size ORDER BY p_partkey)"), "mode": ("p_size", [], None), "range": ("p_size", [], "max(p_size) - min(p_size)"),
}
for _name, (_field, _args, _sql) in LIBRARY.items():
    _spec = {"from": "part", "group_by": {"fields": [["p_brand"]]}, "select": {"items": ["p_brand", {"type": "aggregate_fn", "name": _name, "field": [_field], "args": _args, "alias": "x"}]}}
    if _name in ("stddev", "variance"):
        QUERIES[f"agg_{_name}"] = lambda spark, d, s=_spec: engine(spark, d).read(s).df.withColumn("x", F.round("x", 6))
        ORACLE[f"agg_{_name}"] = f"SELECT p_brand, {_sql} AS x FROM part GROUP BY 1"
    else:
        read_query(f"agg_{_name}", _spec, f"SELECT p_brand, {_sql} AS x FROM part GROUP BY 1" if _sql else "SELECT p_brand, p_size AS x FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS r FROM part GROUP BY 1, 2) WHERE r = 1")
for _name in ("bool_and", "bool_or"):

    @query(f"agg_{_name}", f"SELECT p_brand, {_name}(p_size > 10) AS x FROM part GROUP BY 1")
    def _bools(spark, d, n=_name):
        e = engine(spark, d)
        e.register("flagged", e.table("part").rows().select("p_partkey", "p_brand", (F.col("p_size") > 10).alias("big")), id_col="p_partkey")
        return e.read({"from": "flagged", "group_by": {"fields": [["p_brand"]]}, "select": {"items": ["p_brand", {"type": "aggregate_fn", "name": n, "field": ["big"], "alias": "x"}]}}).df


# -- dependent queries

CUSTOMERS = {"from": "customer", "where": eq("c_mktsegment", "BUILDING"), "select": fields("c_custkey")}
batch_query("semi_join", {"queries": {"c": CUSTOMERS, "o": {"from": "orders", "select": fields("o_orderkey", "o_custkey"), "where": {"op": "in", "field": ["o_custkey"], "values": [{"$query": "@c", "path": "[].c_custkey"}]}}}}, "o", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
batch_query("anti_join", {"queries": {"o": {"from": "orders", "select": fields("o_custkey")}, "c": {"from": "customer", "select": fields("c_custkey"), "where": {"op": "not_in", "field": ["c_custkey"], "values": [{"$query": "@o", "path": "[].o_custkey"}]}}}}, "c", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
batch_query("membership_in_or", {"queries": {"c": CUSTOMERS, "o": {"from": "orders", "select": fields("o_orderkey"), "where": some({"op": "in", "field": ["o_custkey"], "values": [{"$query": "@c", "path": "[].c_custkey"}]}, op("gt", "o_totalprice", 400000))}}}, "o", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
batch_query("scalar_lookup", {"queries": {"any": {"from": "nation", "order_by": ["n_nationkey"], "pagination": {"mode": "LimitOffset", "limit": 1, "offset": 3}}, "c": {"from": "customer", "select": fields("c_custkey"), "where": eq("c_nationkey", {"$query": "@any", "path": "[0].n_nationkey"})}}}, "c", "SELECT c_custkey FROM customer WHERE c_nationkey = (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 3)")
batch_query("query_count", {"queries": {"s": {"from": "supplier"}, "c": {"from": "customer", "select": fields("c_custkey"), "where": op("lte", "c_custkey", {"$query": "@s", "path": ".count"})}}}, "c", "SELECT c_custkey FROM customer WHERE c_custkey <= (SELECT count(*) FROM supplier)")
batch_query("guarded", {"queries": {"s": {"from": "supplier"}, "c": {"from": "region", "when": {"op": "value_compare", "left": {"$query": "@s", "path": ".count"}, "cmp": "gt", "right": 0}}}}, "c", "SELECT * FROM region")
batch_query("chain_of_three", {"queries": {
    "n": {"from": "nation", "select": fields("n_nationkey"), "where": eq("n_regionkey", 1)},
    "c": {"from": "customer", "select": fields("c_custkey"), "where": {"op": "in", "field": ["c_nationkey"], "values": [{"$query": "@n", "path": "[].n_nationkey"}]}},
    "o": {"from": "orders", "where": {"op": "in", "field": ["o_custkey"], "values": [{"$query": "@c", "path": "[].c_custkey"}]}, "group_by": {"fields": [["o_orderpriority"]]}, "select": {"items": ["o_orderpriority", {"type": "count_all", "alias": "n"}]}},
}}, "o", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) GROUP BY 1")

# -- scalar functions over the tables


def function_query(name: str, table: str, key: str, calls: dict[str, tuple[list, str]]) -> None:
    """Register a projection of library functions with their SQL."""
    items = [key, *({"type": "function", "name": f.split("#")[0], "args": a, "alias": f.split("/")[1].replace("#", "_")} for f, (a, _) in calls.items())]
    sql = ", ".join(f'{s} AS "{f.split("/")[1].replace("#", "_")}"' for f, (_, s) in calls.items())
    read_query(name, {"from": table, "select": {"items": items}}, f"SELECT {key}, {sql} FROM {table}")


function_query("fn_math", "part", "p_partkey", {
    "math/abs": ([expr("sub", ref("p_size"), 25)], "abs(p_size - 25)::BIGINT"), "math/ceil": ([ref("p_retailprice")], "ceil(p_retailprice)::BIGINT"), "math/floor": ([ref("p_retailprice")], "floor(p_retailprice)::BIGINT"),
    "math/round": ([ref("p_retailprice"), 1], "round(p_retailprice, 1)"), "math/trunc": ([ref("p_retailprice")], "trunc(p_retailprice)::BIGINT"), "math/sign": ([expr("sub", ref("p_size"), 25)], "sign(p_size - 25)::BIGINT"),
    "math/neg": ([ref("p_partkey")], "-p_partkey"), "math/pow": ([ref("p_size"), 2], "pow(p_size, 2)::DOUBLE"), "math/sqrt": ([ref("p_retailprice")], "sqrt(p_retailprice)"),
    "math/mod": ([ref("p_partkey"), 7], "p_partkey % 7"), "math/clamp": ([ref("p_partkey"), 10, 100], "least(greatest(p_partkey, 10), 100)"), "math/min": ([ref("p_partkey"), 50], "least(p_partkey, 50)"),
    "math/max": ([ref("p_partkey"), 50], "greatest(p_partkey, 50)"), "math/between": ([ref("p_size"), 5, 10], "p_size BETWEEN 5 AND 10"),
})


@query("fn_math_real", "SELECT p_partkey, round(exp(p_size / 10.0), 6) AS e, round(ln(p_retailprice), 9) AS l, round(log10(p_retailprice), 9) AS t, round(ln(p_retailprice) / ln(2), 9) AS b FROM part")
def _math_real(spark, d):
    items = [call("math/exp", expr("div", ref("p_size"), 10.0), alias="e"), call("math/ln", ref("p_retailprice"), alias="l"), call("math/log", ref("p_retailprice"), alias="t"), call("math/log", ref("p_retailprice"), 2, alias="b")]
    out = engine(spark, d).read({"from": "part", "select": {"items": ["p_partkey", *items]}}).df
    return out.select("p_partkey", F.round("e", 6).alias("e"), *(F.round(c, 9).alias(c) for c in "ltb"))


function_query("fn_strings", "part", "p_partkey", {
    "strings/lower": ([ref("p_brand")], "lower(p_brand)"), "strings/upper": ([ref("p_name")], "upper(p_name)"), "strings/trim": ([ref("p_name")], "trim(p_name)"), "strings/length": ([ref("p_name")], "length(p_name)"),
    "strings/byte_length": ([ref("p_name")], "strlen(p_name)"), "strings/substring": ([ref("p_name"), 2, 3], "substr(p_name, 3, 3)"), "strings/concat": ([ref("p_brand"), "-", ref("p_type")], "p_brand || '-' || p_type"),
    "strings/replace": ([ref("p_name"), "a", "AA"], "replace(p_name, 'a', 'AA')"), "strings/split": ([ref("p_type"), " "], "string_split(p_type, ' ')"), "strings/starts_with": ([ref("p_type"), "STANDARD"], "starts_with(p_type, 'STANDARD')"),
    "strings/ends_with": ([ref("p_type"), "S"], "ends_with(p_type, 'S')"), "strings/contains": ([ref("p_name"), "e"], "contains(p_name, 'e')"), "strings/index_of": ([ref("p_name"), "e"], "(instr(p_name, 'e') - 1)::BIGINT"),
    "strings/repeat": ([ref("p_brand"), 2], "repeat(p_brand, 2)"), "strings/reverse": ([ref("p_name")], "reverse(p_name)"), "strings/pad_left": ([{"$fn": {"name": "cast/to_string", "args": [ref("p_partkey")]}}, 8, "0"], "lpad(p_partkey::VARCHAR, 8, '0')"),
    "strings/pad_right": ([{"$fn": {"name": "cast/to_string", "args": [ref("p_partkey")]}}, 8, "."], "rpad(p_partkey::VARCHAR, 8, '.')"),
})
function_query("fn_regex", "part", "p_partkey", {
    "strings/is_reg_match": ([ref("p_brand"), "#1"], "regexp_matches(p_brand, '#1')"), "strings/reg_query": ([ref("p_brand"), "[0-9]+"], "nullif(regexp_extract(p_brand, '[0-9]+'), '')"),
    "strings/reg_query_all": ([ref("p_name"), "[aeiou]"], "regexp_extract_all(p_name, '[aeiou]')"), "strings/reg_replace": ([ref("p_name"), "[aeiou]", "_"], "regexp_replace(p_name, '[aeiou]', '_', 'g')"),
    "strings/reg_split": ([ref("p_type"), " +"], "regexp_split_to_array(p_type, ' +')"), "strings/reg_count": ([ref("p_name"), "[aeiou]"], "len(regexp_extract_all(p_name, '[aeiou]'))"),
})
function_query("fn_null", "part", "p_partkey", {
    "null/coalesce": ([{"$fn": {"name": "null/nullif", "args": [ref("p_size"), 1]}}, -1], "coalesce(nullif(p_size, 1), -1)"), "null/if_null": ([None, ref("p_name")], "p_name"), "null/nullif": ([ref("p_size"), 1], "nullif(p_size, 1)"), "null/is_null": ([ref("p_size")], "p_size IS NULL"),
})
function_query("fn_cast", "part", "p_partkey", {
    "cast/to_int": ([ref("p_size")], "p_size::BIGINT"), "cast/to_int#frac": ([ref("p_retailprice")], "CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT END"), "cast/to_string": ([ref("p_partkey")], "p_partkey::VARCHAR"),
    "cast/to_bool": ([ref("p_size")], "p_size <> 0"), "cast/parse_int": ([{"$fn": {"name": "strings/reg_query", "args": [ref("p_brand"), "[0-9]+"]}}], "nullif(regexp_extract(p_brand, '[0-9]+'), '')::BIGINT"),
})
function_query("fn_datetime", "events", "event_id", {
    "datetime/to_epoch_ms": ([ref("ts")], "(epoch_us(ts) // 1000)"), "datetime/to_epoch_s": ([ref("ts")], "(epoch_us(ts) // 1000000)"), "datetime/year": ([ref("ts")], "year(ts)"), "datetime/month": ([ref("ts")], "month(ts)"),
    "datetime/day": ([ref("ts")], "day(ts)"), "datetime/hour": ([ref("ts")], "hour(ts)"), "datetime/minute": ([ref("ts")], "minute(ts)"), "datetime/second": ([ref("ts")], "second(ts)"), "datetime/weekday": ([ref("ts")], "isodow(ts) - 1"),
    "datetime/is_weekend": ([ref("ts")], "isodow(ts) >= 6"), "datetime/add_secs": ([ref("ts"), 90], "(epoch_us(ts) // 1000) + 90000"), "datetime/add_days": ([ref("ts"), -2], "(epoch_us(ts) // 1000) - 172800000"),
    "datetime/start_of_day": ([ref("ts")], "epoch_ms(date_trunc('day', ts)::TIMESTAMP)"), "datetime/start_of_week": ([ref("ts")], "epoch_ms(date_trunc('week', ts)::TIMESTAMP)"), "datetime/start_of_month": ([ref("ts")], "epoch_ms(date_trunc('month', ts)::TIMESTAMP)"),
    "datetime/truncate": ([ref("ts"), "hour"], "epoch_ms(date_trunc('hour', ts))"), "datetime/format": ([ref("ts"), "%Y-%m-%d %H:%M:%S"], "strftime(ts, '%Y-%m-%d %H:%M:%S')"), "datetime/diff_secs": ([ref("ts"), 1_704_067_200_000], "((epoch_us(ts) // 1000 - 1704067200000) // 1000)"),
})


@query("fn_arrays", """
    SELECT doc_id, len(w)::BIGINT AS n, w[1] AS f, w[-1] AS l, len(list_distinct(w))::BIGINT AS d, list_contains(w, 'the') AS c, list_sort(w[2:4]) AS s, w[3] AS g,
           array_to_string(w[1:3], '+') AS j, coalesce(list_position(w, 'the'), 0)::BIGINT - 1 AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def _arrays(spark, d):
    e = engine(spark, d)
    e.register("worded", e.table("documents").rows().select("doc_id", F.split("text", " ").alias("w")), id_col="doc_id")
    w, part = ref("w"), lambda a, n: {"$fn": {"name": "arrays/slice", "args": [ref("w"), a, n]}}
    items = [
        call("arrays/length", w, alias="n"), call("arrays/first", w, alias="f"), call("arrays/last", w, alias="l"), call("arrays/length", {"$fn": {"name": "arrays/distinct", "args": [w]}}, alias="d"), call("arrays/contains", w, "the", alias="c"),
        call("arrays/sort", part(1, 3), alias="s"), call("arrays/get", w, 2, alias="g"), call("arrays/join", part(0, 3), "+", alias="j"), call("arrays/index_of", w, "the", alias="i"),
    ]
    return e.read({"from": "worded", "select": {"items": ["doc_id", *items]}}).df


function_query("fn_encode", "part", "p_partkey", {
    "encode/base64_enc": ([ref("p_name")], "base64(p_name::BLOB)"), "encode/hex_enc": ([ref("p_name")], "lower(hex(p_name))"), "encode/html_escape": ([ref("p_brand")], "p_brand"), "text/word_count": ([ref("p_type")], "len(regexp_extract_all(p_type, '\\S+'))"),
    "text/slugify": ([ref("p_brand")], "lower(replace(p_brand, '#', '-'))"), "text/levenshtein": ([ref("p_name"), ref("p_brand")], "levenshtein(p_name, p_brand)"), "validate/is_email": ([ref("p_name")], "false"), "validate/len_between": ([ref("p_name"), 5, 10], "length(p_name) BETWEEN 5 AND 10"),
    "validate/is_empty": ([ref("p_name")], "p_name = ''"), "validate/in_range": ([ref("p_size"), 5, 10], "p_size BETWEEN 5 AND 10"), "validate/matches": ([ref("p_brand"), "1$"], "regexp_matches(p_brand, '1$')"), "value_nav/type_of": ([ref("p_size")], "'int'"),
    "encode/url_encode": ([ref("p_brand")], "replace(p_brand, '#', '%23')"), "text/truncate_ellipsis": ([ref("p_name"), 5], "CASE WHEN length(p_name) <= 5 THEN p_name ELSE substr(p_name, 1, 4) || '…' END"),
})


def fn(name: str, *args) -> dict:
    """A function call as a value."""
    return {"$fn": {"name": name, "args": list(args)}}


def key_text() -> dict:
    return fn("cast/to_string", ref("p_partkey"))


function_query("fn_strings_more", "part", "p_partkey", {
    "strings/ltrim": ([fn("strings/concat", "  ", ref("p_name"))], "ltrim('  ' || p_name)"), "strings/rtrim": ([fn("strings/concat", ref("p_name"), "  ")], "rtrim(p_name || '  ')"),
    "strings/reg_captures": ([ref("p_brand"), "([A-Z])[a-z]+#([1-3])"], "CASE WHEN regexp_matches(p_brand, '([A-Z])[a-z]+#([1-3])') THEN [regexp_extract(p_brand, '([A-Z])[a-z]+#([1-3])', 0), regexp_extract(p_brand, '([A-Z])[a-z]+#([1-3])', 1), regexp_extract(p_brand, '([A-Z])[a-z]+#([1-3])', 2)] END"),
    "strings/reg_find_index": ([ref("p_name"), "[aeiou]"], "CASE WHEN regexp_matches(p_name, '[aeiou]') THEN length(regexp_extract(p_name, '^[^aeiou]*')) ELSE -1 END::BIGINT"),
    "text/normalize_nfc": ([ref("p_name")], "nfc_normalize(p_name)"), "text/jaro_winkler": ([ref("p_name"), ref("p_name")], "1.0::DOUBLE"),
})
function_query("fn_cast_more", "part", "p_partkey", {
    "math/between#to_float": ([fn("cast/to_float", fn("cast/to_string", ref("p_size"))), 10, 20], "p_size BETWEEN 10 AND 20"), "math/between#to_dec": ([fn("cast/to_dec", ref("p_size")), 5, 30], "p_size BETWEEN 5 AND 30"),
    "math/between#parse_float": ([fn("cast/parse_float", fn("strings/reg_query", ref("p_brand"), "[0-9]+")), 1, 23], "regexp_extract(p_brand, '[0-9]+')::INT BETWEEN 1 AND 23"), "cast/try_cast": ([ref("p_size"), "string"], "p_size::VARCHAR"),
})
function_query("fn_encode_more", "part", "p_partkey", {
    "encode/hex_enc#base64_dec": ([fn("encode/base64_dec", fn("encode/base64_enc", ref("p_name")))], "lower(hex(p_name))"), "encode/base64url_enc": ([ref("p_name")], "translate(base64(p_name::BLOB), '+/', '-_')"),
    "encode/hex_enc#base64url_dec": ([fn("encode/base64url_dec", fn("encode/base64url_enc", ref("p_name")))], "lower(hex(p_name))"), "encode/hex_enc#hex_dec": ([fn("encode/hex_dec", fn("encode/hex_enc", ref("p_name")))], "lower(hex(p_name))"),
    "encode/hex_enc#base32_dec": ([fn("encode/base32_dec", fn("encode/base32_enc", ref("p_name")))], "lower(hex(p_name))"), "encode/url_decode": ([fn("encode/url_encode", ref("p_brand"))], "p_brand"),
    "encode/json_escape": ([fn("strings/concat", ref("p_name"), '"\n')], "p_name || '\\\"\\n'"), "encode/to_json": ([ref("p_brand")], "'\"' || p_brand || '\"'"), "encode/to_json#parse_json": ([fn("encode/parse_json", fn("strings/concat", '{"a": ', key_text(), "}"))], "'{\"a\":' || p_partkey || '}'"),
    "crypto/ct_eq": ([fn("encode/hex_dec", fn("encode/hex_enc", ref("p_name"))), fn("encode/hex_dec", fn("encode/hex_enc", ref("p_brand")))], "p_name = p_brand"),
    "strings/length#sha512": ([fn("encode/hex_enc", fn("crypto/sha512", fn("encode/hex_dec", fn("encode/hex_enc", ref("p_name")))))], "128::BIGINT"),
})
UUID_TAIL, LUHN_DIGIT = "-0000-4000-8000-00000000000", "substr(reverse(p_partkey::VARCHAR), i + 1, 1)::INT"
function_query("fn_validate_more", "part", "p_partkey", {
    "validate/is_email": ([fn("strings/concat", key_text(), "@", fn("strings/replace", fn("strings/substring", ref("p_type"), 0, 4), "A", ".aa"))], "regexp_matches(p_partkey || '@' || replace(substr(p_type, 1, 4), 'A', '.aa'), '^[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}$')"),
    "validate/is_url": ([fn("strings/concat", fn("strings/replace", ref("p_type"), "STANDARD", "http://s"), "")], "regexp_matches(replace(p_type, 'STANDARD', 'http://s'), '^https?://[^\\s/$.?#][^\\s]*$')"),
    "validate/is_uuid": ([fn("strings/concat", fn("strings/pad_left", key_text(), 8, "0"), UUID_TAIL, fn("strings/substring", ref("p_brand"), 6, 1))], f"regexp_matches(lpad(p_partkey::VARCHAR, 8, '0') || '{UUID_TAIL}' || substr(p_brand, 7, 1), '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')"),
    "validate/is_ipv4": ([fn("strings/concat", fn("cast/to_string", expr("mul", ref("p_size"), 10)), ".1.2.3")], "p_size * 10 <= 255"), "validate/is_ipv6": ([fn("strings/concat", "2001:db8::", fn("cast/to_string", expr("mul", ref("p_size"), 500)))], "p_size * 500 <= 9999"),
    "validate/is_phone": ([fn("strings/concat", "+", fn("cast/to_string", expr("mul", ref("p_partkey"), 100000)))], "p_partkey >= 10"), "validate/is_json": ([fn("strings/concat", "[", fn("strings/replace", ref("p_brand"), "Brand#", ""), fn("strings/substring", "]]", 0, fn("math/mod", ref("p_partkey"), 3)))], "p_partkey % 3 = 1"),
    "validate/luhn": ([key_text()], f"list_sum(list_transform(range(length(p_partkey::VARCHAR)), lambda i: CASE WHEN i % 2 = 0 THEN {LUHN_DIGIT} ELSE {LUHN_DIGIT} * 2 - 9 * ({LUHN_DIGIT} > 4)::INT END)) % 10 = 0"),
})
function_query("fn_datetime_more", "events", "event_id", {
    "datetime/from_epoch_s": ([ref("event_id")], "event_id * 1000"), "datetime/from_epoch_ms": ([ref("event_id")], "event_id"),
    "datetime/format_rfc3339": ([ref("ts")], "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN (epoch_us(ts) // 1000) % 1000 = 0 THEN '' ELSE strftime(ts, '.%g') END || '+00:00'"),
    "datetime/parse_rfc3339": ([fn("datetime/format_rfc3339", ref("ts"))], "(epoch_us(ts) // 1000)"), "datetime/parse": ([fn("datetime/format", ref("ts"), "%Y-%m-%d %H:%M:%S"), "%Y-%m-%d %H:%M:%S"], "(epoch_us(ts) // 1000000) * 1000"),
    "math/between#now": ([fn("datetime/now"), 1_700_000_000_000, 9_000_000_000_000], "true"), "math/between#age": ([fn("datetime/age", ref("ts")), 0, 9_000_000_000], "true"), "strings/length#uuid": ([fn("gen/uuid_v4")], "36::BIGINT"),
    "math/between#random": ([fn("gen/random"), 0, 1], "true"), "strings/length#bytes": ([fn("encode/hex_enc", fn("gen/random_bytes", 8))], "16::BIGINT"),
})


@query("fn_arrays_more", """
    SELECT l_orderkey, l_linenumber, list_sum(a)::BIGINT AS s, list_min(a) AS lo, list_max(a) AS hi, list_avg(a) AS m, list_reverse_sort(a) AS d, flatten([a, a]) AS f
    FROM (SELECT l_orderkey, l_linenumber, [l_linenumber, l_orderkey, l_partkey]::BIGINT[] AS a FROM lineitem)""")
def _arrays_more(spark, d):
    e = engine(spark, d)
    a = F.array(F.col("l_linenumber").cast("bigint"), "l_orderkey", "l_partkey")
    e.register("triples", e.table("lineitem").rows().select("l_orderkey", "l_linenumber", a.alias("a"), F.array(a, a).alias("aa")))
    calls = [call(f"arrays/{f}", ref("a"), alias=k) for f, k in (("sum", "s"), ("min", "lo"), ("max", "hi"), ("avg", "m"), ("sort_desc", "d"))]
    return e.read({"from": "triples", "select": {"items": ["l_orderkey", "l_linenumber", *calls, call("arrays/flatten", ref("aa"), alias="f")]}}).df


@query("fn_objects", """
    SELECT event_id, k AS g, ['k'] AS keys, [k] AS vals, 1::BIGINT AS entries, true AS has, false AS lacks, event_type AS path, false AS gone, ['k'] AS picked, 0::BIGINT AS omitted, k AS merged, 2::BIGINT AS width
    FROM (SELECT event_id, event_type, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events)""")
def _objects(spark, d):
    e = engine(spark, d)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    e.register("parsed", e.table("events").rows().select("event_id", F.create_map(F.lit("k"), k).alias("m"), F.struct(F.struct("event_type").alias("in"), k.alias("n")).alias("s"), F.create_map(F.lit("k"), k - 1, F.lit("z"), k).alias("older")), id_col="event_id")
    m, s, both = ref("m"), ref("s"), fn("object/merge", ref("older"), ref("m"))
    items = [
        call("object/get_path", m, "k", alias="g"), call("object/keys", m, alias="keys"), call("object/values", m, alias="vals"), call("arrays/length", fn("object/entries", m), alias="entries"), call("object/has_key", m, "k", alias="has"),
        call("object/has_key", m, "z", alias="lacks"), call("value_nav/get_path", s, "in.event_type", alias="path"), call("value_nav/exists", s, "in.absent", alias="gone"), call("value_nav/keys", fn("object/pick", m, ["k"]), alias="picked"),
        call("value_nav/array_length", fn("object/keys", fn("object/omit", m, ["k"])), alias="omitted"), call("object/get_path", both, "k", alias="merged"), call("arrays/length", fn("object/keys", both), alias="width"),
    ]
    return e.read({"from": "parsed", "select": {"items": ["event_id", *items]}}).df


@query("fn_crypto", "SELECT doc_id, sha256(text) AS h FROM documents")
def _crypto(spark, d):
    e = engine(spark, d)
    e.register("raw", e.table("documents").rows().select("doc_id", F.col("text").cast("binary").alias("b")), id_col="doc_id")
    return e.read({"from": "raw", "select": {"items": ["doc_id", call("encode/hex_enc", {"$fn": {"name": "crypto/sha256", "args": [ref("b")]}}, alias="h")]}}).df


@query("fn_crypto_vectors", """
    SELECT 'a7ffc6f8bf1ed76651c14756a061d662f580ff4de43b49fa82d80a4b80f8434a' AS sha3, 'af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262' AS blake3,
           '5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843' AS hmac, 'fi 2' AS nfkc""")
def _vectors(spark, d):
    """Published test vectors of the digests that SQL lacks."""
    e = Engine(spark)
    rows = spark.createDataFrame([(1, b"", b"Jefe", b"what do ya want for nothing?", "\ufb01 \u00b2")], "_id long, e binary, k binary, m binary, t string")
    e.register("vectors", rows)
    hexed = lambda name, *a: {"$fn": {"name": "encode/hex_enc", "args": [{"$fn": {"name": name, "args": list(a)}}]}}
    items = [call("strings/lower", hexed("crypto/sha3_256", ref("e")), alias="sha3"), call("strings/lower", hexed("crypto/blake3", ref("e")), alias="blake3"), call("strings/lower", hexed("crypto/hmac_sha256", ref("k"), ref("m")), alias="hmac"), call("text/normalize_nfkc", ref("t"), alias="nfkc")]
    return e.read({"from": "vectors", "select": {"items": items}}).df


@query("expr_operators", """
    SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS a, l_linenumber - 1 AS s, l_orderkey * 2 AS m, l_quantity / l_linenumber AS d, l_orderkey % 3 AS r, -l_linenumber AS n,
           l_returnflag || l_linestatus AS c, l_quantity > 10 AND l_tax < 0.04 AS b FROM lineitem""")
def _expressions(spark, d):
    e = engine(spark, d)
    rows = e.table("lineitem").rows()
    scope = Scope(rows)
    n, two = ref("l_linenumber"), lambda o, a, b: value(expr(o, a, b), scope).c
    return rows.select("l_orderkey", "l_linenumber", two("add", n, 1).alias("a"), two("sub", n, 1).alias("s"), two("mul", ref("l_orderkey"), 2).alias("m"), two("div", ref("l_quantity"), n).alias("d"), two("mod", ref("l_orderkey"), 3).alias("r"), value(expr("neg", n), scope).c.alias("n"), two("concat", ref("l_returnflag"), ref("l_linestatus")).alias("c"), two("and", expr("gt", ref("l_quantity"), 10), expr("lt", ref("l_tax"), 0.04)).alias("b"))


# -- search

read_query("fts_and", {"from": "documents", "select": fields("doc_id"), "where": {"op": "fts", "field": ["text"], "query": "The AND of"}}, "SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '\\S+'), ['the', 'and', 'of'])")
read_query("fts_or", {"from": "documents", "select": fields("doc_id"), "where": {"op": "fts", "field": ["text"], "query": "la und", "mode": "or"}}, "SELECT doc_id FROM documents WHERE list_has_any(regexp_extract_all(lower(text), '\\S+'), ['la', 'und'])")


@query("bm25", """
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
    f AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'ening')) AS b FROM t),
    s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f)
    SELECT doc_id, round(ln((docs - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean))
                       + ln((docs - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 9) AS score
    FROM f, s WHERE a > 0 OR b > 0""")
def _bm25(spark, d):
    docs = engine(spark, d).table("documents").rows()
    return fts.ranked(docs, "the ening", "doc_id", "text").withColumn("score", F.round("score", 9))


@query("fts_index_and", ORACLE["fts_and"])
def _fts_index(spark, d):
    return fts.PostingIndex.build(engine(spark, d).table("documents").rows(), new_path(spark, "postings"), "doc_id", "text", "whitespace").matches("The AND of")


@query("bm25_index", ORACLE["bm25"])
def _bm25_index(spark, d):
    index = fts.PostingIndex.build(engine(spark, d).table("documents").rows(), new_path(spark, "postings"), "doc_id", "text")
    return index.ranked("the ening").select("doc_id", F.round("score", 9).alias("score"))


@query("inverted_index", "SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents) GROUP BY 1, 2")
def _inverted(spark, d):
    return fts.inverted_index(engine(spark, d).table("documents").rows(), "doc_id", "text")


@query("tokens_full", "SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '\\S+'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in fts.STOPWORDS["english"]) + ")) AS t FROM conversations")
def _full(spark, d):
    return engine(spark, d).table("conversations").rows().select("conv_id", "turn", fts.tokens(F.col("text"), "full").alias("t"))


#: Words and their stems as the algorithms are published.
STEMS = {
    "danish": ("undersøgelse undersøger", "undersøg undersøg"), "dutch": ("lichamelijkheden opgingen brieven", "licham opging briev"), "english": ("consigned nationality hopping", "consign nation hop"),
    "french": ("continuellement majestueusement chevaux activité", "continuel majestu cheval activ"), "german": ("aufeinanderfolge kategorisch häuser", "aufeinanderfolg kategor haus"),
    "italian": ("abbandonata abbandonerò propaganda", "abbandon abbandon propagand"), "norwegian": ("havnedistriktets opninga", "havnedistrikt opning"), "portuguese": ("boiando quilométricos felizmente", "boi quilométr feliz"),
    "russian": ("важнейшие важности вавиловка", "важн важност вавиловк"), "spanish": ("chicharrones toreado rápidamente", "chicharron tor rapid"), "swedish": ("jaktkarlarne klostergården", "jaktkarl klostergård"),
}


@query("tokens_stemmed", "SELECT language, string_split(w, ' ') AS t FROM (VALUES " + ", ".join(f"('{k}', '{v[1]}')" for k, v in STEMS.items()) + ") AS s(language, w)")
def _stemmed(spark, d):
    parts = [spark.createDataFrame([(k, v[0])], "language string, w string").select("language", fts.tokens(F.col("w"), "full", language=k, stems=True).alias("t")) for k, v in STEMS.items()]
    return reduce(DataFrame.unionByName, parts)


@query("tokens_ngram", "SELECT p_partkey, CASE WHEN length(p_brand) <= 3 THEN [lower(p_brand)] ELSE list_transform(range(1, length(p_brand) - 1), lambda i: substr(lower(p_brand), i, 3)) END AS t FROM part")
def _ngram(spark, d):
    return engine(spark, d).table("part").rows().select("p_partkey", fts.tokens(F.col("p_brand"), "ngram", 3).alias("t"))


QUERY_VECTOR = [((i * 37) % 64 - 32) / 32.0 for i in range(64)]
_VECTOR_SQL = "[" + ", ".join(str(x) for x in QUERY_VECTOR) + "]::DOUBLE[]"
for _metric, _sql in {"l2": "sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - q[i]) * (v[i] - q[i]))))", "cosine": "1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))", "dot": "-list_dot_product(v, q)"}.items():

    @query(f"knn_{_metric}", f"SELECT vec_id, label, round({_sql}, 6) AS distance FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v, {_VECTOR_SQL} AS q FROM embeddings) ORDER BY {_sql}, vec_id LIMIT 15")
    def _knn(spark, d, m=_metric):
        out = engine(spark, d).read({"from": "embeddings", "where": {"op": "vector_similarity", "field": ["embedding"], "query": QUERY_VECTOR, "k": 15, "metric": m}}).df
        return out.select("vec_id", "label", F.round("_distance", 6).alias("distance"))


read_query("knn_filtered", {"from": "embeddings", "select": fields("vec_id"), "where": every({"op": "vector_similarity", "field": ["embedding"], "query": QUERY_VECTOR, "k": 10}, op("lte", "label", 2))}, f"SELECT vec_id FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v, {_VECTOR_SQL} AS q FROM embeddings) WHERE label <= 2 ORDER BY sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - q[i]) * (v[i] - q[i])))), vec_id LIMIT 10")



_EXACT_SQL = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - q[i]) * (v[i] - q[i]))))"


@query("knn_index", f"SELECT vec_id, label, round({_EXACT_SQL}, 6) AS distance FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v, {_VECTOR_SQL} AS q FROM embeddings) ORDER BY {_EXACT_SQL}, vec_id LIMIT 15")
def _knn_index(spark, d):
    """The written index with all its cells probed, which gives the exact result by way of the codes."""
    e = engine(spark, d)
    index = e.create_vector_index("embeddings", "by_cell", "embedding", new_path(spark, "cells"))
    return index.search(QUERY_VECTOR, 15, probes=len(index.centres)).select("vec_id", "label", F.round("_distance", 6).alias("distance"))


# -- time travel: the events of a user are the versions of that user


def _versions(spark: SparkSession, d: str) -> DataFrame:
    rows = engine(spark, d).table("events").rows()
    return rows.select(F.col("user_id").cast("string").alias("_id"), F.col("event_id").alias("_version"), F.unix_millis(F.col("ts").cast("timestamp")).alias("_ts"), (F.col("event_type") == "purchase").alias("_deleted"), "event_type", "value")


@query("temporal_latest", "SELECT user_id::VARCHAR AS _id, event_id AS _version, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'purchase'")
def _latest(spark, d):
    return temporal.latest(_versions(spark, d))


@query("temporal_as_of", "SELECT user_id::VARCHAR AS _id, event_id AS _version, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id <= 500) WHERE r = 1 AND event_type <> 'purchase'")
def _as_of(spark, d):
    return temporal.as_of(_versions(spark, d), {"version": 500})


@query("temporal_history", """
    WITH now AS (SELECT user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'purchase' AND value > 50)
    SELECT user_id::VARCHAR AS _id, event_id AS _version, (epoch_us(ts) // 1000) AS _ts, event_type = 'purchase' AS _deleted, event_type, value FROM events WHERE user_id IN (SELECT user_id FROM now) AND event_id BETWEEN 100 AND 800""")
def _history(spark, d):
    return temporal.timeline(_versions(spark, d), op("gt", "value", 50), {"from": {"version": 100}, "to": {"version": 800}})


@query("retention", "SELECT user_id::VARCHAR AS _id, event_id AS _version FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def _retention(spark, d):
    return temporal.retained(_versions(spark, d), 0, max_count=3).select("_id", "_version")


@query("purge", "SELECT user_id::VARCHAR AS _id, event_id AS _version FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS top FROM events) WHERE event_id >= 700 OR event_id = top")
def _purge(spark, d):
    return temporal.purged(_versions(spark, d), older_than=700).select("_id", "_version")


# -- schemas

RULES = [
    {"path": "c_name", "required": True, "type": "string", "max_len": 17}, {"path": "c_acctbal", "type": "f64", "min": 0}, {"path": "c_mktsegment", "one_of": ["BUILDING", "MACHINERY", "HOUSEHOLD"]},
    {"path": "c_custkey", "type": "int", "unsigned": True, "compare": {"path": "c_nationkey", "op": "gt"}},
]


@query("schema_violations", """
    SELECT c_custkey, 'c_name' AS path, 'max_len' AS code FROM customer WHERE length(c_name) > 17
    UNION ALL SELECT c_custkey, 'c_acctbal', 'min' FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT c_custkey, 'c_mktsegment', 'one_of' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
    UNION ALL SELECT c_custkey, 'c_custkey', 'compare' FROM customer WHERE NOT c_custkey > c_nationkey""")
def _violations(spark, d):
    return schema.violations(engine(spark, d).table("customer").rows(), RULES, "c_custkey")


@query("foreign_key_orphans", "SELECT doc_id FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id AND d.lang = 'en')")
def _orphans(spark, d):
    e = engine(spark, d)
    parents = e.read({"from": "documents", "where": eq("lang", "en"), "select": fields("doc_id")}).df
    return schema.orphans(e.table("labels").rows(), "doc_id", parents, "doc_id").select("doc_id")


@query("unique_duplicates", "SELECT c_nationkey AS value, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def _duplicates(spark, d):
    return schema.duplicates(engine(spark, d).table("customer").rows(), "c_nationkey")


# -- change rows


@query("subscription_rows", "SELECT 'events' AS \"table\", CASE WHEN event_type = 'purchase' THEN 'delete' ELSE 'put' END AS op, user_id::VARCHAR AS key, event_id AS commit_version FROM events WHERE (event_type = 'purchase' OR value >= 90) AND event_id >= 100")
def _subscription(spark, d):
    from .streaming import subscribe

    rows = engine(spark, d).table("events").rows()
    changes = rows.select(F.lit("events").alias("table"), F.when(F.col("event_type") == "purchase", "delete").otherwise("put").alias("op"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("commit_version"), F.struct("value", "event_type").alias("value"))
    return subscribe.matching(changes, {"subscribe": [{"table": "events", "filter": op("gte", "value", 90)}], "deliver": "keys", "from_version": 100})


# -- writes: versioned tables in the shared folder, filled from the test tables

PART_SQL = "SELECT p_partkey::VARCHAR AS _id, p_name, p_size FROM part"


PART_FIELDS = T.StructType([T.StructField("p_name", T.StringType()), T.StructField("p_size", T.IntegerType())])


def _parts(spark: SparkSession, d: str) -> VersionedTable:
    rows = engine(spark, d).table("part").rows().select(F.col("p_partkey").cast("string").alias("_id"), "p_name", "p_size")
    table = VersionedTable(spark, new_path(spark, "parts"), PART_FIELDS)
    table.insert(rows, now_ms=1000)
    return table


@query("write_insert", PART_SQL)
def _insert(spark, d):
    return _parts(spark, d).latest().drop("_version")


@query("write_update", "SELECT p_partkey::VARCHAR AS _id, p_name, CASE WHEN p_size > 40 THEN p_size - 40 ELSE p_size END::INTEGER AS p_size, CASE WHEN p_size > 40 THEN 2 ELSE 1 END::BIGINT AS _version FROM part")
def _update(spark, d):
    table = _parts(spark, d)
    table.update(op("gt", "p_size", 40), {"p_size": expr("sub", ref("p_size"), 40)}, now_ms=2000)
    return table.latest()


@query("write_upsert", "SELECT * REPLACE (CASE WHEN p_size = 7 THEN 'seven' ELSE p_name END AS p_name) FROM (" + PART_SQL + ")")
def _upsert(spark, d):
    table = _parts(spark, d)
    table.upsert({"p_size": 7}, {"p_name": "seven"}, now_ms=2000)
    return table.latest().drop("_version")


@query("write_delete", "SELECT p_partkey::VARCHAR AS _id, p_name, p_size FROM part WHERE NOT (p_size BETWEEN 10 AND 20)")
def _delete(spark, d):
    table = _parts(spark, d)
    table.delete({"op": "between", "field": ["p_size"], "from": 10, "to": 20}, now_ms=2000)
    return table.latest().drop("_version")


@query("as_of_before_delete", PART_SQL)
def _before(spark, d):
    table = _parts(spark, d)
    table.delete(op("gt", "p_size", 5), now_ms=2000)
    e = Engine(spark)
    e.register("parts", table)
    return e.read({"from": "parts", "temporal": {"kind": "as_of", "at": {"timestamp": 1500}}}).df.drop("_version")


@query("changes_since", "SELECT p_partkey::VARCHAR AS key, 'delete' AS op, 2::BIGINT AS commit_version FROM part WHERE p_size < 10")
def _changes(spark, d):
    table = _parts(spark, d)
    table.delete(op("lt", "p_size", 10), now_ms=2000)
    return table.changes_since(1)[0].drop("value")


@query("transaction_batch", "SELECT p_partkey::VARCHAR AS _id, p_name, CASE WHEN p_size = 3 THEN 99 ELSE p_size END AS p_size FROM part WHERE p_size <> 4 UNION ALL SELECT 'new', 'added', 1")
def _transaction(spark, d):
    e = Engine(spark)
    e.register("parts", _parts(spark, d))
    done = e.batch({"transactional": True, "queries": {
        "a": {"insert_into": "parts", "values": [{"_id": "new", "p_name": "added", "p_size": 1}]},
        "u": {"update": "parts", "where": eq("p_size", 3), "set": {"p_size": 99}, "after": ["a"]},
        "d": {"delete_from": "parts", "where": eq("p_size", 4), "after": ["u"]},
        "r": {"from": "parts", "after": ["d"]},
    }})
    return done["results"]["r"].df.drop("_version")


@query("write_computed", "SELECT * FROM (VALUES ('a', 'ROAD', 8), ('b', 'plain', 5)) AS t(_id, p_name, p_size)")
def _computed_writes(spark, d):
    e, call = Engine(spark), lambda name, *args: {"$fn": {"name": name, "args": list(args)}}
    e.register("parts", VersionedTable(spark, new_path(spark, "computed"), PART_FIELDS))
    e.batch({"queries": {"i": {"insert_into": "parts", "values": [{"_id": "a", "p_name": call("strings/upper", "road"), "p_size": 8}, {"_id": "b", "p_name": "plain", "p_size": call("strings/length", {"$ref": ["p_name"]})}]}}})
    try:
        e.batch({"queries": {"i": {"insert_into": "parts", "values": [{"_id": "c", "p_name": call("strings/repeat", "x", -1), "p_size": 1}]}}})
    except QueryError as error:
        if error.code != "computed_value_failed":
            raise
    return e.read({"from": "parts"}).df.drop("_version")


@query("transaction_conflict", "SELECT p_partkey::VARCHAR AS _id, p_name, CASE WHEN p_size = 3 THEN 99 ELSE p_size END AS p_size FROM part")
def _conflict(spark, d):
    """A serializable batch whose table is written by another between its read and its end leaves nothing."""
    e, table = Engine(spark), _parts(spark, d)
    e.register("parts", table)
    e.register_procedure("other", lambda engine, params: VersionedTable(spark, table.path, table.fields).update(eq("p_size", 3), {"p_size": 99}) and None)
    try:
        e.batch({"transactional": True, "isolation": "serializable", "queries": {"r": {"from": "parts"}, "o": {"call": "other", "after": ["r"]}, "w": {"update": "parts", "where": eq("p_size", 4), "set": {"p_size": 0}, "after": ["o"]}}})
    except QueryError as error:
        if error.code != "transaction_conflict":
            raise
    return table.latest().drop("_version")


@query("for_each_writes", "SELECT n_name AS name, 1::BIGINT AS qty FROM nation WHERE n_regionkey = 2")
def _each(spark, d):
    e = engine(spark, d)
    e.register("audit", VersionedTable(spark, new_path(spark, "audit"), T.StructType([T.StructField("name", T.StringType()), T.StructField("qty", T.LongType())])))
    body = {"queries": {"w": {"insert_into": "audit", "values": [{"name": {"$param": "n"}, "qty": 1}]}}}
    e.batch({"queries": {"s": {"from": "nation", "where": eq("n_regionkey", 2), "select": fields("n_name")}, "each": {"over": {"$query": "@s", "path": "[].n_name"}, "bind_row": "n", "for_each": body}}})
    return e.read({"from": "audit", "select": fields("name", "qty")}).df


@query("foreign_key_cascade", "SELECT p_partkey::VARCHAR AS _id, p_name, p_size FROM part WHERE p_size NOT IN (SELECT p_size FROM part WHERE p_size < 15)")
def _cascade(spark, d):
    child = _parts(spark, d)
    sizes = VersionedTable(spark, new_path(spark, "sizes"), T.StructType([T.StructField("size", T.IntegerType())]))
    sizes.insert(child.latest().select(F.col("p_size").alias("size")).distinct().withColumn("_id", F.col("size").cast("string")), now_ms=1000)
    sizes.children.append(ForeignKey(child, "p_size", sizes, "size", "cascade"))
    sizes.delete(op("lt", "size", 15), now_ms=2000)
    return child.latest().drop("_version")


def _streamed(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """A stream over the events table, run over all that is there, with its result as a table."""
    rows, path, name = engine(spark, d).table("events").rows(), new_path(spark, "stream"), f"stream_{uuid.uuid4().hex}"
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{path}/in")
    stream = build(spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in"))
    running = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


@query("stream_windows", "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _windows(spark, d):
    from .streaming.subscribe import windowed_counts

    return _streamed(spark, d, lambda s: windowed_counts(s, "ts", ["event_type"], "1 hour"), "complete").select(F.unix_micros("start").alias("start"), "event_type", "n")


@query("stream_subscription", "SELECT user_id::VARCHAR AS key, event_id AS commit_version FROM events WHERE value >= 95 AND event_type <> 'purchase'")
def _stream_subscription(spark, d):
    from .streaming import subscribe

    def build(s):
        changes = s.select(F.lit("events").alias("table"), F.when(F.col("event_type") == "purchase", "delete").otherwise("put").alias("op"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("commit_version"), F.struct("value").alias("value"))
        return subscribe.matching(changes, {"subscribe": [{"table": "events", "filter": op("gte", "value", 95), "events": "put"}], "deliver": "keys"})

    return _streamed(spark, d, build, "append").select("key", "commit_version")


# -- what a read tells beside its rows


@query("with_version", "SELECT p_name, CASE WHEN p_size > 40 THEN 2 ELSE 1 END::BIGINT AS _version FROM part")
def _with_version(spark, d):
    e, table = Engine(spark), _parts(spark, d)
    e.register("parts", table)
    table.update(op("gt", "p_size", 40), {"p_size": 0}, now_ms=2000)
    return e.read({"from": "parts", "select": fields("p_name"), "with_version": True}).df


PAGE_SIZE = 30


@query("pagination_info", f"""
    WITH t AS (SELECT count(*) AS total, (count(*) + {PAGE_SIZE - 1}) // {PAGE_SIZE} AS pages FROM part WHERE p_size > 10)
    SELECT 'page' AS mode, total AS total_count, pages AS total_pages, 2::BIGINT AS current_page, {PAGE_SIZE}::BIGINT AS page_size, 2 < pages AS has_next, true AS has_prev FROM t
    UNION ALL SELECT 'offset', total, pages, 1, {PAGE_SIZE}, {PAGE_SIZE} < total, false FROM t
    UNION ALL SELECT 'uncounted', NULL, NULL, 3, {PAGE_SIZE}, false, true""")
def _pagination(spark, d):
    e = engine(spark, d)
    pages = {"page": ({"mode": "Page", "page": 2, "page_size": PAGE_SIZE}, True), "offset": ({"mode": "LimitOffset", "limit": PAGE_SIZE}, True), "uncounted": ({"mode": "LimitOffset", "limit": PAGE_SIZE, "offset": 2 * PAGE_SIZE}, False)}
    told = [(name, e.read({"from": "part", "where": op("gt", "p_size", 10), "order_by": ["p_size"], "pagination": page, "count_total": counted}).pagination) for name, (page, counted) in pages.items()]
    kinds = "mode string, total_count long, total_pages long, current_page long, page_size long, has_next boolean, has_prev boolean"
    return spark.createDataFrame([(name, *(info[c.split()[0]] for c in kinds.split(", ")[1:])) for name, info in told], kinds)


@query("explain_plans", """
    SELECT * FROM (VALUES ('all', 'FullScan', NULL), ('counted', 'CounterShortcut', NULL), ('least', 'MinMaxIndex', 'by_date'), ('status', 'IndexScan', 'by_status'), ('late', 'SortedIndexScan', 'by_date'),
    ('late_big', 'AndRangeIndexScan', 'by_date'), ('first', 'OrderLimitFast', 'by_date'), ('next', 'KeysetSeek', 'by_date'), ('unindexed', 'FullScan', NULL)) AS t(shape, plan_type, "index")""")
def _explained(spark, d):
    e = engine(spark, d)
    e.create_index("orders", "by_date", "sorted", ["o_orderdate"])
    e.create_index("orders", "by_status", "hash", ["o_orderstatus"])
    late = op("gt", "o_orderdate", "1996-01-01")
    shapes = {
        "all": {}, "counted": {"select": [{"type": "count_all"}]}, "least": {"select": [{"type": "aggregate", "func": "min", "field": ["o_orderdate"]}]}, "status": {"where": eq("o_orderstatus", "F")}, "late": {"where": late},
        "late_big": {"where": every(late, op("ne", "o_totalprice", 1))}, "first": {"order_by": ["o_orderdate"], "pagination": {"mode": "LimitOffset", "limit": 5}},
        "next": {"order_by": ["o_orderdate"], "pagination": {"mode": "After", "key": ["1996-01-01"], "limit": 5}}, "unindexed": {"where": op("lt", "o_totalprice", 5)},
    }
    plans = {name: e.read({"from": "orders", **spec, "explain": True}).plan for name, spec in shapes.items()}
    return spark.createDataFrame([(name, p["plan_type"], p["index"]) for name, p in plans.items()], "shape string, plan_type string, index string")


@query("cursor_pages", "SELECT i + 1 AS page, least(40, n - 40 * i) AS n_rows, i + 1 < (n + 39) // 40 AS more FROM (SELECT count(*) AS n FROM part WHERE p_size < 25) t, range(0, 1000) r(i) WHERE 40 * i < n")
def _cursor(spark, d):
    """The pages of a cursor; the last one may only be known as such when it is short."""
    e = engine(spark, d)
    key, page, _ = e.open_cursor({"from": "part", "where": op("lt", "p_size", 25), "select": fields("p_partkey")}, page_size=40)
    sizes = []
    while page:
        sizes.append(len(page))
        page = e.fetch(key)[0] if key in e.cursors else []
    return spark.createDataFrame([(i + 1, n, i + 1 < len(sizes)) for i, n in enumerate(sizes)], "page long, n_rows long, more boolean")


@query("described", """
    SELECT * FROM (VALUES ('n_name', 'string'), ('n_nationkey', 'int'), ('n_regionkey', 'int')) AS t("column", kind)""")
def _described(spark, d):
    e = engine(spark, d)
    e.register("lands", e.table("nation").rows(), id_col="n_nationkey")
    e.rename("lands", "states")
    return spark.createDataFrame(sorted(e.describe("states")["columns"].items()), "column string, kind string")


def _code(run: Callable) -> str | None:
    try:
        run()
    except QueryError as error:
        return error.code
    return None


@query("query_errors", """
    SELECT * FROM (VALUES ('two columns of one name', 'duplicate_name'), ('HAVING without GROUP BY', 'having_without_group'), ('no such table', 'unknown_table'), ('column outside the groups', 'not_grouped'),
    ('queries in a circle', 'cycle'), ('reference to no query', 'unknown_query'), ('too many queries', 'too_many_queries'), ('history of a plain table', 'no_history'), ('pages start at one', 'bad_page'),
    ('result over its limit', 'result_too_large'), ('no such procedure', 'unknown_function'), ('closed cursor', 'unknown_cursor'), ('impure index', 'not_pure')) AS t(what, code)""")
def _errors(spark, d):
    e = engine(spark, d)
    scan, batch = {"from": "nation"}, lambda queries, **more: lambda: e.batch({"queries": queries, **more})
    runs = {
        "two columns of one name": lambda: e.read({**scan, "select": fields("n_name", "n_name")}), "HAVING without GROUP BY": lambda: e.read({**scan, "group_by": {"fields": [], "having": op("gt", "n", 1)}}),
        "no such table": lambda: Engine(spark).read({"from": "nowhere"}),
        "column outside the groups": lambda: e.read({**scan, "group_by": {"fields": [["n_regionkey"]]}, "select": fields("n_name")}),
        "queries in a circle": batch({"a": {**scan, "after": ["b"]}, "b": {**scan, "after": ["a"]}}), "reference to no query": batch({"a": {**scan, "after": ["z"]}}), "too many queries": batch({"a": scan, "b": scan}, limits={"max_queries": 1}),
        "history of a plain table": lambda: e.read({**scan, "temporal": {"kind": "as_of", "at": {"version": 1}}}), "pages start at one": lambda: e.read({**scan, "pagination": {"mode": "Page", "page": 0, "page_size": 5}}),
        "result over its limit": batch({"a": scan}, limits={"max_result_size": 100}), "no such procedure": batch({"a": {"call": "nothing"}}), "closed cursor": lambda: e.fetch("gone"),
        "impure index": lambda: e.create_index("nation", "i", "functional", ["n_name"], scalar="gen/random"),
    }
    return spark.createDataFrame([(what, _code(run)) for what, run in runs.items()], "what string, code string")


# -- batches within batches, guards, procedures, user functions


@query("guard_skipped", "SELECT * FROM (VALUES ('counted', false), ('kept', false), ('left_out', true), ('fed_by_it', true)) AS t(entry, skipped)")
def _guards(spark, d):
    big = lambda n: {"op": "value_compare", "left": {"$query": "@counted", "path": ".count"}, "cmp": "gt", "right": n}
    nations = {"from": "nation", "select": fields("n_regionkey")}
    done = engine(spark, d).batch({"queries": {
        "counted": nations, "kept": {**nations, "when": big(5)}, "left_out": {**nations, "when": big(500)},
        "fed_by_it": {"from": "region", "where": {"op": "in", "field": ["r_regionkey"], "values": {"$query": "@left_out", "path": "[].n_regionkey"}}},
    }})
    return spark.createDataFrame([(name, r.skipped) for name, r in done["results"].items()], "entry string, skipped boolean")


@query("sub_batch", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3")
def _sub_batch(spark, d):
    inner = {"queries": {"own": {"from": "nation", "where": eq("n_regionkey", {"$param": "region"}), "select": fields("n_nationkey", "n_name")}}}
    done = engine(spark, d).batch({"queries": {"pick": {"from": "region", "where": eq("r_regionkey", 3)}, "sub": {"batch": inner, "bind": {"region": {"$query": "@pick", "path": "[0].r_regionkey"}}}}})
    return done["results"]["sub"].extra["value"]["own"].df


@query("procedure_call", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey >= 2 GROUP BY 1")
def _procedure(spark, d):
    e = engine(spark, d)
    e.register_procedure("sizes", lambda own, params: own.read({"from": "nation", "where": op("gte", "n_regionkey", params["least"]), "group_by": {"fields": [["n_regionkey"]]}, "select": {"items": ["n_regionkey", {"type": "count_all", "alias": "n"}]}}).df)
    return e.batch({"queries": {"c": {"call": "sizes", "params": {"least": 2}}}})["results"]["c"].extra["value"]


@query("user_functions", "SELECT l_returnflag, sum(l_quantity * l_quantity) AS squares FROM lineitem WHERE 2 * l_linenumber + 1 > 5 GROUP BY 1")
def _user_functions(spark, d):
    e = engine(spark, d)
    e.register_scalar("user/odd", lambda x: 2 * x + 1, 1)
    e.register_aggregate("squares", lambda c: F.sum(c * c))
    odd = {"op": "value_compare", "left": {"$fn": {"name": "user/odd", "args": [ref("l_linenumber")]}}, "cmp": "gt", "right": 5}
    return e.read({"from": "lineitem", "where": odd, "group_by": {"fields": [["l_returnflag"]]}, "select": {"items": ["l_returnflag", {"type": "aggregate_fn", "name": "squares", "field": ["l_quantity"], "alias": "squares"}]}}).df


@query("subscription_calls", "SELECT 'put' AS op, user_id::VARCHAR AS key, event_id AS commit_version FROM events WHERE event_type = 'purchase' AND value >= 250")
def _subscription_calls(spark, d):
    """A subscription that calls a procedure once per change row; the rows that it was called with."""
    from .streaming import subscribe

    e, called = engine(spark, d), []
    e.register_procedure("seen", lambda own, params: params["k"])
    rows = e.table("events").rows().where("event_type = 'purchase'")
    changes = rows.select(F.lit("events").alias("table"), F.lit("put").alias("op"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("commit_version"), F.struct("value").alias("value"))
    spec = {"subscribe": [{"table": "events", "filter": op("gte", "value", 250)}], "deliver": {"call": {"call": "seen", "params": {"k": {"$param": "$event.key"}}}}}
    deliver = subscribe.reacting(e, {"deliver": {"call": spec["deliver"]["call"]}}, lambda row, value: called.append((row["op"], value, row["commit_version"])))
    deliver(subscribe.matching(changes, spec).orderBy("commit_version"), 0)
    return spark.createDataFrame(called, "op string, key string, commit_version long")


@query("subscription_records", "SELECT event_id AS commit_version, CASE WHEN event_type <> 'purchase' THEN value END AS value FROM events WHERE event_type = 'purchase' OR value >= 90")
def _subscription_records(spark, d):
    from .streaming import subscribe

    rows = engine(spark, d).table("events").rows()
    changes = rows.select(F.lit("events").alias("table"), F.when(F.col("event_type") == "purchase", "delete").otherwise("put").alias("op"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("commit_version"), F.struct("value").alias("value"))
    return subscribe.matching(changes, {"subscribe": [{"table": "events", "filter": op("gte", "value", 90)}], "deliver": "records"}).select("commit_version", F.col("value.value").alias("value"))


# -- schemas on write, foreign keys


@query("schema_codes", r"""
    SELECT page_id, 'url' AS path, 'format' AS code FROM pages WHERE NOT regexp_matches(url, '^https?://')
    UNION ALL SELECT page_id, 'url', 'min_len' FROM pages WHERE length(url) < 40
    UNION ALL SELECT page_id, 'url', 'len' FROM pages WHERE length(url) <> 45
    UNION ALL SELECT page_id, 'page_id', 'max' FROM pages WHERE page_id > 20
    UNION ALL SELECT page_id, 'page_id', 'type' FROM pages
    UNION ALL SELECT page_id, 'absent', 'required' FROM pages
    UNION ALL SELECT page_id, 'short', 'nullable' FROM pages WHERE length(url) > 45
    UNION ALL SELECT page_id, 'below', 'unsigned' FROM pages WHERE page_id < 10
    UNION ALL SELECT page_id, 'marks', 'array_of' FROM pages""")
def _codes(spark, d):
    rows = engine(spark, d).table("pages").rows().select("page_id", "url", F.when(F.length("url") <= 45, F.col("url")).alias("short"), (F.col("page_id") - 10).alias("below"), F.array("page_id").alias("marks"))
    rules = [
        {"path": "url", "format": "url", "min_len": 40, "len": 45}, {"path": "page_id", "type": "string", "max": 20}, {"path": "absent", "required": True}, {"path": "short", "nullable": False}, {"path": "below", "unsigned": True},
        {"path": "marks", "array_of": "string"},
    ]
    return schema.violations(rows, rules, "page_id")


@query("schema_defaults", "SELECT n_nationkey::VARCHAR AS _id, n_name AS name, CASE WHEN n_regionkey = 1 THEN 'one' ELSE 'open' END AS state, 1000::BIGINT AS made, CASE WHEN n_regionkey = 1 THEN 2000 ELSE 1000 END::BIGINT AS changed FROM nation")
def _defaults(spark, d):
    kinds = T.StructType([T.StructField("name", T.StringType()), T.StructField("state", T.StringType()), T.StructField("made", T.LongType()), T.StructField("changed", T.LongType())])
    rules = [{"path": "state", "default": "open"}, {"path": "made", "auto_now_add": True}, {"path": "changed", "auto_now": True}]
    table = VersionedTable(spark, new_path(spark, "defaults"), kinds, rules)
    rows = engine(spark, d).table("nation").rows()
    table.insert(rows.select(F.col("n_nationkey").cast("string").alias("_id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("state")), now_ms=1000)
    ones = [f"{r['n_name']}" for r in rows.where("n_regionkey = 1").collect()]
    table.update({"op": "in", "field": ["name"], "values": ones}, {"state": "one"}, now_ms=2000)
    return table.latest().drop("_version")


def _keyed(spark: SparkSession, d: str, action: str) -> VersionedTable:
    """Parts that refer to a table of sizes, of which some are to be deleted."""
    child = _parts(spark, d)
    sizes = VersionedTable(spark, new_path(spark, "sizes"), T.StructType([T.StructField("size", T.IntegerType())]))
    sizes.insert(child.latest().select(F.col("p_size").alias("size")).distinct().withColumn("_id", F.col("size").cast("string")), now_ms=1000)
    sizes.children.append(ForeignKey(child, "p_size", sizes, "size", action))
    code = _code(lambda: sizes.delete(op("lt", "size", 15), now_ms=2000))
    if code not in (None, "foreign_key_restrict"):
        raise QueryError(code, action)
    return child


@query("foreign_key_restrict", PART_SQL)
def _restrict(spark, d):
    return _keyed(spark, d, "restrict").latest().drop("_version")


@query("foreign_key_set_null", "SELECT p_partkey::VARCHAR AS _id, p_name, CASE WHEN p_size >= 15 THEN p_size END AS p_size FROM part")
def _set_null(spark, d):
    return _keyed(spark, d, "set_null").latest().drop("_version")


# -- the functions and text operators of value expressions that the rows above leave out


@query("expr_texts", "SELECT o_orderkey, lower(o_orderpriority) AS l, upper(o_orderpriority) AS u, trim(' ' || o_orderstatus || ' ') AS t, length(o_orderpriority) AS n, o_totalprice = 1 OR NOT o_totalprice <= 200000 AS b FROM orders")
def _expr_texts(spark, d):
    rows = engine(spark, d).table("orders").rows()
    scope = Scope(rows)
    made = lambda e, name: value(e, scope).c.alias(name)
    price, priority = ref("o_totalprice"), ref("o_orderpriority")
    return rows.select(
        "o_orderkey", made(expr("lower", priority), "l"), made(expr("upper", priority), "u"), made(expr("trim", expr("concat", " ", ref("o_orderstatus"), " ")), "t"), made(expr("length", priority), "n"),
        made(expr("or", expr("eq", price, 1), expr("not", expr("lte", price, 200000))), "b"),
    )


@query("fn_array_sums", "SELECT vec_id, round(list_sum(v), 6) AS s, round(list_avg(v), 6) AS a, list_min(v) AS low, list_max(v) AS high, list_reverse_sort(v)[1:3] AS top FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def _array_sums(spark, d):
    e = engine(spark, d)
    e.register("vectors", e.table("embeddings").rows().select("vec_id", F.col("embedding").cast("array<double>").alias("v")), id_col="vec_id")
    v, fn = ref("v"), lambda name, *a: {"$fn": {"name": name, "args": list(a)}}
    items = [call("arrays/sum", v, alias="s"), call("arrays/avg", v, alias="a"), call("arrays/min", v, alias="low"), call("arrays/max", v, alias="high"), call("arrays/slice", fn("arrays/sort_desc", v), 0, 3, alias="top")]
    return e.read({"from": "vectors", "select": {"items": ["vec_id", *items]}}).df.withColumn("s", F.round("s", 6)).withColumn("a", F.round("a", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped orders with HAVING."""
    return engine(spark, sf_dir).read(FLAGSHIP).df
