"""Filters and value expressions to columns.

Filters are two-valued: a comparison with null or between types is false, so
under a negation, and where a filter's value is seen, each leaf is closed with
``coalesce(..., false)``. At the top and under and/or a leaf stays bare, so
that it can be pushed down to Parquet; a null there drops the row as false does.
"""

from __future__ import annotations

import re
import datetime as dt
import decimal
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..functions.scalars import MISSING, Val
from .errors import QueryError

MAX_DEPTH = 64
FALSE = F.lit


def family(t: T.DataType) -> str:
    """Types that compare with each other."""
    for kind, name in ((T.NullType, "null"), (T.BooleanType, "bool"), (T.NumericType, "number"), (T.StringType, "text"), (T.BinaryType, "bytes"), (T.DateType, "time"), (T.TimestampType, "time"), (T.TimestampNTZType, "time"), (T.ArrayType, "list")):
        if isinstance(t, kind):
            return name
    return "map"


def literal(v) -> Val:
    """A Python value as a column."""
    if isinstance(v, (list, tuple)):
        parts = [literal(x) for x in v]
        c = F.array(*(p.c for p in parts)) if parts else F.array().cast("array<string>")
        kinds = {p.t for p in parts if not isinstance(p.t, T.NullType)}
        return Val(c, T.ArrayType(kinds.pop() if kinds else T.StringType()), list(v))
    if isinstance(v, dict):
        parts = {k: literal(x) for k, x in v.items()}
        return Val(F.struct(*(p.c.alias(k) for k, p in parts.items())), T.StructType([T.StructField(k, p.t) for k, p in parts.items()]), v)
    if isinstance(v, bool):
        kind: T.DataType = T.BooleanType()
    elif isinstance(v, int):
        if not -(1 << 63) <= v < 1 << 63:
            return Val(F.lit(decimal.Decimal(v)), T.DecimalType(38, 0), v)
        return Val(F.lit(v).cast("bigint"), T.LongType(), v)
    else:
        kind = T.NullType() if v is None else T.DoubleType() if isinstance(v, float) else T.StringType() if isinstance(v, str) else T.BinaryType() if isinstance(v, (bytes, bytearray)) else T.DecimalType(38, 18) if isinstance(v, decimal.Decimal) else T.DateType() if type(v) is dt.date else T.TimestampType()
    return Val(F.lit(bytes(v) if isinstance(v, bytearray) else v), kind, v)


@dataclass
class Membership:
    """A semi or anti join that a filter asks for."""

    column: Column
    values: DataFrame
    negated: bool


@dataclass
class Scope:
    """What names mean: a frame's columns, parameters and the results of other queries."""

    df: DataFrame | None
    params: dict = field(default_factory=dict)
    lookup: Callable | None = None  # (alias, path) -> ("value", x) or ("column", frame, type)
    joins: list[Membership] = field(default_factory=list)
    marks: list[tuple[str, Membership]] = field(default_factory=list)

    def path(self, path) -> Val | None:
        """A field, None if the frame cannot have it."""
        if self.df is None:
            return None
        keys = [path] if isinstance(path, str) else list(path)
        found = next((f for f in self.df.schema.fields if f.name == keys[0]), None)
        if found is None:
            return None
        v: Val | None = Val(F.col("`" + keys[0].replace("`", "``") + "`"), found.dataType)
        for key in keys[1:]:
            v = scalars.step(v, key) if v else None
        return v

    def typed(self, c: Column) -> Val:
        """A column with its type; columns without fields are asked of any frame."""
        frame = self.df if self.df is not None else _one_row()
        return Val(c, frame.select(c.alias("x")).schema["x"].dataType)


def _one_row() -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().range(1)


EXPRESSIONS: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: F.try_add(a, b), "sub": lambda a, b: F.try_subtract(a, b), "mul": lambda a, b: F.try_multiply(a, b),
    "div": lambda a, b: F.try_divide(a, b), "mod": lambda a, b: F.try_mod(a, b), "neg": lambda a: F.try_subtract(F.lit(0), a),
}
COMPARISONS = ("eq", "ne", "gt", "gte", "lt", "lte")


def value(v, scope: Scope) -> Val:
    """A value expression: a literal, a list or one of the ``$`` forms."""
    if isinstance(v, dict):
        if "$ref" in v:
            return scope.path(v["$ref"]) or literal(None)
        if "$param" in v:
            if v["$param"] not in scope.params:
                raise QueryError("unknown_param", v["$param"])
            return literal(scope.params[v["$param"]])
        if "$fn" in v:
            call = v["$fn"] if isinstance(v["$fn"], dict) else {"name": v["$fn"]}
            return scope.typed(scalars.call(call["name"], [value(a, scope) for a in call.get("args", [])]))
        if "$expr" in v:
            return expression(v["$expr"], scope)
        if "$cond" in v:
            cond = v["$cond"]
            a, b = value(cond["then"], scope), value(cond["else"], scope)
            if family(a.t) != family(b.t) and "null" not in (family(a.t), family(b.t)):
                raise QueryError("mixed_types", "both branches of $cond need one type")
            return scope.typed(F.when(predicate(cond["if"], scope, seen=True), a.c).otherwise(b.c))
        if "$query" in v:
            found = scope.lookup(v["$query"], v.get("path")) if scope.lookup else None
            if found is None:
                raise QueryError("unknown_query", v["$query"])
            if found[0] == "column":
                raise QueryError("column_reference", "a query's column can stand in in/not_in only")
            return literal(found[1])
    if isinstance(v, list) and any(isinstance(x, dict) for x in v):
        return scope.typed(F.array(*(value(x, scope).c for x in v)))
    return literal(v)


def expression(e: dict, scope: Scope) -> Val:
    """An operator with arguments; wrong types, overflow and division by zero give null."""
    op, args = e["op"], [value(a, scope) for a in e["args"]]
    if op in EXPRESSIONS:
        if not all(a.numeric for a in args):
            return Val(scalars.null("double"), T.DoubleType())
        out = args[0].c
        if len(args) == 1:
            return scope.typed(EXPRESSIONS[op](out))
        for a in args[1:]:
            out = EXPRESSIONS[op](out, a.c)
        return scope.typed(out)
    if op in ("concat", "lower", "upper", "trim", "length"):
        return scope.typed(scalars.call(f"strings/{op}", args))
    if op in ("and", "or", "not"):
        bits = [a.c if isinstance(a.t, T.BooleanType) else scalars.null("boolean") for a in args]
        out = ~bits[0] if op == "not" else bits[0]
        for b in bits[1:]:
            out = out & b if op == "and" else out | b
        return Val(out, T.BooleanType())
    if op in COMPARISONS:
        return Val(F.coalesce(compare(op, args[0], args[1]), F.lit(False)), T.BooleanType())
    raise QueryError("unknown_operator", op)


def _not_nan(v: Val, c: Column) -> Column:
    return c & ~F.isnan(v.c) if isinstance(v.t, (T.DoubleType, T.FloatType)) and v.lit is MISSING else c


def _whole_with_double(op: str, a: Val, x: float) -> Column:
    """An integer column against a double literal, exactly."""
    if math.isnan(x):
        return F.lit(False)
    low = math.floor(x) if math.isfinite(x) else None
    if low is None or not -(1 << 63) <= low < 1 << 63:
        above = x > 0
        return a.c.isNotNull() & F.lit({"gt": not above, "gte": not above, "lt": above, "lte": above}.get(op, False))
    even = low == x
    near = F.lit(low).cast(a.t) if -(1 << 31) <= low < 1 << 31 or isinstance(a.t, T.LongType) else F.lit(low).cast("bigint")
    return {"eq": a.c == near if even else F.lit(False), "gt": a.c > near, "gte": a.c >= near if even else a.c > near, "lt": a.c < near if even else a.c <= near, "lte": a.c <= near}[op]


def _whole_with_doubles(op: str, a: Val, d: Val) -> Column:
    """An integer column against a double column, exactly."""
    low = F.floor(d.c.cast("double")).try_cast("bigint")
    same = (a.c == low) & (d.c == F.floor(d.c))
    inside = {"eq": same, "gt": a.c > low, "gte": (a.c > low) | same, "lt": (a.c < low) | ((a.c == low) & ~(d.c == F.floor(d.c))), "lte": a.c <= low}[op]
    above = d.c >= 2.0**63
    far = above if op in ("lt", "lte") else d.c < -(2.0**63) if op in ("gt", "gte") else F.lit(False)
    return F.when(F.isnan(d.c), F.lit(False)).when(above | (d.c < -(2.0**63)), far).otherwise(inside)


_SWAP = {"eq": "eq", "ne": "ne", "gt": "lt", "gte": "lte", "lt": "gt", "lte": "gte"}


def compare(op: str, a: Val, b: Val) -> Column:
    """A typed comparison; null compares equal to null only, other mismatches have no order. May be null for false."""
    if op == "ne":
        return ~F.coalesce(compare("eq", a, b), F.lit(False))
    if "null" in (family(a.t), family(b.t)):
        other = b if family(a.t) == "null" else a
        return other.c.isNull() if op in ("eq", "gte", "lte") else F.lit(False)
    if family(a.t) == "time" and family(b.t) in ("number", "text"):
        b = Val(F.timestamp_millis(b.c.cast("bigint")), T.TimestampType(), b.lit) if family(b.t) == "number" else Val(F.try_to_timestamp(b.c), T.TimestampType(), b.lit)
        a = Val(a.c.cast("timestamp"), T.TimestampType(), a.lit) if not isinstance(a.t, T.TimestampNTZType) else a
        b = Val(b.c.cast("timestamp_ntz"), a.t, b.lit) if isinstance(a.t, T.TimestampNTZType) else b
    elif family(b.t) == "time" and family(a.t) in ("number", "text"):
        return compare(_SWAP[op], b, a)
    if family(a.t) != family(b.t) or family(a.t) == "map" or (family(a.t) == "list" and op != "eq"):
        return F.lit(False)
    whole_a, whole_b = isinstance(a.t, T.IntegralType), isinstance(b.t, T.IntegralType)
    real_a, real_b = isinstance(a.t, (T.DoubleType, T.FloatType)), isinstance(b.t, (T.DoubleType, T.FloatType))
    if whole_a and real_b:
        return _whole_with_double(op, a, b.lit) if isinstance(b.lit, float) else _whole_with_doubles(op, a, b)
    if real_a and whole_b:
        if b.lit is not MISSING and float(b.lit) == b.lit:
            b = Val(F.lit(float(b.lit)), T.DoubleType(), float(b.lit))
        else:
            return compare(_SWAP[op], b, a)
    for x in (a, b):
        if isinstance(x.lit, float) and math.isnan(x.lit):
            return F.lit(False)
    if op == "eq":
        out = a.c == b.c if MISSING is not a.lit or MISSING is not b.lit else a.c.eqNullSafe(b.c)
    else:
        out = {"gt": a.c > b.c, "gte": a.c >= b.c, "lt": a.c < b.c, "lte": a.c <= b.c}[op]
        if op in ("gte", "lte") and a.lit is MISSING and b.lit is MISSING:
            out = F.coalesce(out, a.c.isNull() & b.c.isNull())
    return _not_nan(b, _not_nan(a, out)) if op != "lt" or b.lit is MISSING else out


def like_pattern(pattern: str, ignore_case: bool) -> str:
    """A LIKE pattern as a regular expression: no escape character, and ``_`` and ``%`` stop at a line's end."""
    body = "".join(".*" if c == "%" else "." if c == "_" else c if c.isalnum() or c.isspace() or ord(c) > 127 else "\\" + c for c in pattern)
    return f"(?d{'iu' if ignore_case else ''})\\A{body}\\z"


def _field(f: dict, scope: Scope) -> Val | None:
    return scope.path(f["field"])


def _query_column(values: list, scope: Scope):
    """The frame of a column reference, if ``values`` is one."""
    if len(values) == 1 and isinstance(values[0], dict) and "$query" in values[0] and scope.lookup:
        found = scope.lookup(values[0]["$query"], values[0].get("path"))
        if found and found[0] == "column":
            return found[1]
        if found and found[0] == "value" and isinstance(found[1], list):
            return found[1]
    return None


def _isin(v: Val, values: list, scope: Scope) -> Column:
    """Membership in literals and expressions; plain literals of the column's own type become one IN."""
    plain, other = [], []
    for x in values:
        w = value(x, scope)
        (plain if w.lit is not MISSING and w.lit is not None and type(w.lit) in (int, str) and family(w.t) == family(v.t) and not isinstance(v.t, (T.DoubleType, T.FloatType, T.TimestampType, T.TimestampNTZType)) else other).append(w)
    out = v.c.isin([w.lit for w in plain]) if plain else None
    for w in other:
        c = F.coalesce(compare("eq", v, w), F.lit(False)) if w.lit is None else compare("eq", v, w)
        out = c if out is None else out | c
    return F.lit(False) if out is None else out


def predicate(f: dict, scope: Scope, seen: bool = False, top: bool = False, depth: int = 1) -> Column:
    """A filter's column. ``seen``: its value matters beyond true or not. ``top``: it is a conjunct of the whole."""
    if depth > MAX_DEPTH:
        raise QueryError("filter_too_deep", str(MAX_DEPTH))
    op = f["op"]
    if op in ("and", "or"):
        parts = [predicate(x, scope, seen, top and op == "and", depth + 1) for x in f["filters"]]
        if not parts:
            return F.lit(op == "and")
        out = parts[0]
        for p in parts[1:]:
            out = out & p if op == "and" else out | p
        return out
    if op == "not":
        return ~predicate(f["filter"], scope, True, False, depth + 1)
    out = _leaf(op, f, scope, top)
    return F.coalesce(out, F.lit(False)) if seen else out


def _leaf(op: str, f: dict, scope: Scope, top: bool) -> Column:
    if op == "value_compare":
        return compare(f["cmp"], value(f["left"], scope), value(f["right"], scope))
    v = _field(f, scope)
    if op in ("is_null", "not_exists"):
        return F.lit(True) if v is None else v.c.isNull() if op == "is_null" else _absent(f, scope)
    if op == "is_not_null":
        return F.lit(False) if v is None else v.c.isNotNull()
    if op == "exists":
        return F.lit(False) if v is None else ~_absent(f, scope)
    if op == "vector_similarity":
        return F.lit(True)  # ranking is the read's business; as a condition it holds for every row
    if v is None:
        return F.lit(op == "not_in")
    if op in (*COMPARISONS, "field"):
        return compare("eq" if op == "field" else op, v, value(f["value"], scope))
    if op in ("like", "i_like", "ilike"):
        if not v.text:
            return F.lit(False)
        whole, start = v.c.rlike(like_pattern(f["pattern"], op != "like")), re.match("[^%_]*", f["pattern"]).group(0)
        return v.c.startswith(start) & whole if start and op == "like" else whole  # a fixed start reaches the scan
    if op == "regex":
        java = scalars.regex(f["pattern"])
        return v.c.rlike(java) if v.text and java else F.lit(False)
    if op in ("in", "not_in"):
        return _membership(op, f["values"], v, scope, top)
    if op == "contains":
        return F.array_contains(v.c, value(f["value"], scope).c) if isinstance(v.t, T.ArrayType) and value(f["value"], scope).lit is not None else F.lit(False)
    if op in ("contains_any", "contains_all"):
        if not isinstance(v.t, T.ArrayType):
            return F.lit(False)
        hits = [F.coalesce(F.array_contains(v.c, value(x, scope).c), F.lit(False)) for x in f["values"]]
        out = F.lit(op == "contains_all")
        for h in hits:
            out = out & h if op == "contains_all" else out | h
        return out & v.c.isNotNull()
    if op == "between":
        return compare("gte", v, value(f["from"], scope)) & compare("lte", v, value(f["to"], scope))
    if op == "fts":
        from ..operators.fts import matches

        return matches(v, f["query"], f.get("mode", "and"))
    if op == "computed":
        return compare(f["cmp"], computed(f["expr_op"], v, scope, f.get("expr_args")), value(f["value"], scope))
    raise QueryError("unknown_filter", op)


def _absent(f: dict, scope: Scope) -> Column:
    """A field is absent where a map or variant on its path has no such key; a column is never absent."""
    keys = [f["field"]] if isinstance(f["field"], str) else list(f["field"])
    parent = scope.path(keys[:-1]) if len(keys) > 1 else None
    if parent is not None and isinstance(parent.t, T.MapType):
        return ~F.coalesce(F.map_contains_key(parent.c, F.lit(keys[-1])), F.lit(False))
    if parent is not None and isinstance(parent.t, (T.VariantType, T.StructType)):
        return scope.path(keys).c.isNull() if isinstance(parent.t, T.VariantType) else parent.c.isNull()
    return F.lit(False)


def computed(op: str, v: Val, scope: Scope, args: list | None = None) -> Val:
    """A functional-index expression of a field; ``length`` counts bytes."""
    if op == "field":
        return v
    given = [value(a, scope) for a in args or []]
    if op == "nested_path":
        return scope.typed(scalars.get_path(v, literal([a.lit for a in given])))
    if op in ("substring", "concat", "mod", "coalesce"):
        folder = {"mod": "math", "coalesce": "null"}.get(op, "strings")
        return scope.typed(scalars.call(f"{folder}/{op}", [v, *given]))
    if op == "length":
        return Val(F.octet_length(v.c).cast("bigint"), T.LongType()) if v.text else literal(None)
    if op in ("lower", "upper", "trim"):
        return Val(scalars.call(f"strings/{op}", [v]), T.StringType())
    return scope.typed(scalars.call(op, [v, *given]))


def _membership(op: str, values: list, v: Val, scope: Scope, top: bool) -> Column:
    negated, found = op == "not_in", _query_column(values, scope)
    if isinstance(found, list):
        values, found = found, None
    if found is None:
        out = _isin(v, values, scope)
        return ~F.coalesce(out, F.lit(False)) if negated else out
    member = Membership(v.c, found, negated)
    if top:
        scope.joins.append(member)
        return F.lit(True)
    mark = f"__member_{len(scope.marks)}"
    scope.marks.append((mark, member))
    hit = F.coalesce(F.col(mark), F.lit(False))
    return ~hit if negated else hit


def where(df: DataFrame, f: dict | None, scope: Scope) -> DataFrame:
    """The rows of ``df`` that satisfy a filter; references to other queries' columns become semi and anti joins."""
    if f is None:
        return df
    scope.df, scope.joins, scope.marks = df, [], []
    condition = predicate(f, scope, top=True)
    columns = df.columns
    for i, member in enumerate(scope.joins):
        df = df.join(_values(member, f"__in_{i}"), member.column == F.col(f"__in_{i}"), "left_anti" if member.negated else "left_semi")
    for mark, member in scope.marks:
        marked = _values(member, f"{mark}_v").withColumn(mark, F.lit(True))
        df = df.join(marked, member.column == F.col(f"{mark}_v"), "left")
    df = df.filter(condition)
    return df.select(*(F.col(f"`{c}`") for c in columns)) if scope.marks else df


def _values(member: Membership, name: str) -> DataFrame:
    return member.values.select(F.col(f"`{member.values.columns[0]}`").alias(name)).where(F.col(name).isNotNull()).distinct()
