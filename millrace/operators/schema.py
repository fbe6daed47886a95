"""Declarative schemas: rules per field path, checked on write as one pass of Boolean columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..functions.scalars import FORMATS, Val
from ..plans.compiler import Scope, compare, literal
from ..plans.errors import QueryError

#: The type tags of the rule language.
TYPES = ("null", "bool", "int", "f64", "dec", "big", "string", "bytes", "list", "set", "map", "any")
DATE = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])([Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2}))?$"
CODES = ("required", "nullable", "type", "unsigned", "min", "max", "len", "min_len", "max_len", "one_of", "array_of", "scalar", "format", "compare")


def format_check(name: str, c: Column) -> Column:
    """Whether a text has a named format: email, url, uuid or date."""
    kind = name.lower()
    if kind == "date":
        return c.rlike(scalars.regex(DATE)) & F.try_to_timestamp(F.substr(c, F.lit(1), F.lit(10)), F.lit("yyyy-MM-dd")).isNotNull()
    if kind not in ("email", "url", "uuid"):
        raise QueryError("unknown_format", name)
    return c.rlike(scalars.regex(FORMATS[kind]))


def _size(v: Val) -> Column:
    return F.char_length(v.c) if v.text else F.octet_length(v.c) if isinstance(v.t, T.BinaryType) else F.size(v.c) if isinstance(v.t, (T.ArrayType, T.MapType)) else F.lit(None).cast("int")


def _is(kind: str, v: Val) -> bool:
    own = scalars.type_name(v.t)
    return kind in ("any", own) or (kind, own) in (("set", "list"), ("big", "int"), ("big", "dec"), ("f64", "int"), ("dec", "f64"), ("dec", "int"), ("dec", "string"))


def rule_checks(rule: dict, scope: Scope) -> dict[str, Column]:
    """Per broken constraint of a rule the column that says so."""
    v = scope.path(rule["path"])
    out: dict[str, Column] = {}
    if v is None:
        return {"required": F.lit(True)} if rule.get("required") else {}
    given = v.c.isNotNull()

    def bad(code: str, ok: Column) -> None:
        out[code] = given & ~F.coalesce(ok, F.lit(False))

    if rule.get("required"):
        out["required"] = v.c.isNull()
    elif rule.get("nullable") is False:
        out["nullable"] = v.c.isNull()
    if rule.get("type"):
        if rule["type"] not in TYPES:
            raise QueryError("unknown_type", rule["type"])
        bad("type", F.lit(_is(rule["type"], v)))
    if rule.get("unsigned"):
        bad("unsigned", v.c >= 0 if v.numeric else F.lit(False))
    for code, op in (("min", "gte"), ("max", "lte")):
        if rule.get(code) is not None:
            bad(code, compare(op, v, literal(rule[code])))
    for code, ok in (("len", lambda n, x: n == x), ("min_len", lambda n, x: n >= x), ("max_len", lambda n, x: n <= x)):
        if rule.get(code) is not None:
            bad(code, ok(_size(v), rule[code]))
    if rule.get("one_of") is not None:
        bad("one_of", reduce(lambda a, b: a | b, (F.coalesce(compare("eq", v, literal(x)), F.lit(False)) for x in rule["one_of"]), F.lit(False)))
    if rule.get("array_of"):
        bad("array_of", F.lit(isinstance(v.t, T.ArrayType) and _is(rule["array_of"], Val(v.c, v.t.elementType))))
    if rule.get("scalar"):
        bad("scalar", scalars.call(rule["scalar"], [v]).cast("boolean"))
    if rule.get("format"):
        bad("format", format_check(rule["format"], v.c) if v.text else F.lit(False))
    if rule.get("compare"):
        other = scope.path(rule["compare"]["path"])
        bad("compare", compare(rule["compare"]["op"], v, other) if other else F.lit(False))
    return out


def with_defaults(df: DataFrame, rules: list[dict], now_ms: int, insert: bool = True) -> DataFrame:
    """Defaults for absent values, ``auto_now_add`` on insert and ``auto_now`` always."""
    for rule in rules:
        name = rule["path"] if isinstance(rule["path"], str) else rule["path"][0]
        own = F.col(f"`{name}`") if name in df.columns else None
        if rule.get("auto_now") or (rule.get("auto_now_add") and insert):
            df = df.withColumn(name, F.lit(now_ms).cast("bigint"))
        elif insert and "default" in rule:
            value = literal(rule["default"]).c
            df = df.withColumn(name, F.coalesce(own, value) if own is not None else value)
    return df


def violations(df: DataFrame, rules: list[dict], id_col: str = "_id") -> DataFrame:
    """(id, path, code): one row per broken constraint; the table is read once."""
    scope = Scope(df)
    found = []
    for rule in rules:
        path = rule["path"] if isinstance(rule["path"], str) else ".".join(rule["path"])
        for code, c in rule_checks(rule, scope).items():
            found.append(F.when(c, F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"))))
    every = F.array(*found) if found else F.array().cast("array<struct<path:string,code:string>>")
    return df.select(F.col(id_col), F.explode(F.filter(every, lambda x: x.isNotNull())).alias("v")).select(id_col, "v.path", "v.code")


def duplicates(df: DataFrame, path: str) -> DataFrame:
    """Values of a unique field that stand in several rows."""
    return df.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, path: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose foreign key has no parent; null keys have none to have."""
    return child.where(F.col(path).isNotNull()).join(parent.select(F.col(key).alias("__key")).distinct(), F.col(path) == F.col("__key"), "left_anti")


def on_parent_delete(child: DataFrame, path: str, deleted: DataFrame, key: str, action: str) -> tuple[DataFrame | None, DataFrame | None]:
    """What deleting parents does to a child table: (rows to delete, rows to write with a null key).

    ``restrict`` and ``no_action`` raise if a child row refers to a deleted parent.
    """
    hit = child.join(deleted.select(F.col(key).alias("__key")).distinct(), F.col(path) == F.col("__key"), "left_semi")
    if action in ("restrict", "no_action"):
        if not hit.isEmpty():
            raise QueryError("foreign_key_restrict", path)
        return None, None
    if action == "cascade":
        return hit, None
    if action == "set_null":
        return None, hit.withColumn(path, F.lit(None).cast(child.schema[path].dataType))
    raise QueryError("unknown_action", action)
