"""The scalar function library: folder-qualified names to column expressions.

A function gets its arguments as ``Val`` (column, type and, for literals, the
value). A null argument, a wrong type or any other error gives null: nothing
here raises at run time. Whole numbers stay BIGINT where the result is whole;
roots, powers and logarithms are DOUBLE; everything stays in the JVM but for
the functions of ``udfs``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import QueryError
from . import udfs

MISSING = object()


@dataclass
class Val:
    """A compiled value."""

    c: Column
    t: T.DataType
    lit: object = MISSING
    name: str = ""

    @property
    def numeric(self) -> bool:
        return isinstance(self.t, T.NumericType)

    @property
    def text(self) -> bool:
        return isinstance(self.t, T.StringType)


@dataclass(frozen=True)
class Fn:
    """A library function: least and most arguments (None: any number), and its builder."""

    low: int
    high: int | None
    build: Callable[..., Column]
    pure: bool = True


REGISTRY: dict[str, Fn] = {}
LONG, DOUBLE, TEXT, BOOL = "bigint", "double", "string", "boolean"


def scalar(name: str, low: int, high: int | None = -1, pure: bool = True):
    """Register a builder under ``name``; ``high`` is ``low`` unless given."""

    def wrap(fn):
        REGISTRY[name] = Fn(low, low if high == -1 else high, fn, pure)
        return fn

    return wrap


def call(name: str, args: list[Val]) -> Column:
    """The column of a function call; unknown names and wrong numbers of arguments are errors of the query."""
    fn = REGISTRY.get(name)
    if fn is None:
        raise QueryError("unknown_function", name)
    if len(args) < fn.low or (fn.high is not None and len(args) > fn.high):
        raise QueryError("wrong_arity", name)
    return fn.build(*args)


def null(kind: str = TEXT) -> Column:
    """A typed null."""
    return F.lit(None).cast(kind)


def num(v: Val) -> Column:
    """A number, else null: Booleans count as 0 and 1, texts do not count."""
    if v.numeric:
        return v.c
    return v.c.cast("int") if isinstance(v.t, T.BooleanType) else null(DOUBLE)


def text(v: Val) -> Column:
    """A text, else null."""
    return v.c if v.text else null()


def data(v: Val) -> Column:
    """Bytes, else null."""
    return v.c if isinstance(v.t, T.BinaryType) else null("binary")


def raw(v: Val) -> Column:
    """Bytes, or a text's UTF-8."""
    return v.c.cast("binary") if v.text else data(v)


def whole(v: Val) -> Column:
    """An integer, also from an integral decimal or double; else null."""
    if isinstance(v.t, T.IntegralType):
        return v.c.cast(LONG)
    c = num(v)
    return F.when(c == F.floor(c), c.try_cast(LONG))


def items(v: Val) -> Column:
    """A list, else null."""
    return v.c if isinstance(v.t, T.ArrayType) else null("array<string>")


def finite(c: Column) -> Column:
    """A double, null where it is infinite or not a number."""
    c = c.cast(DOUBLE)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def constant(v: Val, code: str) -> object:
    """A literal argument's value."""
    if v.lit is MISSING:
        raise QueryError(code, "a literal argument is needed")
    return v.lit


def all_given(args, c: Column) -> Column:
    """``c``, null where an argument is null."""
    out = c
    for a in args:
        out = F.when(a.c.isNotNull(), out)
    return out


# math

for _name, _fn in {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "neg": lambda c: F.try_subtract(F.lit(0), c), "trunc": lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)), "sign": lambda c: F.signum(c).cast(LONG)}.items():
    scalar(f"math/{_name}", 1)(lambda a, f=_fn: f(num(a)))


@scalar("math/round", 1, 2)
def _round(a, places=None):
    if places is None:
        return F.round(num(a))
    n = constant(places, "bad_places")
    if not isinstance(n, int) or not 0 <= n <= 28:
        return null(DOUBLE)
    return F.round(num(a), n)


scalar("math/pow", 2)(lambda a, b: finite(F.pow(num(a), num(b))))
scalar("math/sqrt", 1)(lambda a: F.when(num(a) >= 0, F.sqrt(num(a))))
scalar("math/exp", 1)(lambda a: finite(F.exp(num(a))))
scalar("math/ln", 1)(lambda a: F.when(num(a) > 0, F.ln(num(a))))


@scalar("math/log", 1, 2)
def _log(a, base=None):
    x = num(a)
    if base is None:
        return F.when(x > 0, F.log10(x))
    b = num(base)
    return F.when((x > 0) & (b > 0) & (b != 1), finite(F.ln(x) / F.ln(b)))


scalar("math/mod", 2)(lambda a, b: F.try_mod(num(a), num(b)))
scalar("math/clamp", 3)(lambda a, lo, hi: all_given((a, lo, hi), F.when(lo.c <= hi.c, F.least(F.greatest(a.c, lo.c), hi.c))))
scalar("math/min", 1, None)(lambda *a: all_given(a, F.least(*(x.c for x in a)) if len(a) > 1 else a[0].c))
scalar("math/max", 1, None)(lambda *a: F.greatest(*(x.c for x in a)) if len(a) > 1 else a[0].c)
scalar("math/between", 3)(lambda a, lo, hi: F.when(lo.c <= hi.c, (a.c >= lo.c) & (a.c <= hi.c)))

# null

scalar("null/coalesce", 1, None)(lambda *a: F.coalesce(*(x.c for x in a)))
scalar("null/if_null", 2)(lambda a, b: F.coalesce(a.c, b.c))
scalar("null/nullif", 2)(lambda a, b: F.when(~a.c.eqNullSafe(b.c), a.c))
scalar("null/is_null", 1)(lambda a: a.c.isNull())

# strings

_STRIP = r"(?U)\s+"
for _name, _fn in {
    "lower": F.lower, "upper": F.upper, "trim": lambda c: F.regexp_replace(c, rf"\A{_STRIP}|{_STRIP}\z", ""), "ltrim": lambda c: F.regexp_replace(c, rf"\A{_STRIP}", ""),
    "rtrim": lambda c: F.regexp_replace(c, rf"{_STRIP}\z", ""), "length": lambda c: F.char_length(c).cast(LONG), "byte_length": lambda c: F.octet_length(c).cast(LONG), "reverse": F.reverse,
}.items():
    scalar(f"strings/{_name}", 1)(lambda a, f=_fn: f(text(a)))


@scalar("strings/substring", 3)
def _substring(a, start, size):
    s, n = whole(start), whole(size)
    return F.when((s >= 0) & (n >= 0), F.substr(text(a), (s + 1).cast("int"), n.cast("int")))


scalar("strings/concat", 1, None)(lambda *a: F.concat(*map(text, a)))
scalar("strings/replace", 3)(lambda a, b, c: F.when(F.char_length(text(b)) > 0, F.replace(text(a), text(b), text(c))).otherwise(F.when(text(b).isNotNull() & text(c).isNotNull(), F.concat(text(c), F.array_join(F.transform(F.split(text(a), ""), lambda x: F.concat(x, text(c))), "")))))


def _literal(separator: Column) -> Column:
    """A pattern that matches a text as it is."""
    return F.concat(F.lit("\\Q"), F.replace(separator, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


scalar("strings/split", 2)(lambda a, b: F.when(F.char_length(text(b)) > 0, F.split(text(a), _literal(text(b)), -1)))
scalar("strings/starts_with", 2)(lambda a, b: F.startswith(text(a), text(b)))
scalar("strings/ends_with", 2)(lambda a, b: F.endswith(text(a), text(b)))
scalar("strings/contains", 2)(lambda a, b: F.contains(text(a), text(b)))
scalar("strings/index_of", 2)(lambda a, b: F.position(text(b), text(a)).cast(LONG) - 1)
scalar("strings/repeat", 2)(lambda a, n: F.when(whole(n) >= 0, F.repeat(text(a), whole(n).cast("int"))))


def _pad(left: bool):
    def build(a, width, fill):
        c, n, f = text(a), whole(width), text(fill)
        padded = (F.lpad if left else F.rpad)(c, n.cast("int"), f)
        return F.when(F.char_length(f) == 1, F.when(F.char_length(c) >= n, c).otherwise(padded))

    return build


scalar("strings/pad_left", 3)(_pad(True))
scalar("strings/pad_right", 3)(_pad(False))


def regex(pattern: str) -> str | None:
    """A search pattern of the query language for Java, None if it is not valid there.

    Lines end with LF alone, ``$`` is the end of the text, and look-around and
    back references, which the language does not have, are refused.
    """
    if re.search(r"\(\?(?:[=!>]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        return None
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        in_class = (in_class or c == "[") and c != "]"
        multi = pattern.startswith("(?m)")
        out.append("\\z" if c == "$" and not in_class and not multi else c)
        i += 1
    java = "(?d)" + "".join(out)
    try:
        re.compile(re.sub(r"\(\?<(\w)", r"(?P<\1", pattern).replace(r"\z", r"\Z").replace(r"\p{", r"[{"))
    except re.error:
        return None
    return java


def _regex_fn(build: Callable[..., Column], kind: str):
    def made(a, pattern, *more):
        p = constant(pattern, "bad_pattern")
        java = regex(p) if isinstance(p, str) else None
        return null(kind) if java is None else build(text(a), java, *more)

    return made


scalar("strings/is_reg_match", 2)(_regex_fn(lambda c, p: c.rlike(p), BOOL))
scalar("strings/reg_query", 2)(_regex_fn(lambda c, p: F.regexp_substr(c, F.lit(p)), TEXT))
scalar("strings/reg_query_all", 2)(_regex_fn(lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0)), "array<string>"))


def _captures(c, p):
    groups = re.compile(re.sub(r"\(\?<(\w)", r"(?P<\1", p.replace("(?d)", "").replace("\\z", "\\Z"))).groups
    return F.when(c.rlike(p), F.array(*(F.regexp_extract(c, p, i) for i in range(groups + 1))))


scalar("strings/reg_captures", 2)(_regex_fn(_captures, "array<string>"))
scalar("strings/reg_replace", 3)(_regex_fn(lambda c, p, to: F.regexp_replace(c, F.lit(p), text(to)), TEXT))
scalar("strings/reg_split", 2)(_regex_fn(lambda c, p: F.split(c, p, -1), "array<string>"))
scalar("strings/reg_count", 2)(_regex_fn(lambda c, p: F.regexp_count(c, F.lit(p)).cast(LONG), LONG))
scalar("strings/reg_find_index", 2)(_regex_fn(lambda c, p: F.regexp_instr(c, F.lit(p)).cast(LONG) - 1, LONG))

# arrays

scalar("arrays/length", 1)(lambda a: F.array_size(items(a)).cast(LONG))
scalar("arrays/get", 2)(lambda a, i: F.get(items(a), whole(i).cast("int")))
scalar("arrays/slice", 3)(lambda a, s, n: F.when((whole(s) >= 0) & (whole(n) >= 0), F.slice(items(a), (whole(s) + 1).cast("int"), whole(n).cast("int"))))
scalar("arrays/contains", 2)(lambda a, v: F.coalesce(F.array_contains(items(a), v.c), F.when(items(a).isNotNull(), F.lit(False))))
scalar("arrays/index_of", 2)(lambda a, v: F.array_position(items(a), v.c) - 1)
scalar("arrays/first", 1)(lambda a: F.get(items(a), 0))
scalar("arrays/last", 1)(lambda a: F.get(items(a), F.size(items(a)) - 1))
scalar("arrays/flatten", 1)(lambda a: F.flatten(a.c) if isinstance(a.t, T.ArrayType) and isinstance(a.t.elementType, T.ArrayType) else null("array<string>"))
scalar("arrays/distinct", 1)(lambda a: F.array_distinct(items(a)))
scalar("arrays/sort", 1)(lambda a: F.sort_array(items(a)))
scalar("arrays/sort_desc", 1)(lambda a: F.sort_array(items(a), asc=False))
scalar("arrays/join", 2)(lambda a, b: F.when(~F.exists(items(a), lambda x: x.isNull()), F.call_function("array_join", a.c, text(b))) if isinstance(a.t, T.ArrayType) and isinstance(a.t.elementType, T.StringType) else null())


def _numbers(a) -> bool:
    return isinstance(a.t, T.ArrayType) and isinstance(a.t.elementType, T.NumericType)


def _total(a) -> Column:
    kind = LONG if isinstance(a.t.elementType, T.IntegralType) else a.t.elementType.simpleString() if isinstance(a.t.elementType, T.DecimalType) else DOUBLE
    kind = "decimal(38,10)" if kind.startswith("decimal") else kind
    return F.when(F.size(a.c) > 0, F.aggregate(a.c, F.lit(0).cast(kind), lambda s, x: F.try_add(s, x).cast(kind)))


scalar("arrays/sum", 1)(lambda a: _total(a) if _numbers(a) else null(DOUBLE))
scalar("arrays/avg", 1)(lambda a: F.try_divide(_total(a), F.size(a.c)) if _numbers(a) else null(DOUBLE))
scalar("arrays/min", 1)(lambda a: F.when(~F.exists(items(a), lambda x: x.isNull()), F.array_min(items(a))))
scalar("arrays/max", 1)(lambda a: F.array_max(items(a)))

# cast


def to_int(a) -> Column:
    if a.text:
        return F.when(a.c.rlike(r"\A[+-]?[0-9]+\z"), a.c.try_cast(LONG))
    return a.c.cast(LONG) if isinstance(a.t, T.BooleanType) else whole(a)


def to_dec(a) -> Column:
    if a.text:
        return F.when(a.c.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z"), a.c.try_cast("decimal(38,18)"))
    return a.c.cast("int").cast("decimal(38,18)") if isinstance(a.t, T.BooleanType) else a.c.try_cast("decimal(38,18)") if a.numeric else null("decimal(38,18)")


def to_text(a) -> Column:
    return F.coalesce(a.c.cast(TEXT), F.lit("null"))


def to_bool(a) -> Column:
    if a.text:
        low = F.lower(a.c)
        return F.when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False))
    return a.c if isinstance(a.t, T.BooleanType) else a.c != 0 if a.numeric else null(BOOL)


CASTS = {"int": to_int, "float": to_dec, "dec": to_dec, "string": to_text, "bool": to_bool}
for _name, _key in {"to_int": "int", "to_float": "float", "to_dec": "dec", "to_string": "string", "to_bool": "bool"}.items():
    scalar(f"cast/{_name}", 1)(CASTS[_key])
scalar("cast/parse_int", 1)(lambda a: to_int(a) if a.text else null(LONG))
scalar("cast/parse_float", 1)(lambda a: to_dec(a) if a.text else null("decimal(38,18)"))
scalar("cast/try_cast", 2)(lambda a, kind: CASTS[kind.lit](a) if kind.lit in CASTS else null())

# datetime: times are milliseconds since the epoch, UTC; timestamps are taken as well


def millis(a) -> Column:
    if isinstance(a.t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_millis(a.c.cast("timestamp"))
    return whole(a)


def moment(a) -> Column:
    return a.c.cast("timestamp") if isinstance(a.t, (T.TimestampType, T.TimestampNTZType)) else F.timestamp_millis(whole(a))


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


scalar("datetime/now", 0, pure=False)(now_millis)
scalar("datetime/age", 1, pure=False)(lambda a: ((now_millis() - millis(a)) / 1000).cast(LONG))
scalar("datetime/to_epoch_s", 1)(lambda a: F.floor(millis(a) / 1000))
scalar("datetime/to_epoch_ms", 1)(millis)
scalar("datetime/from_epoch_s", 1)(lambda a: F.try_multiply(whole(a), F.lit(1000).cast(LONG)))
scalar("datetime/from_epoch_ms", 1)(whole)
scalar("datetime/parse_rfc3339", 1)(lambda a: F.when(text(a).rlike(r"\A\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)\z"), F.unix_millis(F.try_to_timestamp(F.upper(text(a))))))
scalar("datetime/format_rfc3339", 1)(lambda a: F.concat(F.date_format(moment(a), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.pmod(millis(a), F.lit(1000)) == 0, F.lit("")).otherwise(F.date_format(moment(a), ".SSS")), F.lit("+00:00")))

#: Strftime codes and the patterns of Spark that say the same.
STRFTIME = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM",
    "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh", "%3f": "SSS", "%.3f": ".SSS", "%6f": "SSSSSS", "%z": "xx", "%:z": "xxx", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%R": "HH:mm", "%%": "%",
}


def strftime(pattern: str) -> str | None:
    """A strftime pattern for Spark, None if a code is not known."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "%":
            code = next((pattern[i : i + n] for n in (4, 3, 2) if pattern[i : i + n] in STRFTIME), None)
            if code is None:
                return None
            out.append(STRFTIME[code])
            i += len(code)
        else:
            c = pattern[i]
            out.append("''" if c == "'" else f"'{c}'" if c.isalpha() else c)
            i += 1
    return "".join(out)


def _patterned(build, kind):
    def made(a, pattern):
        p = constant(pattern, "bad_pattern")
        spark = strftime(p) if isinstance(p, str) else None
        return null(kind) if spark is None else build(a, spark)

    return made


scalar("datetime/parse", 2)(_patterned(lambda a, p: F.unix_millis(F.try_to_timestamp(text(a), F.lit(p))), LONG))
scalar("datetime/format", 2)(_patterned(lambda a, p: F.date_format(moment(a), p), TEXT))
for _name, _fn in {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "weekday": F.weekday}.items():
    scalar(f"datetime/{_name}", 1)(lambda a, f=_fn: f(moment(a)).cast(LONG))
scalar("datetime/is_weekend", 1)(lambda a: F.weekday(moment(a)) >= 5)
scalar("datetime/add_secs", 2)(lambda a, n: F.try_add(millis(a), F.try_multiply(whole(n), F.lit(1000).cast(LONG))))
scalar("datetime/add_days", 2)(lambda a, n: F.try_add(millis(a), F.try_multiply(whole(n), F.lit(86_400_000).cast(LONG))))
scalar("datetime/diff_secs", 2)(lambda a, b: F.floor(F.try_subtract(millis(a), millis(b)) / 1000))
for _name in ("day", "week", "month"):
    scalar(f"datetime/start_of_{_name}", 1)(lambda a, u=_name: F.unix_millis(F.date_trunc(u, moment(a))))
scalar("datetime/truncate", 2)(lambda a, unit: F.unix_millis(F.date_trunc(unit.lit, moment(a))) if unit.lit in ("second", "minute", "hour", "day", "week", "month", "year") else null(LONG))

# value_nav and object: structs, maps, lists and variants


def step(v: Val, key: object) -> Val | None:
    """One step into a value, None if its type has no such step."""
    if isinstance(v.t, T.StructType) and isinstance(key, str):
        found = next((f for f in v.t.fields if f.name == key), None)
        return Val(v.c.getField(key), found.dataType) if found else None
    if isinstance(v.t, T.MapType) and isinstance(key, str):
        return Val(F.try_element_at(v.c, F.lit(key)), v.t.valueType)
    if isinstance(v.t, T.ArrayType) and isinstance(key, int):
        return Val(F.try_element_at(v.c, F.lit(key + 1 if key >= 0 else key)), v.t.elementType)
    if isinstance(v.t, T.VariantType):
        return Val(F.try_variant_get(v.c, f"$[{key}]" if isinstance(key, int) else f"$['{key}']", "variant"), v.t)
    return None


def path_keys(path: Val) -> list:
    """A literal path as steps: a list of names and indexes, or a dotted text."""
    p = constant(path, "bad_path")
    return list(p) if isinstance(p, (list, tuple)) else [int(x) if re.fullmatch(r"-?\d+", x) else x for x in str(p).split(".")]


def get_path(v: Val, path: Val) -> Column:
    for key in path_keys(path):
        v = step(v, key)
        if v is None:
            return null()
    return v.c


def map_keys(v: Val) -> Column:
    if isinstance(v.t, T.StructType):
        return F.when(v.c.isNotNull(), F.array(*(F.lit(f.name) for f in v.t.fields)))
    return F.map_keys(v.c) if isinstance(v.t, T.MapType) else null("array<string>")


def _fields(v: Val) -> list[str]:
    return [f.name for f in v.t.fields] if isinstance(v.t, T.StructType) else []


def _rebuilt(v: Val, names: list[str]) -> Column:
    return F.when(v.c.isNotNull(), F.struct(*(v.c.getField(n).alias(n) for n in names)) if names else null("struct<>"))


def _picked(keep: bool):
    def build(v, keys):
        names = constant(keys, "bad_keys")
        if isinstance(v.t, T.StructType):
            return _rebuilt(v, [n for n in (names if keep else _fields(v)) if (n in names) == keep and n in _fields(v)])
        if isinstance(v.t, T.MapType):
            return F.map_filter(v.c, lambda k, _: k.isin(list(names)) if keep else ~k.isin(list(names)))
        return null()

    return build


def _merge(a, b):
    if isinstance(a.t, T.StructType) and isinstance(b.t, T.StructType):
        names = [*_fields(a), *(n for n in _fields(b) if n not in _fields(a))]
        return F.when(a.c.isNotNull() & b.c.isNotNull(), F.struct(*((b if n in _fields(b) else a).c.getField(n).alias(n) for n in names)))
    if isinstance(a.t, T.MapType) and isinstance(b.t, T.MapType):
        return F.map_concat(F.map_filter(a.c, lambda k, _: ~F.map_contains_key(b.c, k)), b.c)
    return null()


def _entries(v):
    if isinstance(v.t, T.StructType):
        return F.when(v.c.isNotNull(), F.array(*(F.array(F.lit(n), v.c.getField(n).cast(TEXT)) for n in _fields(v))))
    return F.transform(F.map_entries(v.c), lambda e: F.array(e["key"].cast(TEXT), e["value"].cast(TEXT))) if isinstance(v.t, T.MapType) else null("array<array<string>>")


def _values(v):
    if isinstance(v.t, T.StructType):
        return F.when(v.c.isNotNull(), F.array(*(v.c.getField(n).cast(TEXT) for n in _fields(v))))
    return F.map_values(v.c) if isinstance(v.t, T.MapType) else null("array<string>")


def _has_key(v, key):
    k = constant(key, "bad_key")
    if isinstance(v.t, T.StructType):
        return F.when(v.c.isNotNull(), F.lit(k in _fields(v)))
    return F.map_contains_key(v.c, F.lit(k)) if isinstance(v.t, T.MapType) else null(BOOL)


def type_name(t: T.DataType) -> str:
    """The query language's name of a type."""
    for kind, name in ((T.NullType, "null"), (T.BooleanType, "bool"), (T.IntegralType, "int"), (T.FractionalType, "f64"), (T.StringType, "string"), (T.BinaryType, "bytes"), (T.ArrayType, "list")):
        if isinstance(t, kind) and not isinstance(t, T.DecimalType):
            return name
    return "dec" if isinstance(t, T.DecimalType) else "int" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "map"


scalar("value_nav/get_path", 2)(get_path)
scalar("value_nav/array_length", 1)(lambda a: F.array_size(items(a)).cast(LONG))
scalar("value_nav/keys", 1)(map_keys)
scalar("value_nav/type_of", 1)(lambda a: F.when(a.c.isNull(), F.lit("null")).otherwise(F.lit(type_name(a.t))))
scalar("value_nav/exists", 2)(lambda a, p: get_path(a, p).isNotNull())
scalar("object/keys", 1)(map_keys)
scalar("object/values", 1)(_values)
scalar("object/entries", 1)(_entries)
scalar("object/has_key", 2)(_has_key)
scalar("object/get_path", 2)(get_path)
scalar("object/merge", 2)(_merge)
scalar("object/pick", 2)(_picked(True))
scalar("object/omit", 2)(_picked(False))

# validate

#: The patterns that decide these formats.
FORMATS = {
    "email": r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$",
    "url": r"^https?://[^\s/$.?#][^\s]*$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "ipv4": r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$",
    "phone": r"^\+?[1-9][0-9]{6,14}$",
}
for _name, _pattern in FORMATS.items():
    scalar(f"validate/is_{_name}", 1)(lambda a, p=_pattern: text(a).rlike(regex(p)))
scalar("validate/is_ipv6", 1)(lambda a: udfs.is_ipv6(text(a)))
scalar("validate/luhn", 1)(lambda a: F.when(text(a).rlike(r"\A[0-9]+\z"), F.call_function("luhn_check", text(a))).otherwise(F.when(text(a).isNotNull(), F.lit(False))))
scalar("validate/in_range", 3)(lambda a, lo, hi: num(a).between(num(lo), num(hi)))
scalar("validate/matches", 2)(_regex_fn(lambda c, p: c.rlike(p), BOOL))
_JSON_LITERAL = r"\A[ \t\n\r]*(\[|\{|\"|-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?[ \t\n\r]*\z|(true|false|null)[ \t\n\r]*\z)"


def _is_json(c: Column) -> Column:
    """One JSON value and no more: the parser stops after the first, so the text must be all that stands before a mark it can't hold."""
    mark = F.sha2(c.cast("binary"), 256)
    parsed = F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"'), mark, F.lit('"]')))
    return F.when(c.isNotNull(), c.rlike(_JSON_LITERAL) & F.coalesce(F.try_variant_get(parsed, "$[1]", "string") == mark, F.lit(False)))


scalar("validate/is_json", 1)(lambda a: _is_json(text(a)))


def _is_empty(a):
    empty = a.c == "" if a.text else F.octet_length(a.c) == 0 if isinstance(a.t, T.BinaryType) else F.size(a.c) == 0 if isinstance(a.t, (T.ArrayType, T.MapType)) else F.lit(isinstance(a.t, T.StructType) and not a.t.fields)
    return F.coalesce(empty, F.lit(True)) if a.text or isinstance(a.t, (T.BinaryType, T.ArrayType, T.MapType)) else a.c.isNull() | empty


scalar("validate/is_empty", 1)(_is_empty)
scalar("validate/len_between", 3)(lambda a, lo, hi: F.char_length(text(a)).between(whole(lo), whole(hi)))

# encode


def _base64(c: Column) -> Column:
    return F.regexp_replace(F.base64(c), r"[\r\n]", "")


scalar("encode/base64_enc", 1)(lambda a: _base64(raw(a)))
scalar("encode/base64_dec", 1)(lambda a: udfs.base64_dec(text(a)))
scalar("encode/base64url_enc", 1)(lambda a: F.translate(_base64(raw(a)), "+/", "-_"))
scalar("encode/base64url_dec", 1)(lambda a: udfs.base64url_dec(text(a)))
scalar("encode/hex_enc", 1)(lambda a: F.lower(F.hex(raw(a))))
scalar("encode/hex_dec", 1)(lambda a: F.when(text(a).rlike(r"\A([0-9A-Fa-f]{2})*\z"), F.unhex(text(a))))
scalar("encode/base32_enc", 1)(lambda a: udfs.base32_enc(raw(a)))
scalar("encode/base32_dec", 1)(lambda a: udfs.base32_dec(text(a)))


@scalar("encode/url_encode", 1)
def _url_encode(a):
    """Percent codes for all but ASCII letters and digits."""
    digits = F.hex(text(a).cast("binary"))
    plain = {f"{c:02X}": chr(c) for c in range(128) if chr(c).isalnum()}
    parts = F.transform(F.filter(F.split(F.regexp_replace(digits, "(..)", "$1 "), " "), lambda x: x != ""), lambda x: F.coalesce(F.element_at(F.create_map(*(F.lit(y) for kv in plain.items() for y in kv)), x), F.concat(F.lit("%"), x)))
    return F.array_join(parts, "")


scalar("encode/url_decode", 1)(lambda a: F.try_url_decode(F.replace(text(a), F.lit("+"), F.lit("%2B"))))


@scalar("encode/html_escape", 1)
def _html_escape(a):
    c = text(a)
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(code))
    return c


scalar("encode/json_escape", 1)(lambda a: udfs.json_escape(text(a)))


@scalar("encode/to_json", 1)
def _to_json(a):
    if isinstance(a.t, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        return F.to_json(a.c, {"ignoreNullFields": "false"})
    if a.text or isinstance(a.t, T.DecimalType):
        return F.coalesce(F.concat(F.lit('"'), udfs.json_escape(a.c.cast(TEXT)), F.lit('"')), F.lit("null"))
    return F.coalesce(a.c.cast(TEXT), F.lit("null"))


scalar("encode/parse_json", 1)(lambda a: F.when(_is_json(text(a)), F.try_parse_json(text(a))))

# gen

scalar("gen/uuid_v4", 0, pure=False)(F.uuid)
scalar("gen/random", 0, pure=False)(F.rand)
scalar("gen/random_bytes", 1, pure=False)(lambda n: udfs.random_bytes(whole(n)))

# text

scalar("text/normalize_nfc", 1)(lambda a: udfs.normalize_nfc(text(a)))
scalar("text/normalize_nfkc", 1)(lambda a: udfs.normalize_nfkc(text(a)))
scalar("text/slugify", 1)(lambda a: F.trim(F.lower(F.regexp_replace(text(a), "[^A-Za-z0-9]+", "-")), F.lit("-")))
scalar("text/levenshtein", 2)(lambda a, b: F.levenshtein(text(a), text(b)).cast(LONG))
scalar("text/jaro_winkler", 2)(lambda a, b: udfs.jaro_winkler(text(a), text(b)))
scalar("text/word_count", 1)(lambda a: F.regexp_count(text(a), F.lit(r"(?U)\S+")).cast(LONG))
scalar("text/truncate_ellipsis", 2)(lambda a, n: F.when(whole(n) >= 0, F.when(F.char_length(text(a)) <= whole(n), text(a)).when(whole(n) == 0, F.lit("")).otherwise(F.concat(F.substr(text(a), F.lit(1), (whole(n) - 1).cast("int")), F.lit("…")))))

# crypto: bytes in, bytes out

scalar("crypto/sha256", 1)(lambda a: F.unhex(F.sha2(data(a), 256)))
scalar("crypto/sha512", 1)(lambda a: F.unhex(F.sha2(data(a), 512)))
scalar("crypto/sha3_256", 1)(lambda a: udfs.sha3_256(data(a)))
scalar("crypto/blake3", 1)(lambda a: udfs.blake3(data(a)))
scalar("crypto/hmac_sha256", 2)(lambda k, m: udfs.hmac_sha256(data(k), data(m)))
scalar("crypto/ct_eq", 2)(lambda a, b: data(a) == data(b))
scalar("crypto/canonical_hash", 1)(lambda a: udfs.canonical_hash(a.c))
scalar("crypto/argon2id", 2, 6)(lambda password, salt, *more: udfs.argon2id(data(password), data(salt), *(whole(m).cast(LONG) for m in more)))
