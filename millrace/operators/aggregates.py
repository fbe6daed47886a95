"""Aggregates: the five built in and the library of eighteen.

Nulls are skipped, but by ``array_agg``. Over no input ``sum`` and ``range`` are
0, ``bool_and`` true, ``bool_or`` false, ``string_agg`` empty, ``array_agg`` an
empty list, and the others null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import Val
from ..plans.errors import QueryError


def _zero(v: Val) -> Column:
    return F.lit(0).cast("bigint" if isinstance(v.t, T.IntegralType) or not v.numeric else v.t.simpleString() if not isinstance(v.t, T.DecimalType) else "decimal(38,10)")


def _numbers(v: Val) -> Column:
    """The numbers of a column: texts and the like do not count."""
    return v.c if v.numeric else F.lit(None).cast("bigint")


def total(v: Val, distinct: bool) -> Column:
    c = _numbers(v)
    out = F.sum_distinct(c) if distinct else F.sum(c)
    return F.coalesce(out, _zero(v).cast("bigint") if isinstance(v.t, T.IntegralType) or not v.numeric else F.lit(0).cast("double") if not isinstance(v.t, T.DecimalType) else F.lit(0).cast("decimal(38,10)"))


def _real(c: Column, v: Val) -> Column:
    """A column without NaN, which has no order."""
    return F.when(~F.isnan(c), c) if isinstance(v.t, (T.DoubleType, T.FloatType)) else c


def _each(v: Val, distinct: bool, fold: Callable[[Column], Column]) -> Column:
    """An aggregate over distinct values, where Spark has no form of its own."""
    return fold(F.array_distinct(F.collect_list(v.c)) if distinct else F.collect_list(v.c))


def _rank(v: Val, p: float, distinct: bool) -> Column:
    """The value of nearest rank ceil(p * n).

    Types that a double holds exactly use counts per value, merged between tasks;
    others, where that would round, sort the group's values.
    """
    if isinstance(v.t, (T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType)) and v.name and not distinct:
        return F.expr(f"percentile_disc({p!r}) within group (order by `{v.name}`)").cast(v.t)

    def pick(values: Column) -> Column:
        ordered = F.sort_array(values)
        at = F.greatest(F.lit(0), F.ceil(F.lit(float(p)) * F.size(ordered)).cast("int") - 1)
        return F.get(ordered, at)

    return _each(v, distinct, pick)


def _needs_numbers(build):
    return lambda v, *a: build(v, *a) if v.numeric else F.max(F.lit(None).cast("double"))


def _percentile(v, d, p=0.5, *_):
    if not isinstance(p, (int, float)) or not 0 <= p <= 1:
        raise QueryError("bad_percentile", str(p))
    return _rank(v, float(p), d)


def _string_agg(v, d, separator=",", order=None):
    if not v.text:
        return F.max(F.lit(None).cast("string"))
    if d:
        return F.array_join(F.array_sort(F.collect_set(v.c)), separator)
    pairs = F.sort_array(F.collect_list(F.when(v.c.isNotNull(), F.struct(*order, v.c.alias("__v"))))) if order else None
    return F.array_join(F.transform(pairs, lambda x: x["__v"]) if order else F.collect_list(v.c), separator)


def _array_agg(v, d, order=None):
    pairs = F.collect_list(F.struct(*(order or []), v.c.alias("__v")))
    out = F.transform(F.sort_array(pairs) if order else pairs, lambda x: x["__v"])
    return F.array_distinct(out) if d else out


LIBRARY: dict[str, Callable[..., Column]] = {
    "count": lambda v, d: F.count_distinct(v.c) if d else F.count(v.c),
    "count_distinct": lambda v, d: F.count_distinct(v.c),
    "sum": total,
    "avg": _needs_numbers(lambda v, d: _avg(v, d)),
    "min": lambda v, d: F.min(_real(v.c, v)),
    "max": lambda v, d: F.max(_real(v.c, v)),
    "median": lambda v, d: _rank(v, 0.5, d),
    "stddev": _needs_numbers(lambda v, d: F.stddev_pop(v.c.cast("double"))),
    "variance": _needs_numbers(lambda v, d: F.var_pop(v.c.cast("double"))),
    "percentile": _percentile,
    "first": lambda v, d, order=None: F.min_by(v.c, F.when(v.c.isNotNull(), F.struct(*order))) if order else F.first(v.c, ignorenulls=True),
    "last": lambda v, d, order=None: F.max_by(v.c, F.when(v.c.isNotNull(), F.struct(*order))) if order else F.last(v.c, ignorenulls=True),
    "string_agg": _string_agg,
    "array_agg": _array_agg,
    "bool_and": lambda v, d: F.coalesce(F.bool_and(v.c), F.lit(True)),
    "bool_or": lambda v, d: F.coalesce(F.bool_or(v.c), F.lit(False)),
    "mode": lambda v, d: F.mode(v.c, True),
    "range": _needs_numbers(lambda v, d: F.coalesce(F.max(v.c) - F.min(v.c), F.lit(0))),
}
BUILT_IN = ("count", "sum", "avg", "min", "max")
ORDERED = ("first", "last", "string_agg", "array_agg")


def _avg(v: Val, distinct: bool) -> Column:
    return F.try_divide(F.sum_distinct(v.c), F.count_distinct(v.c)) if distinct else F.avg(v.c)


def aggregate(name: str, v: Val, args: list, distinct: bool, order: list[Column] | None = None) -> Column:
    """A library aggregate. ``order``: the scan order that ``first``, ``last`` and the list aggregates follow."""
    build = LIBRARY.get(name)
    if build is None:
        raise QueryError("unknown_aggregate", name)
    if name in ORDERED:
        return build(v, distinct, *args, order=order)
    return build(v, distinct, *args)
