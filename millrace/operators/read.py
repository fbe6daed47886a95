"""The single-table read: where, group, having, select, distinct, order, page."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import Val
from ..plans.compiler import Scope, compare, literal, value, where
from ..plans.errors import QueryError
from . import aggregates, vector

AGGREGATES = ("aggregate", "count_all", "aggregate_fn")
DEFAULT_ID = "_id"


@dataclass
class Result:
    """A read's rows, lazy, and what else it tells."""

    df: DataFrame
    pagination: dict | None = None
    plan: dict | None = None
    skipped: bool = False
    ordered: bool = False
    extra: dict = field(default_factory=dict)


def _path(p) -> list:
    return [p] if isinstance(p, str) else list(p)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _select(spec: dict) -> tuple[list[dict], bool]:
    chosen = spec.get("select") or {}
    if isinstance(chosen, list):
        chosen = {"items": chosen}
    items = [{"type": "field", "path": [i]} if isinstance(i, str) else i for i in chosen.get("items", [])]
    if any(i["type"] == "all" for i in items):
        if len(items) > 1:
            raise QueryError("all_with_others", "* stands alone")
        items = []
    return items, bool(chosen.get("distinct"))


def item_name(item: dict) -> str:
    """An item's output name: its alias, else what its kind says."""
    if item.get("alias"):
        return item["alias"]
    kind = item["type"]
    if kind == "field":
        return str(_path(item["path"])[-1])
    return {"count_all": "count", "function": item.get("name"), "expr": "expr"}.get(kind) or f"{item.get('func') or item.get('name')}_{_path(item['field'])[-1] if item.get('field') else 'all'}"


def _names(items: list[dict]) -> list[str]:
    names = [item_name(i) for i in items]
    if len(set(names)) < len(names):
        raise QueryError("duplicate_name", ", ".join(sorted({n for n in names if names.count(n) > 1})))
    return names


def _select_expr(e: dict) -> object:
    """An arithmetic tree as a value expression."""
    if e["op"] == "field":
        return {"$ref": e["path"]}
    if e["op"] == "literal":
        return e["value"]
    return {"$expr": {"op": e["op"], "args": [_select_expr(e["left"]), _select_expr(e["right"])]}}


def _item(item: dict, scope: Scope) -> Column:
    if item["type"] == "field":
        found = scope.path(item["path"])
        return found.c if found else F.lit(None)
    if item["type"] == "function":
        return value({"$fn": {"name": item["name"], "args": item.get("args", [])}}, scope).c
    if item["type"] == "expr":
        return value(_select_expr(item["expr"]), scope).c
    raise QueryError("unknown_item", item["type"])


def _grouped(df: DataFrame, spec: dict, items: list[dict], scope: Scope, id_col: str) -> DataFrame:
    """The groups with their aggregates, HAVING applied to the output names."""
    group = spec.get("group_by") or {}
    keys = [_path(p) for p in (group.get("fields", []) if isinstance(group, dict) else group)]
    having = group.get("having") if isinstance(group, dict) else None
    names = _names(items)
    fed, made, order = {}, [], [quoted(id_col)] if id_col in df.columns else None
    for i, (item, name) in enumerate(zip(items, names, strict=True)):
        if item["type"] == "count_all":
            made.append(F.count(F.lit(1)).alias(name))
        elif item["type"] in AGGREGATES:
            f, distinct = item.get("field"), bool(item.get("distinct"))
            func = item.get("func") or item.get("name")
            if not f:
                made.append(F.count(F.lit(1)).alias(name))
                continue
            v = scope.path(f) or literal(None)
            fed[f"__a{i}"] = v.c
            args = [value(a, scope).lit for a in item.get("args", [])]
            made.append(aggregates.aggregate(func, Val(F.col(f"__a{i}"), v.t, name=f"__a{i}"), args, distinct, order).alias(name))
        elif item["type"] == "field":
            if _path(item["path"]) not in keys:
                raise QueryError("not_grouped", str(item["path"]))
        else:
            raise QueryError("not_grouped", name)
    for i, k in enumerate(keys):
        found = scope.path(k)
        fed[f"__k{i}"] = found.c if found else F.lit(None).cast("string")
    kept = [quoted(id_col)] if order else []
    grouped = df.select(*kept, *(c.alias(n) for n, c in fed.items())).groupBy(*(f"__k{i}" for i in range(len(keys))))
    out = grouped.agg(*made) if made else grouped.agg(F.count(F.lit(1)).alias("__n"))
    shown = [F.col(f"__k{keys.index(_path(i['path']))}").alias(n) if i["type"] == "field" else quoted(n) for i, n in zip(items, names, strict=True)]
    hidden = [F.col(f"__k{i}").alias(str(k[-1])) for i, k in enumerate(keys) if str(k[-1]) not in names]
    out = out.select(*shown, *hidden)
    if having is not None:
        out = where(out, having, Scope(None, scope.params, scope.lookup))
    return out.select(*map(quoted, names)) if names else out


def ordering(c: Column, item: dict) -> Column:
    """Ascending puts nulls last and descending first, unless the item says otherwise."""
    down = item.get("direction", "asc") == "desc"
    first = item["nulls"] == "first" if item.get("nulls") else down
    return (c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last())


def _order_items(spec: dict) -> list[dict]:
    order = spec.get("order_by") or {}
    items = order if isinstance(order, list) else order.get("items", [])
    return [{"field": [i]} if isinstance(i, str) else i for i in items]


def _after(df: DataFrame, page: dict, items: list[dict], id_col: str) -> DataFrame:
    """Rows strictly after a key in the order; rows of the same key only with ``after_id``."""
    key = page["key"]
    if len(key) != len(items):
        raise QueryError("bad_key", "one value per order item")
    scope = Scope(df)
    after, equal = F.lit(False), F.lit(True)
    for item, k in zip(items, key, strict=True):
        v = scope.path(item["field"])
        if v is None:
            raise QueryError("unknown_field", str(item["field"]))
        w, down = literal(k), item.get("direction", "asc") == "desc"
        nulls_first = item["nulls"] == "first" if item.get("nulls") else down
        if k is None:
            later = v.c.isNotNull() if nulls_first else F.lit(False)
        else:
            later = F.coalesce(compare("lt" if down else "gt", v, w), F.lit(False))
            later = later if nulls_first else later | v.c.isNull()
        after = after | (equal & later)
        equal = equal & F.coalesce(compare("eq", v, w), F.lit(False))
    if page.get("after_id") is not None:
        after = after | (equal & (quoted(id_col) > F.lit(page["after_id"])))
    return df.where(after)


def page_info(page: dict, total: int | None) -> dict:
    """Where a page stands; ``has_next`` is false while the total is unknown."""
    mode = page.get("mode")
    if mode == "Page":
        size, number = page["page_size"], page["page"]
        pages = ceil(total / size) if total is not None and size else None
        return {"total_count": total, "total_pages": pages, "current_page": number, "page_size": size, "has_next": pages is not None and number < pages, "has_prev": number > 1}
    size, skip = page.get("limit"), page.get("offset", 0)
    return {
        "total_count": total, "total_pages": ceil(total / size) if total is not None and size else None, "current_page": skip // size + 1 if size else 1, "page_size": size,
        "has_next": total is not None and size is not None and skip + size < total, "has_prev": skip > 0,
    }


def _paged(df: DataFrame, page: dict, items: list[dict], id_col: str) -> DataFrame:
    mode = page.get("mode")
    if mode == "After":
        return df.limit(page["limit"]) if page.get("limit") is not None else df
    if mode == "Page":
        if page["page"] < 1:
            raise QueryError("bad_page", "pages start at 1")
        skip, size = (page["page"] - 1) * page["page_size"], page["page_size"]
    else:
        skip, size = page.get("offset", 0), page.get("limit")
    df = df.offset(skip) if skip else df
    return df.limit(size) if size is not None else df


def run(df: DataFrame, spec: dict, params: dict | None = None, lookup=None, id_col: str = DEFAULT_ID) -> Result:
    """Run a read on its source rows (already latest, as-of or history). Nothing is executed but ``count_total``."""
    scope = Scope(df, params or {}, lookup)
    items, distinct = _select(spec)
    similar, condition = vector.split(spec.get("where"))
    rows = where(df, condition, scope)
    if similar is not None:
        rows = vector.nearest(rows, similar, id_col)
    scope.df = rows
    order = _order_items(spec)
    page = spec.get("pagination") or {}
    group = spec.get("group_by")
    if group and isinstance(group, dict) and group.get("having") and not group.get("fields"):
        raise QueryError("having_without_group", "HAVING needs GROUP BY")
    if group or any(i["type"] in AGGREGATES for i in items):
        if not items:
            items = [{"type": "field", "path": p} for p in (group.get("fields", []) if isinstance(group, dict) else group)]
        rows = _grouped(rows, spec, items, scope, id_col)
    elif items:
        names = _names(items)
        shown = [_item(i, scope).alias(n) for i, n in zip(items, names, strict=True)]
        tail = []
        if not distinct and id_col in rows.columns and id_col not in names and order:
            tail = [quoted(id_col).alias("__id")]
        if spec.get("with_version") and "_version" in rows.columns and "_version" not in names:
            shown.append(F.col("_version"))
        rows = rows.select(*shown, *tail)
    if distinct:
        rows = rows.distinct()
    total = rows.count() if spec.get("count_total") else None
    if page.get("mode") == "After":
        rows = _after(rows, page, order, "__id" if "__id" in rows.columns else id_col)
    if order:
        seen = Scope(rows)
        keys = [ordering(found.c, i) for i in order if (found := seen.path(i["field"])) is not None]
        tie = next((quoted(c).asc() for c in ("__id", id_col) if c in rows.columns), None)
        rows = rows.orderBy(*keys, *([tie] if tie is not None else []))
    if page:
        rows = _paged(rows, page, order, id_col)
    if "__id" in rows.columns:
        rows = rows.drop("__id")
    told = page_info(page, total) if page or total is not None else None
    return Result(rows, told, ordered=bool(order) or similar is not None)


