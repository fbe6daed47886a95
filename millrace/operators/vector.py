"""Vector search: exact nearest neighbours by L2, cosine or dot distance.

Distances are computed in the JVM and the best k are kept by a top-k per task,
so nothing but k rows per task is shuffled. Filters come first: the k nearest
are those of the rows that satisfy them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import QueryError

MAX_K = 10_000
TINY = 1e-9
METRICS = ("l2", "cosine", "dot")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def distance(column: Column, query: list[float], metric: str = "l2") -> Column:
    """Distance of a list column to a vector; smaller is nearer."""
    if metric not in METRICS:
        raise QueryError("unknown_metric", metric)
    c, q = column.cast("array<double>"), F.array(*(F.lit(float(x)) for x in query))
    if metric == "l2":
        return F.sqrt(_sum(F.zip_with(c, q, lambda a, b: (a - b) * (a - b))))
    dot = _sum(F.zip_with(c, q, lambda a, b: a * b))
    if metric == "dot":
        return -dot
    norm, own = F.sqrt(_sum(F.transform(c, lambda a: a * a))), sum(float(x) ** 2 for x in query) ** 0.5
    return F.when((norm < TINY) | F.lit(own < TINY), F.lit(1.0)).otherwise(1 - dot / (norm * own))


def split(f: dict | None) -> tuple[dict | None, dict | None]:
    """A filter's vector search, if it has one as a conjunct, and the rest."""
    if f is None:
        return None, None
    if f["op"] == "vector_similarity":
        return f, None
    if f["op"] == "and":
        found = [x for x in f["filters"] if x["op"] == "vector_similarity"]
        if len(found) > 1:
            raise QueryError("several_vectors", "one vector search a query")
        if found:
            rest = [x for x in f["filters"] if x is not found[0]]
            return found[0], {"op": "and", "filters": rest} if rest else None
    return None, f


def nearest(df: DataFrame, search: dict, id_col: str = "_id", name: str = "_distance") -> DataFrame:
    """The k rows nearest to a vector, nearest first, ties by id, with their distance."""
    path = search["field"] if isinstance(search["field"], str) else ".".join(f"`{p}`" for p in search["field"])
    field = df.select(F.col(path)).schema.fields[0].dataType
    if not isinstance(field, T.ArrayType):
        raise QueryError("not_a_vector", str(path))
    k = min(int(search["k"]), MAX_K)
    dim = len(search["query"])
    c = F.col(path)
    checked = F.when(c.isNull() | (F.size(c) == dim), c).otherwise(F.raise_error(F.lit(f"vectors of {dim} values are needed")).cast(field))
    ranked = df.where(c.isNotNull()).withColumn(name, distance(checked, search["query"], search.get("metric", "l2")))
    tie = [F.col(id_col)] if id_col in df.columns else []
    return ranked.orderBy(F.col(name), *tie).limit(k)
