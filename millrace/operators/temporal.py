"""Reads of versioned rows: the latest, as of a version or time, and the history.

Versioned rows carry ``_id``, ``_version``, ``_ts`` (milliseconds, may be null)
and ``_deleted`` beside their own columns. The latest row of an id is kept by an
aggregate that combines before the shuffle, so a much-changed id sends one row
per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import Scope, where
from ..plans.errors import QueryError

SYSTEM = ("_id", "_version", "_ts", "_deleted")


def latest(history: DataFrame) -> DataFrame:
    """Each id's newest row, but for deleted ones; own columns, ``_id`` and ``_version``."""
    newest = history.groupBy("_id").agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in history.columns)), "_version").alias("r"))
    return newest.where("not r._deleted").select("r.*").drop("_deleted", "_ts")


def _bound(at: dict | None) -> tuple[str, int] | None:
    if at is None:
        return None
    if "version" in at:
        return "_version", int(at["version"])
    if "timestamp" in at:
        return "_ts", int(at["timestamp"])
    raise QueryError("bad_time", str(at))


def as_of(history: DataFrame, at: dict) -> DataFrame:
    """The rows as they stood at a version, or at the newest version whose time is not after a time."""
    column, limit = _bound(at)
    if column == "_ts":
        limit = history.where(F.col("_ts") <= limit).agg(F.max("_version")).first()[0]
        if limit is None:
            raise QueryError("no_version", "nothing was written by that time")
    return latest(history.where(F.col("_version") <= limit))


def timeline(history: DataFrame, condition: dict | None, temporal: dict, params: dict | None = None, lookup=None) -> DataFrame:
    """Versions of the records that match now, in version order, with ``_version`` and ``_ts``.

    Bounds are inclusive; a bound by time leaves out versions of unknown time.
    """
    now = where(latest(history), condition, Scope(None, params or {}, lookup)).select("_id")
    rows = history.join(now, "_id", "left_semi")
    for side, sign in (("from", 1), ("to", -1)):
        bound = _bound(temporal.get(side))
        if bound:
            rows = rows.where(F.col(bound[0]) >= bound[1] if sign > 0 else F.col(bound[0]) <= bound[1])
    key: Column = F.col("_version").desc() if temporal.get("order") == "desc" else F.col("_version").asc()
    rows = rows.orderBy(key, "_id")
    return rows.limit(temporal["limit"]) if temporal.get("limit") is not None else rows


def retained(history: DataFrame, now_ms: int, max_age_secs: int | None = None, max_count: int | None = None, min_count: int = 1) -> DataFrame:
    """The versions that retention keeps: young enough and among an id's newest ``max_count``, but at least ``min_count``."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("_id").orderBy(F.col("_version").desc()))
    keep = F.lit(True)
    if max_age_secs is not None:
        keep = keep & (F.coalesce(F.col("_ts"), F.lit(now_ms)) >= now_ms - max_age_secs * 1000)
    if max_count is not None:
        keep = keep & (F.col("__nth") <= max_count)
    return history.withColumn("__nth", nth).where(keep | (F.col("__nth") <= min_count)).drop("__nth")


def purged(history: DataFrame, older_than: int | None = None, older_than_age_secs: int | None = None, now_ms: int = 0) -> DataFrame:
    """History without versions older than a version or an age; each id's newest version stays."""
    newest = history.groupBy("_id").agg(F.max("_version").alias("__top"))
    old = F.lit(False)
    if older_than is not None:
        old = old | (F.col("_version") < older_than)
    if older_than_age_secs is not None:
        old = old | (F.coalesce(F.col("_ts"), F.lit(now_ms)) < now_ms - older_than_age_secs * 1000)
    return history.join(newest, "_id").where(~old | (F.col("_version") == F.col("__top"))).drop("__top")
