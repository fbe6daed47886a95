"""Subscriptions: change rows as a stream, filtered per source and shaped for delivery.

A change row is (table, op, key, commit_version, value). Sources name a table,
a filter on the value and the events wanted; deletes pass every filter. With
``initial`` the current rows come first, in a batch of their own; ``from_version``
replays from a version. A version never comes twice: rows are deduplicated by
table, key and version within the watermark.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.compiler import Scope, predicate
from ..plans.errors import QueryError

ALLOWED = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in", "is_null", "is_not_null", "exists", "not_exists", "and", "or", "not")
EVENTS = ("all", "put", "delete")
DELIVER = ("records", "keys")
MAX_SUBSCRIPTIONS = 256


def change_schema(value: T.StructType) -> T.StructType:
    """The schema of change rows whose values are of one shape."""
    return T.StructType([T.StructField("table", T.StringType()), T.StructField("op", T.StringType()), T.StructField("key", T.StringType()), T.StructField("commit_version", T.LongType()), T.StructField("value", value)])


def check_filter(f: dict | None) -> None:
    """Raise for a filter that a subscription may not use."""
    if f is None:
        return
    if f["op"] not in ALLOWED:
        raise QueryError("filter_not_allowed", f["op"])
    for x in f.get("filters", []) or ([f["filter"]] if "filter" in f else []):
        check_filter(x)


def _under(f: dict, root: str) -> dict:
    """A filter with its fields below a struct column."""
    if "field" in f:
        return {**f, "field": [root, *([f["field"]] if isinstance(f["field"], str) else f["field"])]}
    if "filters" in f:
        return {**f, "filters": [_under(x, root) for x in f["filters"]]}
    return {**f, "filter": _under(f["filter"], root)}


def _wanted(source: dict, scope: Scope) -> Column:
    check_filter(source.get("filter"))
    events = source.get("events", "all")
    if events not in EVENTS:
        raise QueryError("unknown_events", str(events))
    out = F.col("table") == source["table"]
    if events != "all":
        out = out & (F.col("op") == events)
    if source.get("filter"):
        out = out & ((F.col("op") == "delete") | predicate(_under(source["filter"], "value"), scope, seen=True))
    return out


def matching(changes: DataFrame, spec: dict) -> DataFrame:
    """The change rows that a subscription delivers; works on batches and streams alike."""
    sources = spec["subscribe"]
    if not sources or len(sources) > MAX_SUBSCRIPTIONS:
        raise QueryError("bad_sources", str(len(sources)))
    scope = Scope(changes)
    rows = changes.where(reduce(lambda a, b: a | b, (_wanted(s, scope) for s in sources)))
    if spec.get("from_version") is not None:
        rows = rows.where(F.col("commit_version") >= spec["from_version"])
    mode = spec.get("deliver", "records")
    if isinstance(mode, dict) and set(mode) in ({"batch"}, {"call"}):
        mode = "records"
    if mode not in DELIVER:
        raise QueryError("unknown_deliver", str(mode))
    if mode == "keys":
        return rows.select("table", "op", "key", "commit_version")
    return rows.withColumn("value", F.when(F.col("op") != "delete", F.col("value")))


def change_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Change rows appended to a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def subscribe(changes: DataFrame, spec: dict, deliver: Callable[[DataFrame, int], None], checkpoint: str, initial: DataFrame | None = None, once: bool = False) -> StreamingQuery:
    """Start a subscription: ``deliver`` gets each batch of rows in version order.

    ``initial`` rows, if the subscription wants them, are delivered as batch -1.
    ``once`` takes what is there and stops.
    """
    if spec.get("initial") and initial is not None:
        deliver(matching(initial, spec).orderBy("commit_version", "key"), -1)

    def each(batch: DataFrame, number: int) -> None:
        deliver(batch.orderBy("commit_version", "key"), number)

    writer = matching(changes, spec).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def reacting(engine, spec: dict, answer: Callable[[dict, object], None]) -> Callable[[DataFrame, int], None]:
    """A delivery that runs the subscription's batch or procedure once per change row, in version order.

    ``{"deliver": {"batch": {"batch": .., "bind": ..}}}`` or ``{"call": {"call": .., "params": ..}}``. The row is bound
    to ``$event.table``, ``.op``, ``.key`` and ``.commit_version``; ``answer`` gets these and what came out. Rows are
    fetched a partition at a time: the calls run on the driver, one after another.
    """
    kind, entry = next(iter(spec["deliver"].items()))

    def deliver(batch: DataFrame, number: int) -> None:
        for row in batch.select("table", "op", "key", "commit_version").toLocalIterator():
            event = {f"$event.{k}": v for k, v in row.asDict().items()}
            bound = {**entry, "bind": {**entry.get("bind", {}), **event}} if kind == "batch" else entry
            done = engine.batch({"queries": {"_sub": bound}}, event)["results"]["_sub"]
            answer(row.asDict(), done.extra["value"])

    return deliver


def unsubscribe(query: StreamingQuery) -> None:
    """Stop a subscription; stopping it again does nothing."""
    if query.isActive:
        query.stop()


def windowed_counts(events: DataFrame, time_col: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per time window and keys, with a watermark for late rows."""
    window = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return events.withWatermark(time_col, late).groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", *keys, "n")


def sessions(events: DataFrame, time_col: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of rows at most ``gap`` apart per key."""
    return events.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n")).select("s.start", "s.end", *keys, "n")


def without_repeats(changes: DataFrame, time_col: str, late: str = "10 minutes") -> DataFrame:
    """Change rows once per table, key and version within the watermark."""
    return changes.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["table", "key", "commit_version"])
