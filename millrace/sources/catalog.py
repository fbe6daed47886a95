"""Tables by name, and the engine that runs queries and batches on them."""

from __future__ import annotations

import itertools
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import Fn
from ..operators import aggregates, read, temporal, vector
from ..operators.read import Result
from ..operators.vector_index import CELL, CODE, VectorIndex
from ..operators.writes import VersionedTable
from ..plans import explain
from ..plans.errors import QueryError

DEFAULT_REPO = "main"


@dataclass
class Table:
    """A named table: a frame or a versioned table, its id column, and indexes as metadata for EXPLAIN."""

    source: DataFrame | VersionedTable
    id_col: str = "_id"
    indexes: dict[str, dict] = field(default_factory=dict)

    def rows(self) -> DataFrame:
        return self.source.latest() if isinstance(self.source, VersionedTable) else self.source


@dataclass
class Cursor:
    """An open cursor: what is left of its rows, its page size, and when it was last used."""

    rows: Iterator[Row]
    page_size: int
    seen: float = field(default_factory=time.monotonic)


class Engine:
    """Runs read queries (``read``) and batches (``batch``) given as nested dictionaries."""

    def __init__(self, spark: SparkSession, limits: dict | None = None):
        """``limits``: those of all batches that do not set their own."""
        self.spark, self.limits = spark, dict(limits or {})
        self.cursors: dict[str, Cursor] = {}
        self.tables: dict[tuple[str, str], Table] = {}
        self.procedures: dict[str, Callable] = {}

    # -- tables

    def register(self, name: str, source: DataFrame | VersionedTable, repo: str = DEFAULT_REPO, id_col: str = "_id", indexes: dict | None = None) -> Table:
        table = self.tables[repo, name] = Table(source, id_col, dict(indexes or {}))
        return table

    def register_files(self, name: str, path: str, kind: str = "parquet", repo: str = DEFAULT_REPO, id_col: str = "_id", **options) -> Table:
        """A table over Parquet, JSON, ORC, Avro or CSV files."""
        return self.register(name, self.spark.read.format(kind).options(**options).load(path), repo, id_col)

    def create_index(self, table: str | list, name: str, kind: str, fields: list[str], include: list[str] | None = None, scalar: str | None = None) -> None:
        """Indexes are metadata: Parquet statistics and column pruning do their work; EXPLAIN names them.

        A functional index on a ``scalar`` needs a pure one.
        """
        if scalar is not None and not (scalar in scalars.REGISTRY and scalars.REGISTRY[scalar].pure):
            raise QueryError("not_pure", scalar)
        self.table(table).indexes[name] = {"kind": kind, "fields": fields, "include": include or []}

    def create_vector_index(self, table: str | list, name: str, field: str, path: str, metric: str = "l2", cells: int | None = None) -> VectorIndex:
        """Write an approximate index of a table's vectors as they are now; searches that name ``probes`` read it."""
        known = self.table(table)
        index = VectorIndex.build(known.rows(), path, field, known.id_col, metric, cells)
        known.indexes[name] = {"kind": "vector", "fields": [field], "include": [], "index": index}
        return index

    def drop_index(self, table: str | list, name: str) -> None:
        self.table(table).indexes.pop(name, None)

    def drop(self, ref: str | list) -> None:
        self.tables.pop(self._key(ref), None)

    def rename(self, ref: str | list, name: str) -> None:
        """Give a table another name in its repository."""
        repo, old = self._key(ref)
        table = self.table(ref)
        if (repo, name) in self.tables:
            raise QueryError("table_exists", name)
        self.tables[repo, name] = table
        del self.tables[repo, old]

    def describe(self, ref: str | list) -> dict:
        """A table's columns, id, indexes and, if it has history, its rules, references and newest version."""
        table = self.table(ref)
        out = {"name": self._key(ref)[1], "id": table.id_col, "indexes": {n: {k: v for k, v in x.items() if k != "index"} for n, x in table.indexes.items()}}
        if isinstance(table.source, VersionedTable):
            keys = [{"path": k.path, "key": k.key, "on_delete": k.on_delete} for k in table.source.parents]
            return {**out, "columns": {f.name: f.dataType.simpleString() for f in table.source.fields.fields}, "rules": list(table.source.rules), "foreign_keys": keys, "version": table.source.version()}
        return {**out, "columns": dict(table.source.dtypes)}

    def list_tables(self, repo: str = DEFAULT_REPO) -> list[str]:
        return sorted(n for r, n in self.tables if r == repo)

    @staticmethod
    def _key(ref: str | list) -> tuple[str, str]:
        return (DEFAULT_REPO, ref) if isinstance(ref, str) else (ref[0], ref[1])

    def table(self, ref: str | list) -> Table:
        try:
            return self.tables[self._key(ref)]
        except KeyError:
            raise QueryError("unknown_table", str(ref)) from None

    # -- functions

    def register_scalar(self, name: str, build: Callable, low: int, high: int | None = -1, pure: bool = True) -> None:
        """A scalar of the user's: ``build`` maps argument columns to a column (an expression or a UDF)."""
        scalars.REGISTRY[name] = Fn(low, low if high == -1 else high, lambda *a: build(*(x.c for x in a)), pure)

    def register_aggregate(self, name: str, build: Callable) -> None:
        """An aggregate of the user's: ``build`` maps the input column and literal arguments to an aggregate
        (an expression or a grouped-aggregate pandas UDF)."""
        aggregates.LIBRARY[name] = lambda v, distinct, *args: build(v.c, *args)

    def register_procedure(self, name: str, call: Callable) -> None:
        """A callable (engine, params) for batch entries of kind call."""
        self.procedures[name] = call

    # -- reads

    def source(self, spec: dict, params: dict | None = None, lookup=None) -> tuple[DataFrame, dict]:
        """The rows a read starts from, and the read that is left to do."""
        table, when = self.table(spec["from"]), spec.get("temporal") or {"kind": "latest"}
        kind = when.get("kind", "latest")
        if kind == "latest":
            similar, _ = vector.split(spec.get("where"))
            return (self._probed(table, similar) if similar and similar.get("probes") else table.rows()), spec
        if not isinstance(table.source, VersionedTable):
            raise QueryError("no_history", str(spec["from"]))
        if kind == "as_of":
            return table.source.as_of(when["at"]), spec
        if kind == "history":
            rows = temporal.timeline(table.source.history(), spec.get("where"), when, params, lookup)
            return rows, {**spec, "where": None}
        raise QueryError("unknown_temporal", kind)

    @staticmethod
    def _probed(table: Table, similar: dict) -> DataFrame:
        """The rows of the cells that a search asks for."""
        wanted, metric = similar["field"] if isinstance(similar["field"], list) else [similar["field"]], similar.get("metric", "l2")
        for known in table.indexes.values():
            index = known.get("index")
            if index is not None and known["fields"] == wanted and index.metric == metric:
                return index.near(similar["query"], int(similar["probes"])).drop(CELL, CODE)
        raise QueryError("no_vector_index", ".".join(wanted))

    def read(self, spec: dict, params: dict | None = None, lookup=None) -> Result:
        """One read. With ``explain`` there are no rows, only the plan."""
        rows, left = self.source(spec, params, lookup)
        id_col = self.table(spec["from"]).id_col
        result = read.run(rows, left, params, lookup, id_col)
        if spec.get("explain"):
            result.plan = explain.explain(spec, self.table(spec["from"]).indexes, result.df)
            result.df = result.df.limit(0)
        return result

    def batch(self, request: dict, params: dict | None = None) -> dict:
        """A batch of dependent queries."""
        from ..operators.batch import run_batch

        return run_batch(self, request, params or {})

    def open_cursor(self, spec: dict, page_size: int = 1000, idle_seconds: float = 300) -> tuple[str, list[Row], bool]:
        """Start a cursor: its id, the first page, and whether more may follow. It closes itself when read to its end.

        Rows come partition by partition, so that the driver holds a page and a partition.
        Whoever comes next closes cursors left alone for ``idle_seconds``.
        """
        if (spec.get("temporal") or {}).get("kind", "latest") == "as_of":
            raise QueryError("cursor_unsupported", "as_of")
        for key in [k for k, c in self.cursors.items() if time.monotonic() - c.seen > idle_seconds]:
            self.cancel(key)
        key = uuid.uuid4().hex
        self.cursors[key] = Cursor(iter(self.read(spec).df.toLocalIterator()), page_size)
        return key, *self.fetch(key)

    def fetch(self, cursor: str, page_size: int | None = None) -> tuple[list[Row], bool]:
        """A cursor's next page, and whether more may follow."""
        if cursor not in self.cursors:
            raise QueryError("unknown_cursor", cursor)
        state = self.cursors[cursor]
        size = state.page_size if page_size is None else page_size
        if size < 1:
            raise QueryError("bad_page_size", str(size))
        state.seen = time.monotonic()
        page = list(itertools.islice(state.rows, size))
        if len(page) < size:
            self.cancel(cursor)
        return page, cursor in self.cursors

    def cancel(self, cursor: str) -> None:
        """Close a cursor; closing one that is not open does nothing."""
        state = self.cursors.pop(cursor, None)
        if state is not None and hasattr(state.rows, "close"):
            state.rows.close()

    def cursor(self, spec: dict, size: int = 1000) -> Iterator[list]:
        """A read's rows in lists of ``size``, fetched partition by partition."""
        held = []
        for row in self.read(spec).df.toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    def count(self, ref: str | list) -> DataFrame:
        """COUNT(*) without a filter: Parquet answers from its footers."""
        return self.table(ref).rows().agg(F.count(F.lit(1)).alias("count"))

    def extremes(self, ref: str | list, column: str) -> DataFrame:
        """MIN and MAX of a column."""
        return self.table(ref).rows().agg(F.min(column).alias("min"), F.max(column).alias("max"))
