"""Versioned tables: every commit is a folder of rows, numbered upward.

A table at ``path`` has one Parquet folder ``commit=<n>`` per commit, so a read
as of a version and the changes since one read only the folders they need. A
commit is written whole before it gets its number by one rename; of two writers
of a number one fails and can try again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import Scope, value, where
from ..plans.errors import QueryError
from . import schema, temporal

SYSTEM = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_version", T.LongType()), T.StructField("_ts", T.LongType()), T.StructField("_deleted", T.BooleanType())])

COMPUTED = "computed_value_failed"
ISOLATION = ("snapshot", "serializable")


def computed(v) -> bool:
    """Whether a value to write is a function call."""
    return isinstance(v, dict) and "$fn" in v


def refs(v) -> list:
    """The field paths that a value refers to."""
    if isinstance(v, dict):
        return [v["$ref"]] if "$ref" in v else [p for x in v.values() for p in refs(x)]
    return [p for x in v for p in refs(x)] if isinstance(v, list) else []


def failed(e: Exception) -> Exception:
    """A failed computed value as an error of the query's, any other error as it is."""
    text = str(e)
    if COMPUTED not in text or isinstance(e, QueryError):
        return e
    return QueryError(COMPUTED, text.split(COMPUTED + ": ", 1)[-1].split("\n")[0])


@dataclass
class ForeignKey:
    """A reference from a child table's field to a parent table's."""

    child: VersionedTable
    path: str
    parent: VersionedTable
    key: str
    on_delete: str = "restrict"


@dataclass
class VersionedTable:
    """A table with history. ``fields`` are its own columns; ``rules`` its declarative schema."""

    spark: SparkSession
    path: str
    fields: T.StructType
    rules: list[dict] = field(default_factory=list)
    parents: list[ForeignKey] = field(default_factory=list)
    children: list[ForeignKey] = field(default_factory=list)
    pending: list[DataFrame] | None = None
    base: int = 0
    touched: bool = False

    @property
    def full(self) -> T.StructType:
        return T.StructType([*self.fields.fields, *SYSTEM.fields])

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root, jvm

    def versions(self) -> list[int]:
        """The commits there are, ascending: one number each."""
        fs, root, _ = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        for name in names:
            if name.startswith("rewrite="):  # a rewrite that did not end
                self._replace(int(name[8:]))
                return self.versions()
        return sorted(int(n[7:]) for n in names if n.startswith("commit="))

    def _replace(self, top: int) -> None:
        """Put the folder ``rewrite=top`` in the place of all commits up to ``top``; may be done again from any point."""
        fs, root, jvm = self._fs()
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("commit=") and int(name[7:]) <= top:
                fs.delete(status.getPath(), True)
        fs.rename(jvm.org.apache.hadoop.fs.Path(f"{self.path}/rewrite={top}"), jvm.org.apache.hadoop.fs.Path(f"{self.path}/commit={top}"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def history(self, upto: int | None = None, since: int = 0) -> DataFrame:
        """All versioned rows of commits in (since, upto], and rows of the open transaction, which sees no commit after its begin."""
        if self.pending is not None:
            self.touched, upto = True, self.base if upto is None else min(upto, self.base)
        paths = [f"{self.path}/commit={v}" for v in self.versions() if v > since and (upto is None or v <= upto)]
        rows = self.spark.read.schema(self.full).parquet(*paths) if paths else self.spark.createDataFrame([], self.full)
        for more in self.pending or []:
            rows = rows.unionByName(more)
        return rows

    def latest(self) -> DataFrame:
        return temporal.latest(self.history())

    def as_of(self, at: dict) -> DataFrame:
        return temporal.as_of(self.history(at.get("version")), at)

    def changes_since(self, cursor: int) -> tuple[DataFrame, int | None]:
        """(key, op, commit_version, value...) of commits after a cursor, and the first version if older ones are gone."""
        known = self.versions()
        rows = self.history(since=cursor)
        out = rows.select(F.col("_id").alias("key"), F.when(F.col("_deleted"), F.lit("delete")).otherwise(F.lit("put")).alias("op"), F.col("_version").alias("commit_version"), F.struct(*(F.col(f"`{f.name}`") for f in self.fields.fields)).alias("value"))
        return out.orderBy("commit_version", "key"), known[0] if known and cursor < known[0] - 1 else None

    # -- writing

    def _commit(self, rows: DataFrame, now_ms: int) -> int:
        if self.pending is not None:
            staged = rows.withColumn("_version", F.lit(self.base + 1 + len(self.pending)).cast("bigint")).withColumn("_ts", F.lit(now_ms).cast("bigint"))
            self.pending.append(staged.select(*(F.col(f"`{n}`").cast(self.full[n].dataType).alias(n) for n in self.full.names)))
            return self.base + len(self.pending)
        number = self.version() + 1
        out = rows.withColumn("_version", F.lit(number).cast("bigint")).withColumn("_ts", F.lit(now_ms).cast("bigint"))
        fs, _, jvm = self._fs()
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        try:
            out.select(*(F.col(f"`{n}`").cast(self.full[n].dataType).alias(n) for n in self.full.names)).write.parquet(draft)
        except Exception as e:
            fs.delete(jvm.org.apache.hadoop.fs.Path(draft), True)
            raise failed(e) from e
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commit={number}")
        if fs.exists(target) or not fs.rename(jvm.org.apache.hadoop.fs.Path(draft), target):
            fs.delete(jvm.org.apache.hadoop.fs.Path(draft), True)
            raise QueryError("write_conflict", f"commit {number} exists")
        return number

    def _shaped(self, df: DataFrame) -> DataFrame:
        """Own columns in order, absent ones null."""
        return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.fields.fields), *(F.col(c) for c in ("_id", "_version") if c in df.columns))

    def _checked(self, rows: DataFrame, whole: Callable[[], DataFrame]) -> None:
        """Raise unless ``rows`` keep the rules and, within ``whole``, unique fields and foreign keys."""
        try:
            broken = schema.violations(rows, self.rules).limit(1).collect() if self.rules else []
        except Exception as e:
            raise failed(e) from e
        if broken:
            raise QueryError("schema_violation", f"{broken[0]['path']}: {broken[0]['code']}")
        for rule in self.rules:
            if rule.get("unique"):
                path = rule["path"] if isinstance(rule["path"], str) else rule["path"][0]
                if not schema.duplicates(whole(), path).isEmpty():
                    raise QueryError("unique_violation", path)
        for fk in self.parents:
            if not schema.orphans(rows, fk.path, fk.parent.latest(), fk.key).isEmpty():
                raise QueryError("foreign_key_missing", fk.path)

    def insert(self, rows: DataFrame, now_ms: int | None = None) -> DataFrame:
        """Add rows; ``_id`` is generated where it is not given. Returns the rows written."""
        now_ms = now_ms if now_ms is not None else int(time.time() * 1000)
        new_id = F.regexp_replace(F.uuid(), "-", "")
        rows = rows.withColumn("_id", F.coalesce(F.col("_id").cast("string"), new_id) if "_id" in rows.columns else new_id)
        rows = self._shaped(schema.with_defaults(rows, self.rules, now_ms))
        self._checked(rows, lambda: self.latest().drop("_version").unionByName(rows))
        number = self._commit(rows.withColumn("_deleted", F.lit(False)), now_ms)
        if self.pending is not None:
            return rows
        return self.spark.read.schema(self.full).parquet(f"{self.path}/commit={number}").drop("_ts", "_deleted")

    def _set(self, rows: DataFrame, values: dict, params: dict, lookup) -> DataFrame:
        scope = Scope(rows, params, lookup)
        unknown = [k for k in values if k not in self.fields.names]
        if unknown:
            raise QueryError("unknown_field", unknown[0])
        return rows.withColumns({k: self._computed(k, v, scope) for k, v in values.items()})

    def _computed(self, name: str, v, scope: Scope) -> Column:
        """A value to write; a function whose result is null ends the write, but for those made to give null."""
        made = value(v, scope).c.cast(self.fields[name].dataType)
        if not computed(v):
            return made
        call = v["$fn"] if isinstance(v["$fn"], str) else v["$fn"]["name"]
        if call.startswith("null/"):
            return made
        return F.coalesce(made, F.raise_error(F.lit(f"{COMPUTED}: {name}: {call}")).cast(self.fields[name].dataType))

    def insert_records(self, records: list[dict], params: dict | None = None, lookup=None, now_ms: int | None = None) -> DataFrame:
        """Insert records given as dictionaries; ``$fn`` fields are computed from the literal fields of their record."""
        kinds: dict[str, list[dict]] = {}
        for r in records:
            kinds.setdefault(json.dumps({k: v for k, v in r.items() if computed(v)}, sort_keys=True, default=str), []).append(r)
        names = (*self.fields.names, "_id")
        shape, parts = T.StructType([*self.fields.fields, self.full["_id"]]), []
        for like in kinds.values():
            made = {k: v for k, v in like[0].items() if computed(v)}
            unknown = [k for k in made if k not in self.fields.names]
            if unknown:
                raise QueryError("unknown_field", unknown[0])
            plain = self.spark.createDataFrame([tuple(None if n in made else r.get(n) for n in names) for r in like], shape)
            known = plain.drop(*made)
            scope = Scope(known, params or {}, lookup)
            for k, v in made.items():
                for path in refs(v):
                    if (path if isinstance(path, str) else path[0]) not in like[0]:
                        raise QueryError(COMPUTED, f"{k}: {path}")
            parts.append(known.withColumns({k: self._computed(k, v, scope) for k, v in made.items()}).select(*(F.col(f"`{n}`") for n in names)))
        rows = parts[0] if parts else self.spark.createDataFrame([], shape)
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return self.insert(rows, now_ms)

    def update(self, condition: dict | None, values: dict, expected_version: int | None = None, params: dict | None = None, lookup=None, now_ms: int | None = None) -> dict[str, DataFrame]:
        """Write new versions of the matching rows; returns the rows ``changed`` and ``unchanged`` by it."""
        now_ms = now_ms if now_ms is not None else int(time.time() * 1000)
        current = self.latest()
        hit = where(current, condition, Scope(None, params or {}, lookup))
        if expected_version is not None and not hit.where(F.col("_version") != expected_version).isEmpty():
            raise QueryError("version_conflict", str(expected_version))
        new = self._set(hit, values, params or {}, lookup)
        new = schema.with_defaults(new, [r for r in self.rules if r.get("auto_now")], now_ms, insert=False)
        differs = F.lit(False)
        old = {k: F.col(f"o.`{k}`") for k in values}
        both = new.alias("n").join(hit.select("_id", *(F.col(f"`{k}`") for k in values)).alias("o"), "_id")
        for k in values:
            differs = differs | ~F.col(f"n.`{k}`").eqNullSafe(old[k])
        changed = both.where(differs).select("n.*")
        self._checked(changed, lambda: current.join(changed.select("_id"), "_id", "left_anti").unionByName(changed))
        self._commit(self._shaped(changed).withColumn("_deleted", F.lit(False)), now_ms)
        same = both.where(~differs).select("n.*")
        return {"changed": changed, "unchanged": same, "all": new}

    def upsert(self, key: dict, values: dict, params: dict | None = None, lookup=None, now_ms: int | None = None) -> None:
        """Merge ``values`` into the rows that match ``key``, or insert both as one row."""
        condition = {"op": "and", "filters": [{"op": "eq", "field": [k], "value": v} for k, v in key.items()]}
        hit = where(self.latest(), condition, Scope(None, params or {}, lookup))
        if hit.isEmpty():
            row = {**key, **values}
            scope = Scope(None, params or {}, lookup)
            self.insert(self.spark.range(1).select(*(value(v, scope).c.cast(self.fields[k].dataType).alias(k) for k, v in row.items() if k in self.fields.names)), now_ms)
        else:
            self.update(condition, values, params=params, lookup=lookup, now_ms=now_ms)

    def delete(self, condition: dict, expected_version: int | None = None, params: dict | None = None, lookup=None, now_ms: int | None = None) -> DataFrame:
        """Write tombstones for the matching rows, after what the foreign keys ask for; returns the rows deleted."""
        if condition is None:
            raise QueryError("where_required", "delete needs a filter")
        now_ms = now_ms if now_ms is not None else int(time.time() * 1000)
        hit = where(self.latest(), condition, Scope(None, params or {}, lookup))
        if expected_version is not None and not hit.where(F.col("_version") != expected_version).isEmpty():
            raise QueryError("version_conflict", str(expected_version))
        for fk in self.children:
            gone, nulled = schema.on_parent_delete(fk.child.latest(), fk.path, hit, fk.key, fk.on_delete)
            if gone is not None:
                fk.child._commit(fk.child._shaped(gone).withColumn("_deleted", F.lit(True)), now_ms)
            if nulled is not None:
                fk.child._commit(fk.child._shaped(nulled).withColumn("_deleted", F.lit(False)), now_ms)
        self._commit(self._shaped(hit).withColumn("_deleted", F.lit(True)), now_ms)
        return hit

    def rewrite(self, kept: DataFrame) -> None:
        """Replace the history by ``kept`` rows of it, as one folder under the newest number (retention, purge).

        The rows are complete under a name of their own before anything is deleted; whoever
        reads the table next finishes a rewrite that was cut off.
        """
        fs, _, jvm = self._fs()
        top = self.version()
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        kept.select(*self.full.names).write.parquet(draft)
        fs.rename(jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(f"{self.path}/rewrite={top}"))
        self._replace(top)

    # -- transactions

    def begin(self) -> None:
        """Writes from now on are seen by this table's reads and written together by ``commit``; commits of others are not seen."""
        self.pending, self.base, self.touched = [], self.version(), False

    def validate(self, isolation: str = "snapshot") -> None:
        """Raise for a serializable transaction that has read this table if others have committed to it since.

        Tables are compared as a whole: a commit to rows that were not read is a conflict too.
        Under ``snapshot`` the last writer wins.
        """
        if isolation not in ISOLATION:
            raise QueryError("unknown_isolation", str(isolation))
        if isolation == "serializable" and self.touched and self.version() > self.base:
            raise QueryError("transaction_conflict", self.path)

    def commit(self, now_ms: int | None = None) -> int:
        staged, self.pending = self.pending or [], None
        if not staged:
            return self.version()
        rows = staged[0]
        for more in staged[1:]:
            rows = rows.unionByName(more)
        newest = rows.groupBy("_id").agg(F.max_by(F.struct(*rows.columns), "_version").alias("r")).select("r.*")
        return self._commit(newest.drop("_version", "_ts"), now_ms if now_ms is not None else int(time.time() * 1000))

    def rollback(self) -> None:
        self.pending = None
