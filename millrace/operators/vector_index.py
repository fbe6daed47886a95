"""Approximate nearest neighbours: rows by cell, with 8-bit codes.

Cells are the nearest of a number of centres, fitted on a bounded sample; every
row with a vector is indexed. A search reads the folders of the cells nearest
to its vector (``probes``: more cells, better recall, all cells: exact), ranks
their rows by codes of one byte a dimension, and decides among the best by the
vectors themselves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import QueryError
from .vector import MAX_K, METRICS, TINY, distance

CELL, CODE = "_cell", "_code"
LEVELS = 255
MAX_CELLS = 4096
#: Rows that the centres are fitted on, at most, and turns of fitting.
FIT_ROWS, FIT_TURNS = 20_000, 12
#: Writers of a cell: a cell may hold a third of all rows.
SPREAD = 8
#: Rows per result row that the codes leave to the exact distances.
REFINE = 10


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), TINY)


def _nearest_centre(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * v @ centres.T, axis=1)


def fitted(sample: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Centres by Lloyd's algorithm; a centre without rows moves to a row of the sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(FIT_TURNS):
        own = _nearest_centre(sample, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        empty = count == 0
        total[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centres = total / np.maximum(count, 1)[:, None]
    return centres


@dataclass
class VectorIndex:
    """An index written at ``path``: ``rows`` by cell, and a text file of centres and scales."""

    spark: SparkSession
    path: str
    field: str
    id_col: str
    metric: str
    centres: np.ndarray
    low: np.ndarray
    step: np.ndarray
    schema: T.StructType

    @classmethod
    def build(cls, df: DataFrame, path: str, field: str, id_col: str = "_id", metric: str = "l2", cells: int | None = None, fit_rows: int = FIT_ROWS) -> VectorIndex:
        """Index all rows of ``df`` with a vector. ``cells``: by default the square root of the rows, ``MAX_CELLS`` at most."""
        if metric not in METRICS:
            raise QueryError("unknown_metric", metric)
        if not isinstance(df.schema[field].dataType, T.ArrayType):
            raise QueryError("not_a_vector", field)
        v = F.col(f"`{field}`").cast("array<double>")
        rows = df.where(F.col(f"`{field}`").isNotNull())
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(v)).alias("least"), F.max(F.size(v)).alias("dim")).first()
        if seen["n"] and (seen["least"] != seen["dim"] or not seen["dim"]):
            raise QueryError("several_dimensions", field)
        spark, dim = df.sparkSession, seen["dim"] or 0
        ends = rows.select(F.posexplode(v).alias("i", "x")).groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("i").collect()  # a row a dimension
        low = np.array([r["low"] for r in ends], dtype=float)
        step = np.array([(r["high"] - r["low"]) / LEVELS or 1.0 for r in ends], dtype=float)
        # Of more rows than that, nine tenths on average, so that the limit cuts off no part of the table.
        share = 1.0 if seen["n"] <= fit_rows else 0.9 * fit_rows / seen["n"]
        sample = rows.select(v.alias("v")).sample(share, seed=7).limit(fit_rows).collect()
        if not sample and seen["n"]:
            sample = rows.select(v.alias("v")).limit(fit_rows).collect()
        known = np.array([r["v"] for r in sample], dtype=float).reshape(len(sample), dim)
        unit = metric == "cosine"
        count = min(MAX_CELLS, cells or max(1, int(seen["n"] ** 0.5)))
        centres = fitted(_unit(known) if unit else known, count) if len(known) else np.zeros((0, dim))

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.array(batch.column(field).cast(pa.list_(pa.float64())).flatten()).reshape(batch.num_rows, dim)
                own = _nearest_centre(_unit(x) if unit else x, centres).astype(np.int32)
                codes = np.clip(np.rint((x - low) / step), 0, LEVELS).astype(np.int16)
                lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, dim, dtype=np.int32), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), lists], [*batch.schema.names, CELL, CODE])

        shape = T.StructType([*rows.schema.fields, T.StructField(CELL, T.IntegerType()), T.StructField(CODE, T.ArrayType(T.ShortType()))])
        if any(c in df.columns for c in (CELL, CODE)):
            raise QueryError("reserved_name", CELL)
        out = rows.mapInArrow(placed, shape) if seen["n"] else spark.createDataFrame([], shape)
        salt = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(SPREAD))
        out.repartition(F.col(CELL), salt).write.partitionBy(CELL).parquet(f"{path}/rows")
        meta = {"field": field, "id_col": id_col, "metric": metric, "centres": centres.tolist(), "low": low.tolist(), "step": step.tolist(), "schema": shape.json()}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        shape = T.StructType.fromJson(json.loads(meta["schema"]))
        return cls(spark, path, meta["field"], meta["id_col"], meta["metric"], np.array(meta["centres"]), np.array(meta["low"]), np.array(meta["step"]), shape)

    def cells(self, query: list[float], probes: int) -> list[int]:
        """The cells nearest to a vector."""
        if not len(self.centres):
            return []
        q = np.array(query, dtype=float)
        if len(q) != self.centres.shape[1]:
            raise QueryError("wrong_dimension", str(len(q)))
        if self.metric == "dot":
            far = -self.centres @ q
        else:
            far = ((self.centres - (_unit(q) if self.metric == "cosine" else q)) ** 2).sum(1)
        return [int(c) for c in np.argsort(far, kind="stable")[: max(1, probes)]]

    def near(self, query: list[float], probes: int) -> DataFrame:
        """The rows of the cells nearest to a vector, with their codes; other cells' folders are not read."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").where(F.col(CELL).isin(self.cells(query, probes)))

    def decoded(self) -> Column:
        """The vector that a row's code stands for."""
        scale = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(self.low, self.step, strict=True)))
        return F.zip_with(F.col(CODE), scale, lambda c, s: s["a"] + c * s["b"])

    def search(self, query: list[float], k: int, probes: int = 8, refine: int = REFINE, name: str = "_distance") -> DataFrame:
        """The k rows nearest to a vector among the cells probed, nearest first, ties by id.

        Codes choose ``refine * k`` rows, whose ids are the only thing that goes to all tasks.
        """
        k = min(int(k), MAX_K)
        rows, key = self.near(query, probes), f"`{self.id_col}`"
        if not len(self.centres):
            return rows.drop(CELL, CODE).withColumn(name, F.lit(0.0)).limit(0)
        best = rows.select(F.col(key), distance(self.decoded(), query, self.metric).alias(name)).orderBy(name, F.col(key)).limit(k * max(1, refine))
        exact = rows.join(F.broadcast(best.select(F.col(key)).distinct()), self.id_col, "left_semi").drop(CELL, CODE)
        return exact.withColumn(name, distance(F.col(f"`{self.field}`"), query, self.metric)).orderBy(name, F.col(key)).limit(k)
