"""Rounds of questions from chunks of a corpus to buckets of fingerprints, and back.

The corpus is packed into chunks of a few MB, runs of rows as they lie in the
input's partitions, each one compressed row. In a round every chunk sends its
distinct values, sorted and packed, to the buckets that own them; a bucket
compares what all chunks sent and answers each of them. A very common passage
reaches its bucket once for every chunk, not once for every place, and copies
of one document, or repeats of one row, lie in as many chunks as their bytes
need: no task gets more than its share of a hot group, and no pair is ever
written out.

All rounds and the last step are one lazy plan whose exchange of the corpus
Spark reuses: nothing is collected and a lost executor costs only the parts it
held. What a chunk must remember from one round to the next travels with the
plan as a row of its own, so no round is computed twice.

Chunks are named by partition and place, which must not change when a lost task
runs again. A plan that reads files in order has such partitions; any other is
written first (``repeatable``).

A (chunk, bucket) pair is one shuffled row. Chunks and buckets never get
smaller than the square root of the corpus's bytes times ``PAIR_BYTES``, so the
number of such rows grows with the corpus, not with its square: 450 MB each at
100 TB. Memory for one of them is the bound on a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import repeatable

CHUNK = "chunk long, blob binary"
SENT = "bucket long, chunk long, blob binary"
#: Compression of a chunk's rows: a tenth smaller than at level 1, for little more time.
LEVEL = 3
#: Bytes of text for each (chunk, bucket) pair, at least.
PAIR_BYTES = 2_000

#: (answers by bucket, what the chunk remembered) -> (what it asks each bucket, what it remembers); the chunk's rows come first.
Question = Callable[[pa.Table, dict[int, bytes], bytes | None], tuple[list[tuple[int, bytes]], bytes | None]]


@dataclass(frozen=True)
class Layout:
    """How a corpus is dealt out: sizes follow from its bytes."""

    total_bytes: int
    chunk_bytes: int
    buckets: int

    @property
    def filter_bits(self) -> int:
        """Bits of a fingerprint that only filters: about one false hit in 1,000 or fewer at any size."""
        return min(60, max(32, self.total_bytes.bit_length() + 10))


def layout(docs: DataFrame, text_col: str, chunk_bytes: int, bucket_bytes: int) -> Layout:
    """Measures the text (one row comes back) and picks the sizes of chunks and buckets."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    least = isqrt(total * PAIR_BYTES)
    return Layout(total, max(chunk_bytes, least), max(1, -(-total // max(bucket_bytes, least))))


def _packed(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flushed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | nth], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "blob"])

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                end = min(batch.num_rows, int(np.searchsorted(ends, before + limit - size)) + 1)
                held.append(batch.slice(start, end - start))
                size += int(ends[end - 1]) - before
                start = end
                if size >= limit:
                    yield flushed()
                    nth, held, size = nth + 1, [], 0
        if held:
            yield flushed()

    return run


def chunked(docs: DataFrame, id_col: str, text_col: str, plan: Layout, **more: Column) -> DataFrame:
    """(chunk, blob), one exchange; a blob opens as (id, text, ...)."""
    cut = repeatable(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(c.alias(k) for k, c in more.items())))
    return cut.mapInArrow(_packed(plan.chunk_bytes), CHUNK).repartition(max(1, plan.total_bytes // plan.chunk_bytes // 2), "chunk")


def _opened(rows: pa.Table) -> pa.Table:
    return pa.ipc.open_stream(rows.column("blob")[0].as_buffer()).read_all()


def _sent(chunk: int, found: list[tuple[int, bytes]], state: bytes | None) -> pa.Table:
    found = found + [(-1 - chunk, state)] if state is not None else found  # a bucket of its own, for the chunk's memory
    return pa.table({"bucket": pa.array([b for b, _ in found], pa.int64()), "chunk": pa.array([chunk] * len(found), pa.int64()), "blob": pa.array([x for _, x in found], pa.binary())})


def _heard(said: pa.Table) -> tuple[dict[int, bytes], bytes | None]:
    """Answers by bucket in the buckets' order, and the chunk's memory."""
    by = dict(sorted(zip(said.column("bucket").to_pylist(), said.column("blob").to_pylist(), strict=True)))
    state = next((x for b, x in by.items() if b < 0), None)
    return {b: x for b, x in by.items() if b >= 0}, state


def ask(corpus: DataFrame, question: Question, answers: DataFrame | None = None) -> DataFrame:
    """Each chunk's question, given its rows, the answers to its last one and its memory."""
    if answers is None:

        def alone(key, rows):
            return _sent(key[0].as_py(), *question(_opened(rows), {}, None))

        return corpus.groupBy("chunk").applyInArrow(alone, SENT)

    def after(key, rows, said):
        return _sent(key[0].as_py(), *question(_opened(rows), *_heard(said)))

    return corpus.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(after, SENT)


def answer(sent: DataFrame, resolve: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """Each bucket's answer to every chunk that asked: ``resolve`` maps their packed values to packed answers or None."""

    def run(key, rows):
        if key[0].as_py() < 0:
            return rows.select(["bucket", "chunk", "blob"])
        blobs = resolve(rows.column("blob").to_pylist())
        kept = pa.array([x is not None for x in blobs], pa.bool_())
        return pa.table({"bucket": rows.column("bucket"), "chunk": rows.column("chunk"), "blob": pa.array(blobs, pa.binary())}).filter(kept)

    return sent.groupBy("bucket").applyInArrow(run, SENT)


def finish(corpus: DataFrame, answers: DataFrame, last: Callable[[pa.Table, dict[int, bytes], bytes | None], pa.Table], schema: str) -> DataFrame:
    """The last step: each chunk's rows with its answers and its memory."""

    def run(_, rows, said):
        return last(_opened(rows), *_heard(said))

    return corpus.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
