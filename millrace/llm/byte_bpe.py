"""Byte-level BPE encoding and decoding with a local rank file.

Texts are encoded with the tiktoken library. Texts over ``piece_chars`` are
cut at safe boundaries (``safe_split``), and long runs of spaces, which the
library's pattern engine cannot walk through, are encoded as the single match
that they are. Decoding joins the raw bytes of the ids; it never goes through
a string, so ids that split a character decode exactly.

Defined results: null and empty texts give no ids and decode to no bytes; null
ids are kept; repeated rows are encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .safe_split import pieces, space_runs

PIECE_CHARS = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = read_ranks(path)
        self.library = tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token

    def encode(self, text: str, piece_chars: int = PIECE_CHARS) -> list[int]:
        if len(text) <= 1_000:
            return self.library.encode_ordinary(text)
        ids: list[int] = []
        for is_run, part in space_runs(text):
            if is_run:
                ids += self.library._encode_single_piece(part)
            else:
                for piece in pieces(part, piece_chars):
                    ids += self.library.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and rank file."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id and ``ids``, an array of int. No shuffle."""
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = cut.schema["id"].dataType.simpleString()
    return cut.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of ``encoded``: its id and ``decoded``, the raw bytes of its ids. No shuffle."""
    cut = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            data = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["id", "decoded"])

    kind = cut.schema["id"].dataType.simpleString()
    return cut.mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (ids as little-endian uint32) and decoded_sha256, encoded and decoded in one pass.

    Only digests leave the worker, so a row's size does not depend on its text's.
    """
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                rows.append((len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = cut.schema["id"].dataType.simpleString()
    return cut.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
