"""Token counts: batches of texts through a tokenizer in Arrow functions, lengths only.

The ids never leave the worker. Batches are cut by bytes, so a batch of long
texts needs no more memory than one of short texts, and texts over
``piece_chars`` are cut at safe boundaries (``safe_split``).

With a byte-level BPE no merge crosses a match of the splitting pattern, so a
text's count is the sum over its matches. Each worker keeps the counts of the
matches it has met (at most ``CACHE`` of them; the memo only saves time) and
sends only new ones to the library. Texts with characters outside the plain
ranges below, where the library's own character tables could differ from this
module's, go to the library as they are.

Defined results: null or empty text has 0 bytes and 0 tokens; rows, repeated
or not, are counted one by one; null ids are kept.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .safe_split import pieces, space_runs

BATCH_BYTES = 4_000_000
PIECE_CHARS = 100_000
CACHE = 300_000

_UNUSUAL = regex.compile(r"[^\x00-\x7f\xa1-\xac\xae-ɏ‐-‧‰-⁞₠-₿←-⇿]")


def byte_batches(texts: list[str], limit: int) -> Iterator[list[str]]:
    """Consecutive runs of ``texts`` of at most ``limit`` characters, or of one text."""
    batch, held = [], 0
    for text in texts:
        if batch and held + len(text) > limit:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += len(text)
    if batch:
        yield batch


class _ByteLevel:
    """Counter for a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.findall = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def _learn(self, words: set[str]) -> dict[str, int]:
        fresh = list(words)
        lengths = {}
        for batch in byte_batches(fresh, 1_000_000):
            lengths.update(zip(batch, (len(e) for e in self.library.encode_batch_fast(batch, add_special_tokens=False)), strict=True))
        return lengths

    def _plain(self, text: str) -> int:
        """A text without special strings and unusual characters."""
        total = 0
        for is_run, part in space_runs(text):
            words = [part] if is_run else self.findall(part)
            fresh = {w for w in words if w not in self.known}
            extra = self._learn(fresh) if fresh else {}
            if extra and len(self.known) + len(extra) <= CACHE:
                self.known.update(extra)
                extra = {}
            get = self.known.get
            total += sum(get(w) or extra[w] for w in words) if extra else sum(map(self.known.__getitem__, words))
        return total

    def count(self, text: str, piece_chars: int) -> int:
        if not text:
            return 0
        parts, specials = [text], 0
        if self.special_re is not None and any(s in text for s in self.special):
            parts = self.special_re.split(text)
            specials = len(parts) - 1
        total = specials
        for part in parts:
            for piece in pieces(part, piece_chars) if part else ():
                if _UNUSUAL.search(piece):
                    for is_run, x in space_runs(piece):
                        total += len(self.library.encode(x, add_special_tokens=False))
                else:
                    total += self._plain(piece)
        return total


class _Json:
    """Counter for any other file of the ``tokenizers`` library: whole texts, as its own rules may reach across spaces."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)

    def count(self, text: str, piece_chars: int) -> int:
        return len(self.library.encode(text, add_special_tokens=False)) if text else 0


class _Piece:
    """Counter for a ``sentencepiece`` model: whole texts, as its normaliser joins spaces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)

    def count(self, text: str, piece_chars: int) -> int:
        return len(self.library.encode(text, num_threads=1)) if text else 0


@lru_cache(maxsize=2)
def counter(path: str, pattern: str | None):
    """The counter for a vocabulary file, one per worker; ``pattern`` marks a byte-level BPE."""
    if path.endswith(".model"):
        return _Piece(path)
    return _ByteLevel(path, pattern) if pattern else _Json(path)


def counting(path: str, pattern: str | None, piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES) -> Callable:
    """A ``mapInArrow`` function over (..., text) batches that adds n_bytes and n_tokens and drops text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern).count
        for batch in batches:
            at = batch.schema.get_field_index("text")
            start = 0
            sizes = [n or 0 for n in pa.compute.binary_length(batch.column(at)).to_pylist()]
            while start < batch.num_rows:
                end, held = start, 0
                while end < batch.num_rows and (end == start or held + sizes[end] <= batch_bytes):
                    held += sizes[end]
                    end += 1
                part = batch.slice(start, end - start)
                lengths = [count(t or "", piece_chars) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(part.num_columns) if i != at] + [pa.array(sizes[start:end], pa.int64()), pa.array(lengths, pa.int64())],
                    names=[n for n in part.schema.names if n != "text"] + ["n_bytes", "n_tokens"],
                )
                start = end

    return run


def token_counts(docs: DataFrame, path: str, pattern: str | None, id_col: str = "doc_id", text_col: str = "text", token_limit: int = 512) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_tokens, over_limit. No shuffle; one pass over the text."""
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = cut.schema["id"].dataType.simpleString()
    counted = cut.mapInArrow(counting(path, pattern), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > token_limit).alias("over_limit"))
