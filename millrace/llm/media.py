"""Binary columns stored as media members of archives, and a Spark data source that reads them.

A payload is stored losslessly as the samples of an 8-bit greyscale PNG of
``WIDTH`` columns. Members lie end to end in archive files, each followed by
its directory: member offsets, sizes, checksums, ids and lengths, then a
footer. The ``millrace-media`` source reads only directories to plan; its
partitions are byte ranges of archives, a member belongs to the range in which
it starts, and its bytes go to Spark in Arrow batches bounded by bytes. A
member that fails to read or to verify is read again by its own offset, a few
times, without the rest of its range; then the task fails and Spark retries it.

Writers write to names of their own and only archives that a finished task has
reported are listed in the archive folder's manifest, so a lost or repeated
task leaves nothing that is read.

Defined results: null and empty texts are payloads of ``WIDTH`` zero bytes; ids
may be null or repeat; every row is a member of its own.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..sources.folders import new_path

WIDTH = 64
MAGIC = b"MEDARCH1"
DIRECTORY = np.dtype([("offset", "<i8"), ("size", "<i8"), ("crc", "<u4"), ("has_id", "u1"), ("id", "<i8"), ("n_bytes", "<i8")])
ARCHIVE_BYTES = 64_000_000
RANGE_BYTES = 64_000_000
BATCH_BYTES = 4_000_000
ATTEMPTS = 4
PNG = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    """``data`` and zero bytes up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def _png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit greyscale PNG whose samples are ``payload``, a positive multiple of ``width`` bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)  # a filter byte of 0 before each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return PNG + _png_chunk(b"IHDR", head) + _png_chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _png_chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples of a PNG written by ``encode_png``, as rows."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, width, data = 8, 0, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        if kind == b"IHDR":
            width = struct.unpack_from(">I", media, at + 8)[0]
        elif kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += size + 12
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if raw[:, 0].any():
        raise ValueError("a row is filtered")
    return raw[:, 1:]


def feature(samples: np.ndarray) -> str:
    """An average hash: an 8 x 8 grid of mean samples against their median, as 16 hex digits, and the overall mean."""
    rows = np.array_split(np.arange(len(samples)), 8) if len(samples) >= 8 else [np.arange(len(samples))] * 8
    grid = np.array([samples[r].reshape(len(r), 8, -1).mean(axis=(0, 2)) for r in rows])
    bits = np.packbits((grid > np.median(grid)).reshape(-1)).tobytes()
    return f"{bits.hex()}:{samples.mean(dtype=np.float64):.3f}"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Writer:
    """One archive file, written to a name of its own."""

    def __init__(self, folder: str):
        self.fs, base = _filesystem(folder)
        self.name = f"{uuid.uuid4().hex}.medarch"
        self.out, self.at, self.entries = self.fs.open_output_stream(f"{base}/{self.name}"), 0, []

    def add(self, key, n_bytes: int, media: bytes) -> None:
        self.entries.append((self.at, len(media), zlib.crc32(media), key is not None, key or 0, n_bytes))
        self.out.write(media)
        self.at += len(media)

    def close(self) -> tuple[str, int, int]:
        directory = np.array(self.entries, DIRECTORY).tobytes()
        self.out.write(directory + struct.pack("<qqI", self.at, len(self.entries), zlib.crc32(directory)) + MAGIC)
        self.out.close()
        return self.name, self.at, len(self.entries)


FOOTER = struct.calcsize("<qqI") + len(MAGIC)


def read_directory(file: pa.NativeFile) -> np.ndarray:
    """The directory of an open archive."""
    size = file.size()
    tail = file.read_at(FOOTER, size - FOOTER)
    members, count, crc = struct.unpack("<qqI", tail[: -len(MAGIC)])
    if tail[-len(MAGIC) :] != MAGIC:
        raise ValueError("not an archive")
    raw = file.read_at(count * DIRECTORY.itemsize, members)
    if zlib.crc32(raw) != crc:
        raise ValueError("the directory is damaged")
    return np.frombuffer(raw, DIRECTORY)


def write_archives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Store every row's text as a media member; returns the archive folder. Its manifest has one row per archive."""
    spark = docs.sparkSession
    folder = new_path(spark, "media")
    fs, base = _filesystem(folder)
    fs.create_dir(f"{base}/archives", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                writer = writer or _Writer(f"{folder}/archives")
                writer.add(key.as_py(), len(data), encode_png(pad(data)))
                if writer.at >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("name", "bytes", "members"), d, strict=True)) for d in done], schema=pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())]))

    cut = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    cut.mapInArrow(run, "name string, bytes long, members long").write.parquet(f"{folder}/manifest")
    return folder


class Range(InputPartition):
    """Members that start in [start, end) of an archive."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


class MediaReader(DataSourceReader):
    """Plans byte ranges; streams members."""

    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[Range]:
        """One range per ``range_bytes`` of each archive in the manifest: as many entries as a file source has splits."""
        import pyarrow.parquet as pq

        fs, base = _filesystem(self.folder)
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{base}/manifest")) if f.path.endswith(".parquet")]
        out = []
        for path in files:
            for row in pq.read_table(path, filesystem=fs, columns=["name", "bytes"]).to_pylist():
                out += [Range(f"{self.folder}/archives/{row['name']}", a, min(a + self.range_bytes, row["bytes"])) for a in range(0, row["bytes"], self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, path = _filesystem(partition.path)
        with fs.open_input_file(path) as file:
            directory = read_directory(file)
        a, b = np.searchsorted(directory["offset"], [partition.start, partition.end])
        held: list[tuple] = []
        held_bytes = 0
        members = directory[a:b]
        file = fs.open_input_file(path)
        for entry in members:
            media, file = read_member(fs, path, file, int(entry["offset"]), int(entry["size"]), int(entry["crc"]))
            held.append((int(entry["id"]) if entry["has_id"] else None, int(entry["n_bytes"]), media))
            held_bytes += len(media)
            if held_bytes >= BATCH_BYTES:
                yield _batch(held)
                held, held_bytes = [], 0
        file.close()
        if held:
            yield _batch(held)


def read_member(fs, path: str, file, offset: int, size: int, crc: int, attempts: int = ATTEMPTS):
    """A member's verified bytes and an open file; a failed or damaged read is repeated by offset on a new handle."""
    for attempt in range(1, attempts + 1):
        try:
            media = file.read_at(size, offset)
            if zlib.crc32(media) == crc:
                return media, file
            problem: Exception = ValueError("checksum differs")
        except OSError as e:
            problem = e
        if attempt < attempts:
            file.close()
            file = fs.open_input_file(path)
    raise OSError(f"member at {offset} of {path}: {problem}")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, sizes, media = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])


class MediaSource(DataSource):
    """``spark.read.format("millrace-media").load(folder)``: (id, n_bytes, media) of every member."""

    @classmethod
    def name(cls) -> str:
        return "millrace-media"

    def schema(self) -> str:
        return "id long, n_bytes long, media binary"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, n_bytes, media) of every member in the folder's manifest."""
    spark.dataSource.register(MediaSource)
    return spark.read.format("millrace-media").option("rangeBytes", range_bytes).load(folder)


def features(members: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per member: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n_bytes, media in zip(*(batch.column(i) for i in range(3)), strict=True):
                media = media.as_py()
                samples = decode_png(media)
                payload = samples.tobytes()
                rows.append((key.as_py(), n_bytes.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    out = members.select("id", "n_bytes", "media").mapInArrow(run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)
