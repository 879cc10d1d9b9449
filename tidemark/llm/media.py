"""Media columns: payloads in archive directories, read by a Spark data source.

``write_archives`` turns each text into a lossless 8-bit grey image (PNG, 192
samples a row) and stores the images as members of ZIP archives, without further
compression, in a shared folder. ``MediaArchives`` is a Spark data source over such
a folder: it plans byte ranges of the archives as partitions; a task reads the
archive's directory, takes the members whose header lies in its range, streams
them as Arrow batches and tries each member again, from its own offset, when a
read or its checksum fails.

Which archives count, and how many members each has, is told by the folder's manifest
(``stores``), so a task that runs again leaves no second copy of its rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from .common import fresh_dir, named, text_chunks
from .stores import MANIFEST, MANIFEST_ROW, ByteRange, Stretch, byte_ranges, filesystem, put

#: Samples a row; payloads are padded to a multiple of it.
ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
TRIES = 4
MANIFEST_ARROW = pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text in UTF-8, padded with spaces to a positive multiple of ROW, and its length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" "), len(raw)


def encode_image(payload: bytes, n_bytes: int) -> bytes:
    """A grey PNG whose samples are the payload; n_bytes is kept as its text."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_image(image: bytes) -> tuple[bytes, int]:
    """Payload and n_bytes of what encode_image made; ValueError if it is damaged."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, n_bytes, shape = 8, b"", 0, (0, 0)
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"tEXt":
            n_bytes = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes(), n_bytes


class ArchiveWriter:
    """Archives of bounded size in a folder; ``written`` has their rows of the manifest."""

    def __init__(self, folder: str, name: str):
        self.folder = folder
        self.name, self.zip, self.buffer = name, None, None
        self.written: list[tuple[str, int, int]] = []

    def add(self, member: str, data: bytes) -> None:
        if self.zip is None:
            self.buffer = io.BytesIO()
            self.zip = zipfile.ZipFile(self.buffer, "w", zipfile.ZIP_STORED)
        self.zip.writestr(zipfile.ZipInfo(member), data)
        if self.buffer.tell() >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.zip is None:
            return
        n = len(self.zip.infolist())
        self.zip.close()
        data = self.buffer.getbuffer()
        self.written.append((put(self.folder, f"{self.name}-{len(self.written):04d}", ".zip", data), len(data), n))
        self.zip, self.buffer = None, None


def write_archives(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> None:
    """One member for each row, named by its number in the task and its key (empty if null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, n = ArchiveWriter(folder, f"part-{TaskContext.get().partitionId():06d}"), 0
        for piece, texts in text_chunks(batches, "_text"):
            for k, t in zip(piece["_key"].to_pylist(), texts, strict=True):
                writer.add(f"{n:09d}/{'' if k is None else 'k' + quote(k, safe='')}.png", encode_image(*payload_of(t)))
                n += 1
        writer.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("name", "bytes", "records"), w, strict=True)) for w in writer.written], schema=MANIFEST_ARROW)

    docs.select(named(key).cast("string").alias("_key"), named(text).alias("_text")).mapInArrow(run, MANIFEST_ROW).write.parquet(f"{folder}/{MANIFEST}")


class MediaArchives(DataSource):
    """spark.read.format("media_archives").load(folder): archive, member, offset, key, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, member string, offset long, key string, media binary"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[ByteRange]:
        return byte_ranges(self.folder, ".zip", self.range_bytes)

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = filesystem(self.folder)
        with fs.open_input_file(part.path) as f:
            entries = zipfile.ZipFile(f).infolist()
        if part.records not in (None, len(entries)):
            raise OSError(f"{part.path} has {len(entries)} members, not {part.records}")
        archive = Stretch(fs, part.path)
        rows: list[tuple] = []
        held = 0
        for i in sorted((i for i in entries if part.start <= i.header_offset < part.end), key=lambda i: i.header_offset):
            data = read_member(archive, i)
            stem = i.filename.rpartition("/")[2].removesuffix(".png")
            rows.append((part.path, i.filename, i.header_offset, unquote(stem[1:]) if stem else None, data))
            held += len(data)
            if held >= BATCH_BYTES:
                yield as_batch(rows)
                rows, held = [], 0
        archive.close()
        if rows:
            yield as_batch(rows)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "member", "offset", "key", "media"])


def read_member(archive: Stretch, entry: zipfile.ZipInfo) -> bytes:
    """A member's bytes from its own offset; a try after a failed read or a wrong checksum opens the archive anew."""
    for left in reversed(range(TRIES)):
        try:
            head = archive.read(entry.header_offset, 30)
            if len(head) < 30 or head[:4] != b"PK\x03\x04":
                raise OSError(f"no member at {entry.header_offset} of {archive.path}")
            name, extra = struct.unpack_from("<HH", head, 26)
            data = archive.read(entry.header_offset + 30 + name + extra, entry.compress_size)
            if len(data) != entry.file_size or zlib.crc32(data) != entry.CRC:
                raise OSError(f"damaged member at {entry.header_offset} of {archive.path}")
            return data
        except OSError:
            archive.close()
            if not left:
                raise
    raise AssertionError


def feature_of(payload: bytes) -> str:
    """Integer features of the samples: their sum, sum of squares, sum of absolute steps, and counts by eighths of the range."""
    x = np.frombuffer(payload, np.uint8)
    wide = x.astype(np.int64)
    bins = np.bincount(x >> 5, minlength=8)
    return f"sum={wide.sum()};squares={(wide * wide).sum()};steps={np.abs(np.diff(wide)).sum()};bins={','.join(map(str, bins))}"


FEATURES = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def features(media: DataFrame) -> DataFrame:
    """key and FEATURES of each member, computed from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for image in b["media"].to_pylist():
                payload, n = decode_image(image)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(payload)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in FEATURES]
            yield pa.RecordBatch.from_arrays([b["key"], *[pa.array(c, f.type) for c, f in zip(columns, FEATURES, strict=True)]], names=["key", *FEATURES.names])

    return media.select("key", "media").mapInArrow(run, "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").load(folder)


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as media and compute features of what is read back.

    One row for each row of docs: key (as a string, null if null) and FEATURES. A
    null text is the empty one; an empty text is one row of spaces; repeated
    rows are stored and returned as often as they occur.
    """
    folder = fresh_dir(docs.sparkSession, "media")
    write_archives(docs, folder, key, text)
    return features(read_archives(docs.sparkSession, folder))
