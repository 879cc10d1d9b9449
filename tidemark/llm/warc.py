"""WARC archives: written with revisit records, read by boundary-chain verification.

Records are gzip members of .warc.gz files of bounded size (or plain .warc
files). Reading splits files into byte ranges. Each task finds every place in
its range that could begin a record, reads it and emits its offset and that of
its successor. Such places also occur inside payloads, so a candidate counts only
if the chain of successors from the file's start reaches it. Chains are followed
by pointer jumping: within its range a task gives each candidate the offset at
which its chain leaves the range; between ranges Spark doubles the jumps.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .common import fresh_dir, text_chunks, written
from .stores import MANIFEST, MANIFEST_ROW, ByteRange, byte_ranges, filesystem, put

VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20


def record(payload: bytes, page_id: int | None, url: str | None, digest: str, revisit: bool, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}:{digest}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{base32}")]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>")]
        head += [("X-Refers-To-Page-ID", str(refers_to))] if refers_to is not None else []
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def with_types(pages: DataFrame, least_bytes: int, broadcast_bytes: int) -> DataFrame:
    """page_id, url, html, _digest, _revisit, _refers: which record each page becomes.

    Of equal payloads of at least ``least_bytes`` the row with the largest page_id
    is the response. Only groups of several rows are joined back, by broadcast
    if their number times a row's bound stays below ``broadcast_bytes``, else by
    a shuffle. Rows that repeat that page_id as well can't be told apart: they
    are counted, and one of so many copies is the response (all take the smallest url).
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("_digest"))
    each = rows.where(F.octet_length("html") >= least_bytes).groupBy("_digest", "page_id").agg(F.count("*").alias("n"))
    groups = each.groupBy("_digest").agg(F.sum("n").alias("all"), F.max(F.struct("page_id", "n")).alias("top")).where("all > 1")
    leaders = written(groups.select("_digest", F.col("top.page_id").alias("_leader"), F.col("top.n").alias("_copies")), "leaders")
    n, repeated = leaders.agg(F.count("*"), F.count_if(F.col("_copies") > 1)).first()
    joined = rows.join(F.broadcast(leaders) if n * 100 <= broadcast_bytes else leaders, "_digest", "left")
    leads = F.col("page_id").eqNullSafe(F.col("_leader"))
    revisit = F.col("_copies").isNotNull() & ~leads
    columns = ["page_id", "url", "html", "_digest", "_revisit", "_refers"]
    plain = joined.withColumns({"_revisit": revisit, "_refers": F.when(revisit, F.col("_leader"))})
    if not repeated:
        return plain.select(columns)
    many = F.coalesce(F.col("_copies") > 1, F.lit(False)) & leads
    once = joined.where(many).groupBy("_digest", "page_id").agg(F.min("url").alias("url"), F.first("html").alias("html"), F.count("*").alias("n"))
    copies = once.withColumn("_revisit", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i > 1))).withColumn("_refers", F.when(F.col("_revisit"), F.col("page_id")))
    return plain.where(~many).select(columns).union(copies.select(columns))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", compress: bool = True, broadcast_bytes: int = 16 << 20) -> None:
    """One record for each page; the data has no dates, so all carry ``date``."""
    suffix = ".warc.gz" if compress else ".warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, done = [], 0, []
        part = TaskContext.get().partitionId()

        def close() -> None:
            done.append({"name": put(folder, f"part-{part:06d}-{len(done):04d}", suffix, b"".join(held)), "bytes": size, "records": len(held)})

        for piece, texts in text_chunks(batches, "html"):
            columns = [piece[c].to_pylist() for c in ("page_id", "url", "_digest", "_revisit", "_refers")]
            for html, page_id, url, digest, revisit, refers in zip(texts, *columns, strict=True):
                data = record(html.encode("utf-8", "surrogatepass"), page_id, url, digest, revisit, refers, date)
                if compress:
                    c = zlib.compressobj(3, zlib.DEFLATED, 31)
                    data = c.compress(data) + c.flush()
                held.append(data)
                size += len(data)
                if size >= FILE_BYTES:
                    close()
                    held, size = [], 0
        if held:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    with_types(pages, least_bytes, broadcast_bytes).mapInArrow(run, MANIFEST_ROW).write.parquet(f"{folder}/{MANIFEST}")


class Window:
    """A file's bytes from start on, loaded further as they are asked for."""

    def __init__(self, f, size: int, start: int, end: int):
        self.f, self.size, self.start = f, size, start
        self.data = bytearray(self.load(start, min(size, end + 16)))

    def load(self, start: int, end: int) -> bytes:
        self.f.seek(start)
        return self.f.read(end - start)

    def get(self, at: int, n: int) -> bytes:
        have = self.start + len(self.data)
        if at + n > have and have < self.size:
            self.data += self.load(have, min(self.size, max(at + n, have + (1 << 20))))
        return bytes(self.data[at - self.start : at - self.start + n])


def member(w: Window, at: int) -> tuple[bytes, int] | None:
    """The gzip member at an offset and where the next begins; None if there is none."""
    d, out, here = zlib.decompressobj(31), [], at
    try:
        while not d.eof:
            piece = w.get(here, 1 << 16)
            if not len(piece):
                return None
            out.append(d.decompress(piece))
            here += len(piece)
            if out[0] and not out[0].startswith(VERSION[: len(out[0])]):
                return None
    except zlib.error:
        return None
    return b"".join(out), here - len(d.unused_data)


def parse(data: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """Header, block and length of a record that data begins with; None if it doesn't."""
    cut = data.find(b"\r\n\r\n")
    if not data.startswith(VERSION) or cut < 0:
        return None
    head = {}
    for line in data[len(VERSION) : cut].decode("utf-8", "replace").split("\r\n"):
        k, _, v = line.partition(":")
        head[k.strip().lower()] = v.strip()
    n = head.get("content-length", "")
    if not (n.isascii() and n.isdigit()):
        return None
    end = cut + 4 + int(n)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    return head, data[cut + 4 : end], end + 4


def plain(w: Window, at: int) -> tuple[bytes, int] | None:
    """The uncompressed record at an offset and where the next begins. Its header is read to its
    blank line, however far that is, as long as every line has a colon."""
    here, length = at + len(VERSION), None
    if w.get(at, len(VERSION)) != VERSION:
        return None
    while True:
        n = 1 << 10
        while (cut := (piece := w.get(here, n)).find(b"\r\n")) < 0 and len(piece) == n:
            n *= 2
        if cut < 0:
            return None
        here += cut + 2
        if not cut:
            break
        k, colon, v = piece[:cut].partition(b":")
        if not colon:
            return None
        if k.strip().lower() == b"content-length":
            length = v.strip()
    if length is None or not length.isdigit():
        return None
    whole = here + int(length) + 4 - at
    return (w.get(at, whole), at + whole) if at + whole <= w.size else None


def fields_of(head: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a response's from its payload."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, page, refers = head.get("warc-type"), head.get("x-page-id"), head.get("x-refers-to-page-id")
    if kind == "revisit":
        n = next(int(x.partition(b":")[2]) for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:"))
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    else:
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return int(page) if page else None, n, digest, kind, int(refers) if refers else None


def forest(offsets: np.ndarray, successors: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exit, tin, size) of candidates in order of offset.

    exit: where the chain from a candidate leaves the range, -1 if it breaks off
    inside. A candidate lies on the chain from another just if its interval
    [tin, tin + size) holds the other's tin.
    """
    m = len(offsets)
    to = np.searchsorted(offsets, successors)
    local = (to < m) & (offsets[np.minimum(to, m - 1)] == successors) if m else np.zeros(0, bool)
    leave = np.where(successors >= end, successors, -1)
    size, tin, cursor = np.ones(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    for i in range(m):
        if local[i]:
            size[to[i]] += size[i]
    free = 0
    for i in reversed(range(m)):
        if local[i]:
            leave[i] = leave[to[i]]
            tin[i] = cursor[to[i]]
            cursor[to[i]] += size[i]
        else:
            tin[i] = free
            free += size[i]
        cursor[i] = tin[i] + 1
    return leave, tin, size


KINDS = [("file", pa.string()), ("file_bytes", pa.int64()), ("records", pa.int64()), ("range", pa.int64()), ("offset", pa.int64()), ("exit", pa.int64()), ("tin", pa.int64()), ("size", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


class WarcCandidates(DataSource):
    """spark.read.format("warc_candidates").load(folder): a row for each place that could begin a record."""

    @classmethod
    def name(cls) -> str:
        return "warc_candidates"

    def schema(self) -> str:
        return ", ".join(f"`{k}` {'string' if t == pa.string() else 'long'}" for k, t in KINDS)

    def reader(self, schema) -> CandidateReader:
        return CandidateReader(self.options["path"], self.options.get("suffix", ".warc.gz"), int(self.options.get("range_bytes", RANGE_BYTES)))


class CandidateReader(DataSourceReader):
    def __init__(self, folder: str, suffix: str, range_bytes: int):
        self.folder, self.suffix, self.range_bytes = folder, suffix, range_bytes

    def partitions(self) -> list[ByteRange]:
        return byte_ranges(self.folder, self.suffix, self.range_bytes)

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        magic, whole = (GZIP, member) if self.suffix.endswith(".gz") else (VERSION, plain)
        fs, _ = filesystem(self.folder)
        found = []
        with fs.open_input_file(part.path) as f:
            w = Window(f, part.size, part.start, part.end)
            at = w.data.find(magic)
            while 0 <= at < part.end - part.start:
                got = whole(w, part.start + at)
                if got and (p := parse(got[0])) and p[2] == len(got[0]):
                    found.append((part.start + at, got[1], *fields_of(p[0], p[1])))
                at = w.data.find(magic, at + 1)
        own = [part.path, part.size, part.records, part.start]
        if not part.start:  # a row without an offset tells of the file
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip([*own, *[None] * (len(KINDS) - 4)], KINDS, strict=True)], names=[k for k, _ in KINDS])
        if found:
            columns = list(zip(*found, strict=True))
            offsets, successors = np.array(columns[0], np.int64), np.array(columns[1], np.int64)
            data = [*[[x] * len(found) for x in own], offsets, *forest(offsets, successors, part.end), *columns[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(data, KINDS, strict=True)], names=[k for k, _ in KINDS])


def read_archives(spark: SparkSession, folder: str, compress: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all reachable records.

    Raises if a file's chain doesn't end with the file, or has not as many records as the folder's manifest says.
    """
    spark.dataSource.register(WarcCandidates)
    found = spark.read.format("warc_candidates").option("suffix", ".warc.gz" if compress else ".warc").option("range_bytes", range_bytes).load(folder)
    every = written(found, "candidates")
    found, files = every.where("offset is not null"), every.where("offset is null").select("file", "file_bytes", "records")
    jump = found.select("file", F.col("offset").alias("at"), F.col("exit").alias("to")).where("`to` >= 0")
    reach = written(files.select("file", F.lit(0).cast("long").alias("at")), "reach")
    n = reach.count()
    while True:
        reach = written(reach.union(reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "reach")
        before, n = n, reach.count()
        if n == before:
            break
        # one jump now goes as far as two did
        over = jump.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = written(jump.join(over, ["file", "to"], "left").select("file", "at", F.coalesce("beyond", "to").alias("to")), "jump")
    broken = files.join(reach.withColumnRenamed("at", "file_bytes"), ["file", "file_bytes"], "left_anti").count()
    if broken:
        raise ValueError(f"{broken} archives under {folder} end before their chain of records does, or are damaged")
    entries = reach.withColumnRenamed("at", "offset").join(found.select("file", "range", "offset", F.col("tin").alias("_entry")), ["file", "offset"]).drop("offset")
    on_chain = (F.col("tin") <= F.col("_entry")) & (F.col("_entry") < F.col("tin") + F.col("size"))
    kept = written(found.join(entries, ["file", "range"]).where(on_chain).select("file", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    short = files.where("records is not null").join(kept.groupBy("file").agg(F.count("*").alias("n")), "file", "left").where(F.coalesce("n", F.lit(0)) != F.col("records")).count()
    if short:
        raise ValueError(f"{short} archives under {folder} have more or fewer records than were written")
    return kept.drop("file")


def archive(pages: DataFrame, least_bytes: int = 1000, compress: bool = True) -> DataFrame:
    """Write all pages to WARC files in the shared folder and read them back.

    One row for each row of pages. A null html is the empty payload; a null
    page_id stays null and never wins over another; a null url is left out;
    repeated rows become one response and revisits of it.
    """
    folder = fresh_dir(pages.sparkSession, "warc")
    write_archives(pages, folder, least_bytes, compress=compress)
    return read_archives(pages.sparkSession, folder, compress)
