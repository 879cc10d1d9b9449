"""Files in a shared folder that tasks write under names of their own, read by byte range.

A task that runs again writes further files, since names carry its attempt. Which files
count is told by the folder's manifest, a table that Spark commits with the
tasks that succeeded; it also says how many records each file holds.
"""

from __future__ import annotations

from urllib.parse import urlparse

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql.datasource import InputPartition

#: The table below a folder of archives; readers of files pass over names that begin so.
MANIFEST = "_manifest"
MANIFEST_ROW = "name string, bytes long, records long"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """For a local path, or a URI of a store that pyarrow knows, by the names Spark has for it too."""
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path
    if scheme in ("s3a", "s3n"):
        path = "s3" + path[len(scheme) :]
    return pafs.FileSystem.from_uri(path)


def put(folder: str, stem: str, suffix: str, data) -> str:
    """A new file, named by the stem, the task's attempt and the suffix; its name."""
    fs, path = filesystem(folder)
    fs.create_dir(path)
    name = f"{stem}-{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}{suffix}"
    with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
    return name


def list_files(folder: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder."""
    fs, path = filesystem(folder)
    files = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in files if f.is_file and f.path.endswith(suffix) and not f.base_name.startswith((".", "_")) and f"/{MANIFEST}/" not in f.path)


def committed(folder: str, suffix: str) -> list[tuple[str, int, int | None]]:
    """(path, bytes, records) of the files of the manifest, or where there is none of all files, whose records aren't known."""
    fs, path = filesystem(f"{folder}/{MANIFEST}")
    tables = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    found = list_files(folder, suffix)
    if not tables:
        return [(p, n, None) for p, n in found]
    rows: list[dict] = []
    for t in tables:
        if t.path.endswith(".parquet"):
            with fs.open_input_file(t.path) as f:
                rows += pq.read_table(f).to_pylist()
    sizes = {p.rpartition("/")[2]: (p, n) for p, n in found}
    for r in rows:
        if sizes.get(r["name"], (None, None))[1] != r["bytes"]:
            raise OSError(f"{r['name']} of {folder} is missing or has another size")
    return sorted((*sizes[r["name"]], r["records"]) for r in rows)


class ByteRange(InputPartition):
    def __init__(self, path: str, size: int, records: int | None, start: int, end: int):
        self.path, self.size, self.records, self.start, self.end = path, size, records, start, end


def byte_ranges(folder: str, suffix: str, range_bytes: int) -> list[ByteRange]:
    """Ranges over all committed files; one empty range if there is none."""
    return [ByteRange(p, size, n, s, min(size, s + range_bytes)) for p, size, n in committed(folder, suffix) for s in range(0, size, range_bytes)] or [ByteRange("", 0, 0, 0, 0)]


class Stretch:
    """A file read in stretches: what is asked for comes from the last one if it is there."""

    def __init__(self, fs: pafs.FileSystem, path: str, ahead: int = 1 << 20):
        self.fs, self.path, self.ahead = fs, path, ahead
        self.f, self.start, self.data = None, 0, b""

    def read(self, at: int, n: int) -> bytes:
        """n bytes from an offset on, fewer only at the file's end."""
        if not self.start <= at <= at + n <= self.start + len(self.data):
            if self.f is None:
                self.f = self.fs.open_input_file(self.path)
            self.f.seek(at)
            self.start, self.data = at, self.f.read(max(n, self.ahead))
        return self.data[at - self.start : at - self.start + n]

    def close(self) -> None:
        """The next read opens the file anew."""
        f, self.f, self.data = self.f, None, b""
        if f is not None:
            f.close()
