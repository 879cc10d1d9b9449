"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: A Python task handles about so many characters at a time, and at least one text.
CHARS_AT_ONCE = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made and set if the master
    is local, as in tests; on a cluster, whose executors wouldn't see it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is created."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends here, and
    a lost executor costs no more than the tasks it ran."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_small(rows: DataFrame, most_bytes: int) -> DataFrame:
    """A written table of ids and integers, to be broadcast if its measured size is at most that, else as it is."""
    ids = [F.coalesce(F.octet_length(named(c).cast("string")), F.lit(0)) + 12 for c in rows.columns]
    size = rows.agg(F.sum(sum(ids, F.lit(16)))).first()[0] or 0
    return F.broadcast(rows) if size <= most_bytes else rows


def free_names(taken: list[str], *stems: str) -> list[str]:
    """Column names made of the stems that no column of ``taken`` has."""
    used, out = {c.lower() for c in taken}, []
    for s in stems:
        while s.lower() in used:
            s += "_"
        used.add(s.lower())
        out.append(s)
    return out


def named(column: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, chars: int = CHARS_AT_ONCE) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Arrow batches cut into pieces of about ``chars`` characters (one text at
    least), each with the piece's texts as a Python list."""
    for batch in batches:
        lengths = pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + n > chars:
                piece = batch.slice(start, i - start)
                yield piece, piece[column].to_pylist()
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            piece = batch.slice(start)
            yield piece, piece[column].to_pylist()


def give_back() -> None:
    """What a task has freed goes back to the system: Python workers live on for the next tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def map_texts(df: DataFrame, keep: list[str], text: str, schema: pa.Schema, make: Callable[[], Callable[[list], list]], chars: int = CHARS_AT_ONCE) -> DataFrame:
    """One output row for each row of df: its ``keep`` columns and the columns of
    ``schema`` that a function computes from the text.

    ``make`` runs once a task and returns the function, which takes a list of
    texts (None for null) and returns the columns as lists. Only ``keep`` and
    the text travel to Python; other columns of df, clashing names included,
    play no part.
    """
    (own,) = free_names(keep, "_text")
    cut = df.select(*map(named, keep), named(text).alias(own))
    out = StructType(cut.schema.fields[: len(keep)] + from_arrow_schema(schema).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for piece, texts in text_chunks(batches, own, chars):
            made = [pa.array(v, f.type) for v, f in zip(of(texts), schema, strict=True)]
            yield pa.RecordBatch.from_arrays([*piece.columns[: len(keep)], *made], names=[*keep, *schema.names])
        of = piece = texts = made = None
        give_back()

    return cut.mapInArrow(run, out)


def by_place(df: DataFrame) -> DataFrame:
    """df with its columns named by their place, as mapInArrow doesn't resolve every name."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def filter_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows of df, with all their columns, for whose text a function of ``make`` says true."""
    own = f"c{df.columns.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for piece, texts in text_chunks(batches, own):
            yield piece.filter(pa.array(keep(texts), pa.bool_()))
        keep = piece = texts = None
        give_back()

    placed = by_place(df)
    return placed.mapInArrow(run, placed.schema).toDF(*df.columns)
