"""Vector code compression: product codes, their codebooks fitted with LAESA pivots.

Vectors are cut into equal parts; each part position has a codebook, and a
vector's code is the number of the nearest entry for each of its parts. Fitting
alternates assignment and means, all in whole numbers.

A few fixed pivots stand at each position: entries of the first codebook, far
apart. The distances of all parts to them are computed once and kept beside the
vectors. In each round only the entries' distances to the pivots are new: by the
triangle inequality |d(part, pivot) - d(entry, pivot)| bounds d(part, entry) from
below for every pivot. Entries are taken in the order of that bound, and exact
distances are computed only until it exceeds the best one found.

A round is one pass over the table of parts: a task sends sums and counts for each entry it used,
which Spark adds up; the driver gets a codebook, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import give_back, sent_if_small, written
from .vectors import floored, matrix

PIVOTS = 8
#: Parts that are handled at a time, and entries in the order of their bounds.
ROWS_AT_ONCE, ENTRIES_AT_ONCE = 2048, 8
#: Pivot distances are kept as floats of 32 bits, which err by less than this part of them.
ERROR = 2.0**-22


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def far_apart(entries: np.ndarray, n: int) -> np.ndarray:
    """n of the entries (or all): the first, then always the one farthest from those before; ties to the lower index."""
    chosen, least = [0], squares(entries, entries[0])
    while len(chosen) < min(n, len(entries)):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, squares(entries, entries[chosen[-1]]))
    return entries[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """points x pivots, as roots of exact squares."""
    return np.sqrt(squares(points[:, None], pivots[None]).astype(np.float64))


def nearest(parts: np.ndarray, near: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, its squared distance, exact distances computed); near: the parts' distances to the pivots."""
    n, m = len(parts), len(entries)
    at, best, evaluated = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), 0
    far = distances(entries, pivots).astype(np.float32)
    for s in range(0, n, ROWS_AT_ONCE):
        own, to = parts[s : s + ROWS_AT_ONCE], near[s : s + ROWS_AT_ONCE]
        bound = np.zeros((len(own), m), np.float32)
        for p in range(len(pivots)):
            np.maximum(bound, np.abs(to[:, p, None] - far[None, :, p]), out=bound)
        bound -= ERROR * (to.max(axis=1)[:, None] + far.max())
        order = np.argsort(bound, axis=1)
        bound = np.take_along_axis(bound, order, axis=1)
        live = np.arange(len(own))
        for e in range(0, m, ENTRIES_AT_ONCE):
            live = live[bound[live, e] <= np.sqrt(best[s + live])]
            if not len(live):
                break
            which = order[live, e : e + ENTRIES_AT_ONCE]
            d = squares(own[live][:, None], entries[which])
            evaluated += d.size
            least = d.min(axis=1)
            index = np.where(d == least[:, None], which, m).min(axis=1)  # of equal distances the lower index
            to_beat = best[s + live]
            better = (least < to_beat) | ((least == to_beat) & (index < at[s + live]))
            at[s + live[better]], best[s + live[better]] = index[better], least[better]
    return at, best, evaluated


@dataclass(frozen=True)
class Codebooks:
    """entries: positions x entries x components; without vectors there are no entries."""

    entries: np.ndarray
    pivots: tuple[np.ndarray, ...]

    def sha256(self) -> str:
        """Of all components in decimal, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def cut(q: np.ndarray, positions: int) -> np.ndarray:
    """positions x vectors x components."""
    return q.reshape(len(q), positions, -1).transpose(1, 0, 2)


def assigned(batch: pa.RecordBatch, books: Codebooks) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each position: parts, their entries, squared distances."""
    k = len(books.entries)
    parts = cut(matrix(batch["q"]), k)
    near = batch["near"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k, -1)
    for j in range(k):
        at, best, _ = nearest(parts[j], near[:, j], books.entries[j], books.pivots[j])
        yield parts[j], at, best


def with_pivots(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vectors (vec_id, label, q) with near, the distances of all parts to the pivots, written: computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = cut(matrix(b["q"]), len(books.pivots))
            near = np.concatenate([distances(x, p) for x, p in zip(parts, books.pivots, strict=True)], axis=1).astype(np.float32)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, rows], names=[*b.schema.names, "near"])

    narrow = vectors.select("vec_id", "label", F.col("q").cast("array<int>").alias("q"))
    return written(narrow.mapInArrow(run, StructType([*narrow.schema.fields, *StructType.fromDDL("near array<float>").fields])), "parts")


def one_round(parts: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry becomes the floored mean of its parts, componentwise; unused entries stay."""
    k, m, w = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((k, m), np.int64), np.zeros((k, m, w), np.int64)
        for b in batches:
            for j, (x, at, _) in enumerate(assigned(b, books)):
                n[j] += np.bincount(at, minlength=m)
                order = np.argsort(at, kind="stable")
                used, starts = np.unique(at[order], return_index=True)
                if len(used):
                    total[j, used] += np.add.reduceat(x[order], starts, axis=0)
        position, entry = np.nonzero(n)
        rows = total[position, entry]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * w), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(position.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[position, entry]), lists], names=["position", "entry", "n", "total"])
        give_back()

    sent = parts.select("q", "near").mapInArrow(run, "position int, entry int, n long, total array<long>")
    sums = sent.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"c{i}") for i in range(w)]).collect()  # a codebook's size
    new = books.entries.copy()
    for r in sums:
        new[r["position"], r["entry"]] = np.array([r[f"c{i}"] for i in range(w)], np.int64) // r["n"]
    return Codebooks(new, books.pivots)


def fit(vectors: DataFrame, positions: int = 4, entries: int = 256, rounds: int = 4, pivots: int = PIVOTS) -> tuple[DataFrame | None, Codebooks]:
    """(parts with their pivot distances, codebooks) of vectors (vec_id, label, q).

    Codebooks start as the parts of the ``entries`` smallest ids (ties by their
    components, missing ids last), of which the driver gets the vectors.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").toArrow()
    if not first.num_rows:
        return None, Codebooks(np.zeros((positions, 0, 0), np.int64), ())
    q = matrix(first["q"])
    if q.shape[1] % positions:
        raise ValueError(f"vectors of {q.shape[1]} components can't be cut into {positions} equal parts")
    start = np.ascontiguousarray(cut(q, positions))
    books = Codebooks(start, tuple(far_apart(x, pivots) for x in start))
    parts = with_pivots(vectors, books)
    for _ in range(rounds):
        books = one_round(parts, books)
    return parts, books


def compress(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 1024, **how) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code and error for every row with a sound vector; the codebooks).

    code: an array with an entry's number for each part; error: the sum of their
    squared distances. Rows whose vector is null, empty, of another length or
    holds a null or a component that isn't finite have no row. Repeated rows have a row each; equal
    distances go to the lower number; rows without an id are coded but
    start no entry unless there are too few others; no rows give none. Only these columns are read.
    """
    vectors = floored(rows, vec_id, label, vector, scale)
    parts, books = fit(vectors, **how)
    if parts is None:
        empty = F.array().cast("array<int>")
        return vectors.limit(0).select("vec_id", "label", empty.alias("code"), F.lit(0).cast("long").alias("error")), books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(books.entries)
        for b in batches:
            found = list(assigned(b, books))
            code = np.stack([at for _, at, _ in found], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], lists, pa.array(sum(best for _, _, best in found))], names=["vec_id", "label", "code", "error"])
        give_back()

    schema = StructType([*parts.select("vec_id", "label").schema.fields, *StructType.fromDDL("code array<int>, error long").fields])
    return parts.mapInArrow(run, schema), books


def with_label_errors(codes: DataFrame, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """codes with label_error, the sum of error over equal labels; rows without a label are together."""
    codes = written(codes, "codes")
    sums = written(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(sent_if_small(sums, broadcast_bytes), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
