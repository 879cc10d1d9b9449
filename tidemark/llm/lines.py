"""Line dedup by a deletion-neighbourhood join.

A line is its words (split at ASCII white space). Two lines are near copies if
one word inserted, deleted or replaced turns one into the other; lines of fewer
than ``least_words`` words only copy exactly. A line goes if an equal or near
line comes earlier (by doc_id, then line number, then the text's hash), so the earliest stays.

Every deletion variant of a line (the line without one of its words) and the
line itself is a hashed key. Lines that share a variant at the same position
differ by one replaced word; a line that equals a variant of another differs by
one deleted word. Equal keys are joined by aggregation to the earliest line, so
a line with thousands of near copies costs as many keys, never their pairs.
The words of each line and the earliest it met are then compared.

Most lines have no near copy. As one edit leaves the first or the last half of
the shorter line as it is, only lines that share a half with another distinct
line emit variants; no others can match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import by_place, free_names, named, text_chunks, written

#: Where a line stands, in the order that tells the earliest: of one document by its line.
PLACE = ("doc_id", "line", "key")


def lines_of(text: str | None) -> list[str]:
    """Lines as cut by \\n; a null text has none."""
    return [] if text is None else text.split("\n")


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of the first and last t words, t being half the length of a near copy that isn't longer, or of the line."""
    n, out = len(words), []
    for t in {(n - 1) // 2, n // 2}:
        out.append(xxhash.xxh3_64_intdigest(b" ".join(words[:t]), t))
        out.append(xxhash.xxh3_64_intdigest(b" ".join(words[n - t :]), (1 << 32) + t))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def two_longs(words: list[bytes]) -> tuple[int, int]:
    """A line's content address, 128 bits."""
    h = xxhash.xxh3_128_intdigest(b" ".join(words))
    return signed(h >> 64), signed(h & 0xFFFFFFFFFFFFFFFF)


NO_LINES = "array<int>"


def with_place(docs: DataFrame, rest: str) -> StructType:
    """A schema of the place's columns (doc_id of the documents' own type, line, key) and others."""
    return StructType([docs.schema["doc_id"], *StructType.fromDDL("line int, key long, " + rest).fields])


def placed(piece: pa.RecordBatch, at: np.ndarray, lines: np.ndarray, rest: dict) -> pa.RecordBatch:
    """Rows whose places are lines of the documents at some positions of the piece."""
    at = pa.array(at, pa.int32())
    return pa.RecordBatch.from_arrays([piece["doc_id"].take(at), pa.array(lines, pa.int32()), piece["key"].take(at), *rest.values()], names=["doc_id", "line", "key", *rest])


def distinct_lines(docs: DataFrame, least_words: int) -> DataFrame:
    """Each distinct line with words once: its first place (doc_id, line, key) and k1..k4, its half keys or null."""
    names = ("h1", "h2", "k1", "k2", "k3", "k4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_chunks(batches, "text"):
            rows, at, numbers = [], [], []
            for d, t in enumerate(texts):
                for i, line in enumerate(lines_of(t)):
                    words = line.encode("utf-8", "surrogatepass").split()
                    if words:
                        keys = [signed(k) for k in half_keys(words)] if len(words) >= least_words else []
                        rows.append((*two_longs(words), *(keys + [None] * 4)[:4]))
                        at.append(d)
                        numbers.append(i)
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield placed(piece, np.array(at, np.int32), np.array(numbers, np.int32), {n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    found = docs.mapInArrow(run, with_place(docs, ", ".join(f"{n} long" for n in names)))
    found = found.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("first"), *[F.min(k).alias(k) for k in names[2:]])
    return found.select("first.*", *names[2:])


#: Bases of two sums over word hashes; both are odd, so they can be divided by.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def variant_hashes(words: list[bytes], base: int) -> np.ndarray:
    """Hashes of the line without each of its words, then of the whole line.

    A sequence's hash is the sum of its words' hashes times powers of the base,
    modulo 2^64, so all variants take time in proportion to the line.
    """
    n = len(words)
    h = np.array([xxhash.xxh3_64_intdigest(w, base) for w in words], np.uint64)
    powers = np.ones(n, np.uint64)
    powers[1:] = np.uint64(base)
    terms = h * np.cumprod(powers)
    upto = np.cumsum(terms)
    inverse = np.uint64(pow(base, -1, 1 << 64))
    return np.append(upto - terms + (upto[-1] - upto) * inverse, upto[-1])


def variants(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keys of the wanted lines: their place, v1, v2 and pos; pos -1 is the line itself, and brings its words.

    wanted: doc_id, key, lines (their numbers in that document).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_chunks(batches, "text", 1 << 19):
            made: list[list] = [[], [], [], [], []]
            said: list[str | None] = []
            for d, (numbers, t) in enumerate(zip(piece["lines"].to_pylist(), texts, strict=True)):
                lines = lines_of(t)
                for i in numbers:
                    words = lines[i].encode("utf-8", "surrogatepass").split() if i < len(lines) else []
                    if words:
                        n = len(words) + 1
                        pos = np.arange(n, dtype=np.int32)
                        pos[-1] = -1
                        for column, x in zip(made, (np.full(n, d, np.int32), np.full(n, i, np.int32), *(variant_hashes(words, b).view(np.int64) for b in BASES), pos), strict=True):
                            column.append(x)
                        said += [None] * (n - 1) + [b" ".join(words).decode("utf-8", "surrogatepass")]
            at, numbers, v1, v2, pos = [np.concatenate(c) if c else np.zeros(0, np.int32) for c in made]
            yield placed(piece, at, numbers, {"v1": pa.array(v1, pa.int64()), "v2": pa.array(v2, pa.int64()), "pos": pa.array(pos, pa.int32()), "words": pa.array(said, pa.string())})

    met = docs.join(wanted, ["doc_id", "key"]).select("doc_id", "key", "lines", "text")
    return met.mapInArrow(run, with_place(docs, "v1 long, v2 long, pos int, words string"))


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether one word inserted, deleted or replaced, or none, turns a into b."""
    if len(a) < len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[i + 1 :] == b[i + (len(a) == len(b)) :] if len(a) - len(b) <= 1 else False


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The late lines (o) of pairs (o, earliest) whose words are within one edit. texts: o, words."""
    both = pairs.join(texts.withColumnRenamed("words", "a"), "o").join(texts.select(F.col("o").alias("earliest"), F.col("words").alias("b")), "earliest").select("o.*", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in batches:
            near = [within_one_edit(a.split(" "), b.split(" ")) for a, b in zip(piece["a"].to_pylist(), piece["b"].to_pylist(), strict=True)]
            yield piece.select(list(PLACE)).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(run, StructType(both.schema.fields[:3])).distinct()


def kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = 5, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, key, kept): the numbers of the lines with words that stay, for documents where any does.

    A document is known by its id and ``key``, the hash of its text: rows that repeat
    an id with other texts are documents of their own, equal rows count as one. Ids may be of any
    type that Spark orders; rows without an id take no part. Which lines must emit
    variants is sent to the documents by broadcast if that takes less than
    ``broadcast_bytes``, else by a shuffle.
    """
    plain = docs.select(named(doc_id).alias("doc_id"), F.xxhash64(named(text)).alias("key"), named(text).alias("text")).where(F.col("doc_id").isNotNull())
    lines = written(distinct_lines(plain, least_words), "lines")
    keys = lines.select(*PLACE, F.explode(F.array_compact(F.array("k1", "k2", "k3", "k4"))).alias("k"))
    shared = keys.groupBy("k").agg(F.count("*").alias("times")).where("times > 1").select("k")
    suspects = keys.join(shared, "k").groupBy("doc_id", "key").agg(F.collect_set("line").alias("lines"))  # at most a document's lines
    wanted = written(suspects, "suspects")
    if (wanted.agg(F.sum(F.size("lines") * 4 + F.octet_length(F.col("doc_id").cast("string")) + 48)).first()[0] or 0) <= broadcast_bytes:
        wanted = F.broadcast(wanted)
    found = written(variants(plain, wanted), "variants")
    order = F.struct(*PLACE).alias("o")
    met = found.groupBy("v1", "v2").agg(F.count("*").alias("times")).where("times > 1").select("v1", "v2")
    live = written(found.join(met, ["v1", "v2"]).select("v1", "v2", "pos", order), "met")
    # the same words without one at the same position: one replaced word apart, the earliest stays
    replaced = live.where("pos >= 0").groupBy("v1", "v2", "pos").agg(F.min("o").alias("least"))
    # a whole line and a variant with the same words: one deleted word apart
    whole = live.where("pos < 0").groupBy("v1", "v2").agg(F.min("o").alias("whole"))
    longer = replaced.groupBy("v1", "v2").agg(F.min("least").alias("least"))
    short_gone = whole.join(longer, ["v1", "v2"]).where(F.col("least") < F.col("whole")).select(F.col("whole").alias("o"), F.col("least").alias("earliest"))
    bound = replaced.join(whole, ["v1", "v2"], "left").select("v1", "v2", "pos", F.least("least", "whole").alias("earliest"))
    late = live.join(bound, ["v1", "v2", "pos"]).where(F.col("earliest") < F.col("o")).select("o", "earliest")
    gone = verified(late.union(short_gone).distinct(), found.where("pos < 0").select(order, "words").distinct())
    return lines.select(*PLACE).join(gone, list(PLACE), "left_anti").groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("line")).alias("kept"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = 5) -> DataFrame:
    """doc_id, n_lines, n_kept and kept for every row of docs.

    ``kept`` numbers the lines that stay: those kept_lines names and all lines
    without words. A null text has no lines. A row without an id keeps all its lines.
    Of lines in rows that repeat an id the earliest goes by line number, then by the text's hash.
    """
    found = kept_lines(docs, doc_id, text, least_words).withColumnsRenamed({"doc_id": "_doc", "key": "_of", "kept": "_kept"})
    none = F.array().cast(NO_LINES)
    split = F.coalesce(F.split(named(text), "\n", -1), none.cast("array<string>"))
    plain = F.transform(split, lambda x, i: F.when(named(doc_id).isNull() | ~x.rlike(r"[^\x20\x09-\x0D]"), i))
    narrow = docs.select(named(doc_id).alias("_id"), F.xxhash64(named(text)).alias("_key"), F.size(split).cast("long").alias("n_lines"), F.array_compact(plain).alias("_plain"))
    kept = F.array_sort(F.concat("_plain", F.coalesce("_kept", none)))
    joined = narrow.join(found, (F.col("_id") == F.col("_doc")) & (F.col("_key") == F.col("_of")), "left")
    return joined.select(F.col("_id").alias(doc_id), "n_lines", F.size(kept).cast("long").alias("n_kept"), kept.alias("kept"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", least_words: int = 5) -> DataFrame:
    """docs with the lines that stay as their text, and n_chars to match if there is such a column.

    A document all of whose words are gone goes; one without words from the start stays.
    """
    columns = docs.columns
    key, doc, of, kept = free_names(columns, "_key", "_doc", "_of", "_kept")
    found = kept_lines(docs, doc_id, text, least_words).withColumnsRenamed({"doc_id": doc, "key": of, "kept": kept})
    known = F.when(named(doc_id).isNotNull(), F.coalesce(kept, F.array().cast(NO_LINES))).alias(kept)
    joined = docs.withColumn(key, F.xxhash64(named(text))).join(found, (named(doc_id) == F.col(doc)) & (F.col(key) == F.col(of)), "left").select(*map(named, columns), known)

    joined = by_place(joined)
    names = joined.columns
    own_text, own_count = names[columns.index(text)], names[columns.index(n_chars)] if n_chars in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_chunks(batches, own_text):
            new = []
            for t, numbers in zip(texts, piece[names[-1]].to_pylist(), strict=True):
                if t is None or numbers is None:
                    new.append((t, True))
                    continue
                stays, cut = set(numbers), lines_of(t)
                worded = [bool(x.encode("utf-8", "surrogatepass").split()) for x in cut]
                left = [x for i, (x, w) in enumerate(zip(cut, worded, strict=True)) if not w or i in stays]
                new.append((t if len(left) == len(cut) else "\n".join(left), bool(stays) or not any(worded)))
            changed = {own_text: pa.array([x for x, _ in new], piece[own_text].type)}
            if own_count:
                same = piece[own_count].to_pylist()
                changed[own_count] = pa.array([n if x is t else len(x) for n, (x, _), t in zip(same, new, texts, strict=True)], piece[own_count].type)
            out = pa.RecordBatch.from_arrays([changed.get(c, piece[c]) for c in names[:-1]], names=names[:-1])
            yield out.filter(pa.array([stays for _, stays in new], pa.bool_()))

    return joined.mapInArrow(run, StructType(joined.schema.fields[: len(columns)])).toDF(*columns)
