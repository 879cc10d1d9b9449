"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves every language: its array holds, for each position, a
bitmask with one bit a language, so the AND of an n-gram's positions tells all
languages that contain it. A text's n-grams are looked up together, bits are
counted for each language, counts are corrected for the filter's false
positives, and the largest decides.

Learning counts the n-grams of all labelled rows; prediction reads every whole text and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import order_statistics

from .common import filter_texts, give_back, map_texts, named, sent_if_small, text_chunks, written

ORDERS = (2, 3, 4)
HASHES = 2
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
STEP = 0x100000001B3
NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def letters(text: str | None) -> str:
    """Lower case, words of letters with single spaces around; '' without a letter."""
    if not text:
        return ""
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {words} " if any(map(str.isalpha, words)) else ""


#: Texts are handled in pieces of so many characters, so that a long one takes no more memory.
PIECE_CHARS = 1 << 18


def pieces_of(texts: list[str]) -> Iterator[list[tuple[int, str, int]]]:
    """Lists of (number of the text, piece, how many of its first places begin n-grams of its own):
    a piece goes on into the next by what its last n-grams need."""
    held, size, over = [], 0, max(ORDERS) - 1
    for i, t in enumerate(texts):
        for s in range(0, len(t), PIECE_CHARS):
            own = min(PIECE_CHARS, len(t) - s)
            if held and size + own > PIECE_CHARS:
                yield held
                held, size = [], 0
            held.append((i, t[s : s + own + over], own))
            size += own
    if held:
        yield held


def gram_hashes(pieces: list[tuple[int, str, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashes of the n-grams of the pieces in turn, and how many each has."""
    code = np.frombuffer("".join(t for _, t, _ in pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for _, t, _ in pieces], np.int64)
    own = np.array([n for _, _, n in pieces], np.int64)
    ends = np.cumsum(sizes)
    h = code.copy()
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint64(STEP) + code[n - 1 :]
        if n in ORDERS:
            count = np.maximum(np.minimum(own, sizes - n + 1), 0)
            inside = np.arange(count.sum()) + np.repeat(ends - sizes - (np.cumsum(count) - count), count)
            mixed = h[inside] + np.uint64(n)
            yield mixed ^ (mixed >> np.uint64(29)), count


def positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h * np.uint64(m)) >> np.uint64(64 - bits) for m in MULTIPLIERS[:HASHES]]


@dataclass(frozen=True)
class LanguageModel:
    """langs: learned values in order of their bit; table: (positions, bytes of bits)."""

    langs: tuple[str, ...]
    bits: int
    table: np.ndarray

    def false_rate(self) -> np.ndarray:
        """For each language the chance that an n-gram it lacks appears as its own."""
        each = np.unpackbits(self.table, axis=1, bitorder="little").mean(axis=0)
        return np.minimum(each[: len(self.langs)] ** HASHES, 0.999)

    def predictor(self):
        """A function from texts to (language, score, share of known n-grams)."""
        width, n_langs = self.table.shape[1], len(self.langs)
        tables = [np.ascontiguousarray(self.table[:, b]) for b in range(width)]
        bit = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
        false = self.false_rate()

        def predict(texts: list) -> list:
            clean = [letters(t) for t in texts]
            total = np.zeros(len(texts))
            counts = np.zeros((len(texts), 8 * width))
            for pieces in pieces_of(clean) if n_langs else ():
                of = np.array([i for i, _, _ in pieces])
                for h, sizes in gram_hashes(pieces):
                    np.add.at(total, of, sizes)
                    ends = np.cumsum(sizes)
                    at = positions(h, self.bits)
                    for b, table in enumerate(tables):
                        mask = table[at[0]]
                        for p in at[1:]:
                            mask &= table[p]
                        for i, s, e in zip(of.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                            if e > s:
                                counts[i, 8 * b : 8 * b + 8] += np.bincount(mask[s:e], minlength=256) @ bit
            best, score, known = [], [], []
            for c, n, t in zip(counts[:, :n_langs], total, clean, strict=True):
                if not t or not n_langs:
                    best.append("und"), score.append(0.0), known.append(0.0)
                    continue
                own = np.maximum(0.0, (c - n * false) / (1 - false))
                k = int(own.argmax())  # of equal counts the first language
                best.append(self.langs[k])
                score.append(float(own[k] / own.sum()) if own.sum() else 0.0)
                known.append(float(min(1.0, own[k] / n)) if n else 0.0)
            return [best, score, known]

        return predict


def sampled(rows: DataFrame, docs_per_lang: int, chars_per_lang: int, salt: str) -> tuple[DataFrame, tuple[str, ...]]:
    """(about so many rows (id, lang, _text) and characters of each language, chosen by a hash of the id; the languages, in order).

    Every label counts. Where a language's chosen texts would have more characters, long ones are cut to a
    piece, at a place that the hash chooses; none is left out for its length.
    """
    n, size = F.col("n"), F.length("_text")
    each = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(size).alias("chars"))
    limits = each.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), docs_per_lang / n).alias("chance"), F.ceil(chars_per_lang / F.least(n, F.lit(docs_per_lang))).cast("int").alias("piece"), (F.col("chars") * F.least(F.lit(1.0), docs_per_lang / n) > chars_per_lang).alias("long"))
    limits = written(limits, "langs")
    langs = tuple(sorted(r["_lang"] for r in limits.select("_lang").collect()))
    drawn = F.xxhash64(F.col("id").cast("string"), F.lit(salt))
    part = F.pmod(drawn, F.lit(1_000_003))
    chosen = rows.join(sent_if_small(limits, 8 << 20), F.col("lang") == F.col("_lang")).where(part < F.col("chance") * 1_000_003)
    at = F.pmod(drawn, F.greatest(size - F.col("piece") + 1, F.lit(1))).cast("int") + 1
    piece = F.when(F.col("long") & (size > F.col("piece")), F.substring("_text", at, F.col("piece"))).otherwise(F.col("_text"))
    return chosen.select("id", "lang", piece.alias("_text")), langs


def labelled(rows: DataFrame, docs_per_lang: int | None, chars_per_lang: int, salt: str) -> tuple[DataFrame, tuple[str, ...]]:
    """(all rows, or about so many of each language; the languages, in order)."""
    if docs_per_lang is not None:
        return sampled(rows, docs_per_lang, chars_per_lang, salt)
    return rows, tuple(sorted(r["lang"] for r in rows.select("lang").distinct().collect()))


#: A task holds counts of about so many n-grams before it sends them on.
HELD_GRAMS = 1 << 21


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts, from lists of both."""
    if len(parts) == 1:
        return parts[0]
    h, own = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    return h, np.bincount(own, np.concatenate([n for _, n in parts]), len(h)).astype(np.int64)


#: A filter takes at most so many bytes; its positions are fewer with very many languages.
FILTER_BYTES = 32 << 20


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", docs_per_lang: int | None = None, chars_per_lang: int = 16_000_000, share: float = 0.5, least: int = 3, least_rate: float = 2.5e-7, bits_per_gram: int = 12, filter_bytes: int = FILTER_BYTES) -> LanguageModel:
    """Fit the filter on all rows with a label, an id and a text that aren't held out.

    N-grams are counted on every whole text of them. An n-gram enters a language's filter
    if it occurs ``least`` times there, at a rate of at least ``least_rate`` and of at least ``share`` of the
    highest rate in any language. The least rate keeps out what random letters and foreign words of a large table
    repeat a few times, and bounds the n-grams of a language however many rows there are. The driver receives the filter's set
    positions only. The filter, which is broadcast, has about ``bits_per_gram`` positions for each n-gram of the language with most, but takes
    ``filter_bytes`` at most: with very many languages its positions are fewer and its false positives more, for which counts are corrected.
    Only a caller that gives ``docs_per_lang`` learns from a sample: about so many documents, and ``chars_per_lang`` characters, of each
    language, chosen by a hash of the id.
    """
    spark = docs.sparkSession
    rows = docs.select(named(doc_id).alias("id"), named(lang).alias("lang"), named(text).alias("_text")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("_text").isNotNull() & ~held_out(F.col("id")))
    given, langs = labelled(rows, docs_per_lang, chars_per_lang, "sample")
    if not langs:
        return LanguageModel((), 4, np.zeros((16, 1), np.uint8))
    number = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for k, parts in held.items():
                h, n = summed(parts)
                for s in range(0, len(h), 1 << 17):
                    some = h[s : s + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.view(np.int64)), pa.array(n[s : s + (1 << 17)])], names=["k", "h", "n"])
            held.clear()

        size = 0
        for piece, texts in text_chunks(batches, "_text", 1 << 22):
            own = [number[x] for x in piece["lang"].to_pylist()]
            for k in sorted(set(own)):
                for pieces in pieces_of([letters(t) for x, t in zip(own, texts, strict=True) if x == k]):
                    h, n = np.unique(np.concatenate([h for h, _ in gram_hashes(pieces)]), return_counts=True)
                    held.setdefault(k, []).append((h, n.astype(np.int64)))
                    size += len(h)
                    if size > HELD_GRAMS:
                        for x, parts in held.items():
                            held[x] = [summed(parts)]
                        size = sum(len(x) for ((x, _),) in held.values())
                        if 2 * size > HELD_GRAMS:
                            yield from sent()
                            size = 0
        yield from sent()
        give_back()

    counted = given.select("lang", "_text").mapInArrow(count, "k int, h long, n long").groupBy("h", "k").agg(F.sum("n").alias("n"))
    counted = written(counted, "grams")
    totals = {r["k"]: r["n"] for r in counted.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    rate = F.col("n") / F.create_map(*[F.lit(x) for k in totals for x in (k, float(totals[k]))])[F.col("k")] if totals else F.lit(0.0)
    rated = counted.withColumn("rate", rate)
    top = rated.groupBy("h").agg(F.max("rate").alias("top"))
    chosen = written(rated.join(top, "h").where((F.col("n") >= least) & (F.col("rate") >= least_rate) & (F.col("rate") >= share * F.col("top"))).select("h", "k"), "chosen")
    each = [r["n"] for r in chosen.groupBy("k").agg(F.count("*").alias("n")).collect()]
    most = int(np.log2(max(1 << 10, filter_bytes // -(-len(langs) // 8))))
    bits = min(most, max(10, int(np.ceil(np.log2(max(each, default=1) * bits_per_gram)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, k = b["h"].to_numpy().view(np.uint64), b["k"].to_numpy()
            for p in positions(h, bits):
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(k)], names=["p", "k"])

    set_bits = chosen.mapInArrow(place, "p long, k int").distinct().groupBy("p", F.floor(F.col("k") / 8).cast("int").alias("byte")).agg(F.sum(F.expr("shiftleft(1L, k % 8)")).alias("mask"))
    found = spark.createDataFrame([], "p long, byte int, mask long").toArrow() if not each else set_bits.toArrow()
    table = np.zeros((1 << bits, -(-len(langs) // 8)), np.uint8)
    table[found["p"].to_numpy(), found["byte"].to_numpy()] = found["mask"].to_numpy().astype(np.uint8)
    return LanguageModel(langs, bits, table)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score, known for every row.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if nothing was learned. Ties go to the language first in order.
    ``score`` is the winner's part of all corrected counts, ``known`` the part
    of the text's n-grams that the winner's filter holds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("known", pa.float64())])
    return map_texts(docs, keep, text, schema, lambda: shared.value.predictor())


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **how) -> DataFrame:
    """Learn from the labelled rows of docs and predict all: doc_id, held_out, lang_pred, score, known."""
    out = predict(docs, learn(docs, text, lang, doc_id, **how), [doc_id], text)
    return out.select(doc_id, held_out(F.col(doc_id)).alias("held_out"), "lang_pred", "score", "known")


def least_known_of(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", docs_per_lang: int | None = None, chars_per_lang: int = 16_000_000, quantile: float = 0.05, part: float = 0.55) -> float:
    """The share of known n-grams below which a text is in no learned language.

    ``part`` of the exact ``quantile`` (interpolated) of ``known`` over all labelled rows that the model
    tells rightly: held-out ones, or where there are none those it learned from; about ``docs_per_lang`` a
    language, if that is given. 0 if there are none either.
    """
    rows = docs.select(named(doc_id).alias("id"), named(lang).alias("lang"), named(text).alias("_text")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("_text").isNotNull())
    for held in (True, False) if model.langs else ():
        given, _ = labelled(rows.where(held_out(F.col("id")) == held), docs_per_lang, chars_per_lang, "bound")
        found = written(predict(given, model, ["lang"], "_text").where("lang = lang_pred").select(F.lit(0).alias("all"), "known"), "known")
        n = found.count()
        if n:
            at = quantile * (n - 1)
            low, high = int(np.floor(at)), int(np.ceil(at))
            ranks = {r["rank"]: r["answer"] for r in order_statistics(found, ["all"], "known", F.array(F.lit(low), F.lit(high))).collect()}
            return part * (ranks[low] if low == high else (high - at) * ranks[low] + (at - low) * ranks[high])
    return 0.0


def keep_languages(docs: DataFrame, model: LanguageModel, least_known: float, text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, in a learned language: those that aren't
    ``und`` and of whose n-grams the winner's filter holds ``least_known`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = shared.value.predictor()

        def keep(texts: list) -> list:
            best, _, known = predict(texts)
            return [b != "und" and k >= least_known for b, k in zip(best, known, strict=True)]

        return keep

    return filter_texts(docs, text, make)
