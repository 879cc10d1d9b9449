"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ``width`` consecutive benchmark words is a pattern (an item
with fewer words is one pattern). Patterns of one length share a block-shift
table: the search looks at the block of words that ends a possible occurrence,
and the table says how far no pattern can end. Where the shift is 0, the hash of
that suffix block selects a bucket of patterns, in it the hash of the whole window those
to test, and they are compared word by word. A block has 2 to 4 words, the more
the more patterns there are, so that few places have shift 0 by chance.

The benchmark is cut into words and dealt into blocks of bounded size by Spark, which
writes them to the shared folder. A Python worker reads a block from there and makes its tables
once, some 35 bytes a benchmark word. One block is searched as the documents
stream by, with no shuffle. Larger benchmarks are searched block after block, each in
a job of its own that returns what it hit; hits are merged by the text's digest.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, free_names, fresh_dir, map_texts, named, text_chunks, written
from .stores import filesystem, list_files

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Fixed by the contract.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A benchmark item is cut into pieces of so many words, which overlap by one less than the window.
PIECE_WORDS = 1 << 15
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes that hold within one process, where tables are made and used."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64) * FACTOR


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on."""
    out = h
    for j in range(1, n):
        out = out[:-1] * FACTOR + h[j:]
    return out ^ (out >> np.uint64(29))


def bucket_keys(block: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The suffix block's hash above, the window's below."""
    return (block & np.uint64(0xFFFFFFFF00000000)) | (window >> np.uint64(32))


def block_words(patterns: int, m: int) -> int:
    """Words of a block for so many patterns of m words: their logarithm to the base of 2^9 words that are common."""
    return min(m, max(2, min(4, math.ceil(math.log2(2 * m * max(1, patterns)) / 9))))


class Table:
    """Shift table and buckets for the patterns of m words that begin at some places of the benchmark's words."""

    def __init__(self, h: np.ndarray, starts: np.ndarray, m: int):
        self.m, self.block = m, block_words(len(starts), m)
        blocks = window_hashes(h, self.block)
        self.far = m - self.block + 1
        self.bits = int(min(24, max(10, math.ceil(math.log2(8 * len(starts) + 1)))))
        self.shift = np.full(1 << self.bits, self.far, np.uint8)
        for left in reversed(range(self.far)):  # the smaller distance is written last
            self.shift[self.slot(blocks[starts + (self.far - 1 - left)])] = left
        keys = bucket_keys(blocks[starts + self.far - 1], window_hashes(h, m)[starts])
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts = keys[order], starts[order].astype(np.int32)

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return blocks >> np.uint64(64 - self.bits)

    def candidates(self, blocks: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
        """Starts of windows whose last block has shift 0; ranges: texts' words among all."""
        shift = self.shift[self.slot(blocks)].tobytes()
        found, m, back = [], self.m, self.block
        for s, e in ranges:
            end = s + m
            while end <= e:
                step = shift[end - back]
                if step:
                    end += step
                else:
                    found.append(end - m)
                    end += 1
        return np.array(found, np.int64)


class WuManber:
    """Search tables for the windows of pieces (id or None, words joined by spaces)."""

    def __init__(self, pieces: list[tuple[str | None, str]], width: int):
        self.ids = [i for i, _ in pieces]
        cut = [p.split(" ") for _, p in pieces]
        flat = list(itertools.chain.from_iterable(cut))
        self.text = " ".join(flat).encode("utf-8", "surrogatepass")
        lengths = np.array([len(w) for w in cut], np.int64)
        self.first = np.cumsum(lengths) - lengths  # of each piece, its first word
        self.offsets = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(np.fromiter((len(w.encode("utf-8", "surrogatepass")) + 1 for w in flat), np.int64, len(flat)), out=self.offsets[1:])
        h = word_hashes(flat)
        size = np.minimum(lengths, width)
        self.tables = []
        for m in np.unique(size).tolist():
            own = np.flatnonzero(size == m)
            n = lengths[own] - m + 1
            starts = np.repeat(self.first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.tables.append(Table(h, starts, m))

    def find(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, int]]:
        """(text, start, end, piece) of every occurrence of a window in texts cut into words."""
        flat = list(itertools.chain.from_iterable(texts))
        ends = np.cumsum([len(w) for w in texts])
        ranges = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        h = word_hashes(flat)
        for t in self.tables:
            if len(flat) < t.m:
                continue
            blocks = window_hashes(h, t.block)
            at = t.candidates(blocks, ranges)
            if not len(at):
                continue
            window = window_hashes(h[at[:, None] + np.arange(t.m)].T, t.m)[0]
            keys = bucket_keys(blocks[at + t.far - 1], window)
            lo, hi = np.searchsorted(t.keys, keys, "left"), np.searchsorted(t.keys, keys, "right")
            some = np.flatnonzero(hi > lo)
            text = np.searchsorted(ends, at[some], "right")
            for k, d in zip(some.tolist(), text.tolist(), strict=True):
                s = int(at[k])
                said = " ".join(flat[s : s + t.m]).encode("utf-8", "surrogatepass")
                patterns = t.starts[lo[k] : hi[k]]
                pieces = np.searchsorted(self.first, patterns, "right") - 1
                begin = ranges[d][0]
                for p, piece in zip(patterns.tolist(), pieces.tolist(), strict=True):
                    if self.text[self.offsets[p] : self.offsets[p + t.m] - 1] == said:
                        yield d, s - begin, s - begin + t.m, piece

    def search(self, texts: list) -> tuple[list[int], list[list], list[list[str]]]:
        """Of each text: its number of words, the ranges of words that are hit, and the items, in string order."""
        words = [words_of(t) for t in texts]
        spans: list[list] = [[] for _ in texts]
        found: list[set] = [set() for _ in texts]
        for d, s, e, piece in self.find(words):
            spans[d].append((s, e))
            found[d].add(self.ids[piece])
        return [len(w) for w in words], [merged(x) for x in spans], [sorted(x - {None}) for x in found]


def merged(spans: list) -> list:
    out: list = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def benchmark_blocks(items: DataFrame, item_text: str, item_id: str, width: int, block_bytes: int) -> tuple[str, int]:
    """A folder with the pieces of all items, dealt by hash into blocks (block=0, 1, ...) of about ``block_bytes``; how many."""
    own = items.select(named(item_id).cast("string").alias("id"), named(item_text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text"):
            ids, pieces = [], []
            for i, t in zip(batch["id"].to_pylist(), texts, strict=True):
                w = words_of(t)
                for s in range(0, max(1, len(w) - width + 1), PIECE_WORDS) if w else ():
                    ids.append(i)
                    pieces.append(" ".join(w[s : s + PIECE_WORDS + width - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pieces, pa.string())], names=["id", "piece"])

    pieces = written(own.mapInArrow(cut, "id string, piece string").distinct(), "pieces")
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    folder = fresh_dir(items.sparkSession, "benchmark")
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("id", "piece"), F.lit(blocks)))
    dealt.repartition(max(1, min(blocks, 200)), "block").write.partitionBy("block").parquet(folder)
    return folder, blocks


#: The tables a Python worker made last, by folder and block.
MADE: dict[tuple, WuManber] = {}


def tables_of(folder: str, block: int, width: int) -> WuManber:
    key = (folder, block, width)
    if key not in MADE:
        MADE.clear()
        fs, _ = filesystem(folder)
        rows: list[tuple] = []
        for path, _ in list_files(f"{folder}/block={block}", ".parquet"):
            with fs.open_input_file(path) as f:
                t = pq.read_table(f, columns=["id", "piece"])
            rows += zip(t["id"].to_pylist(), t["piece"].to_pylist(), strict=True)
        MADE[key] = WuManber(rows, width)
    return MADE[key]


HITS = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64())))])


def hit_rows(search: WuManber, texts: list) -> list:
    n, spans, ids = search.search(texts)
    return [n, [sum(e - s for s, e in x) for x in spans], ids, spans]


def hits_of_blocks(docs: DataFrame, text: str, folder: str, blocks: int, width: int) -> DataFrame:
    """digest, items, spans of the texts that any block hits, a row for each text and block: one job a block."""
    rows = docs.select(F.md5(named(text).cast("binary")).alias("digest"), named(text).alias("text")).where(F.col("text").isNotNull())
    out = fresh_dir(docs.sparkSession, "hits")
    for b in range(blocks):

        def make(b=b):
            search = tables_of(folder, b, width)
            return lambda texts: hit_rows(search, texts)

        map_texts(rows, ["digest"], "text", HITS, make).where("n_hit > 0").select("digest", "items", "spans").dropDuplicates(["digest"]).write.mode("append").parquet(out)
    return docs.sparkSession.read.schema("digest string, items array<string>, spans array<array<long>>").parquet(out)


def find_contamination(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_text: str = "text", item_id: str = "item_id", width: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """``keep`` columns, n_words, n_hit, items (ids as strings, in string order), hit_spans (json of word ranges).

    A null text has no words; an item without words has no window and never
    occurs; an item with a null id marks words but isn't listed. Repeated items
    and ids count once. ``block_bytes`` bounds the benchmark text searched at a time.
    """
    folder, blocks = benchmark_blocks(items, item_text, item_id, width, block_bytes)
    spans = F.to_json("spans").alias("hit_spans")
    if blocks == 1:

        def make():
            search = tables_of(folder, 0, width)
            return lambda texts: hit_rows(search, texts)

        return map_texts(docs, keep, text, HITS, make).select(*map(named, keep), "n_words", "n_hit", "items", spans)
    # at most a row a block for each text
    each = hits_of_blocks(docs, text, folder, blocks, width).groupBy("digest").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            joined = [merged(x) for x in b["spans"].to_pylist()]
            hit = [sum(e - s for s, e in x) for x in joined]
            yield pa.RecordBatch.from_arrays([b["digest"], pa.array([sorted(set(x)) for x in b["items"].to_pylist()], HITS.field("items").type), pa.array(joined, HITS.field("spans").type), pa.array(hit, pa.int64())], names=["_digest", "_items", "_spans", "_hit"])

    found = each.mapInArrow(merge, "_digest string, _items array<string>, _spans array<array<long>>, _hit long")
    rows = docs.select(F.struct(*map(named, keep)).alias("_keep"), F.md5(named(text).cast("binary")).alias("_own"), named(text).alias("_text"))
    counted = map_texts(rows, ["_keep", "_own"], "_text", pa.schema([("n_words", pa.int64())]), lambda: lambda texts: [[len(words_of(t)) for t in texts]])
    joined = counted.join(found, F.col("_own") == F.col("_digest"), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return joined.select("_keep.*", "n_words", F.coalesce("_hit", F.lit(0)).alias("n_hit"), none("_items", "array<string>").alias("items"), F.to_json(none("_spans", "array<array<long>>")).alias("hit_spans"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", width: int = 10, block_bytes: int = 16 << 20, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs, with their columns, in which no window occurs.

    With several blocks of benchmark the digests of contaminated texts are
    taken away by a broadcast below ``broadcast_bytes``, else by a shuffle.
    """
    folder, blocks = benchmark_blocks(items, item_text, item_id, width, block_bytes)
    if blocks == 1:

        def make():
            search = tables_of(folder, 0, width)
            return lambda texts: [not x for x in search.search(texts)[1]]

        return filter_texts(docs, text, make)
    (own,) = free_names(docs.columns, "_digest")
    hits = hits_of_blocks(docs, text, folder, blocks, width).select(F.col("digest").alias(own)).distinct()
    hits = F.broadcast(hits) if hits.count() * 80 <= broadcast_bytes else hits
    return docs.join(hits, F.md5(named(text).cast("binary")) == F.col(own), "left_anti")
