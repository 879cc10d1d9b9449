"""MinHash near-duplicates by min-max hashing.

Under each permutation of the shingles both the least and the greatest are kept,
so half as many hash evaluations give a signature of the same length. Bands are
made of the minima, and of the maxima, of a few permutations each, so the rows of
a band are independent; two texts of Jaccard similarity s share one of 32 bands of 5 with
probability 1 - (1 - s^5)^32, all but three in a million at 0.8.

Whatever shares a band is settled on full sets, in two passes that never list
the pairs of a group. First every text meets one leader, the text of the least
address in most of its bands, so a group of copies costs one comparison a text. Then only
bands whose texts are still in several components matter, and those that share a text are united as long as
their sets fit a block, so that a text of many bands is sent once: of each union, the texts outside
its largest component meet all its texts. Both passes are dealt into blocks
of bounded bytes; a block compares by counting, joins what is alike, passes over what is joined already, and
returns a spanning forest. What it costs so follows the texts that share a band without
being alike, not the size of groups of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, named, sent_if_small, written
from .meetings import components, joined_in_groups

#: Bands of minima, as many of maxima, and permutations of each.
BANDS, ROWS = 16, 5
#: Permutations are products with odd numbers, chosen by a rule, so that every task has the same.
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(f"permutation {i}") | 1 for i in range(BANDS * ROWS)], np.uint64)
#: Shingles that are permuted at a time.
AT_ONCE = 1 << 13
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 18


class Shingles:
    """Sets of shingles as sorted hashes; hashes of words are remembered."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def of(self, text: str | None) -> np.ndarray:
        """A text of fewer words is one shingle, one without words has none."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), self.width)], np.uint64)
        known, hashed = self.known, xxhash.xxh64_intdigest
        for w in set(words):
            if w not in known:
                known[w] = hashed(w)
        h = np.array([known[w] for w in words], np.uint64)
        if len(known) > REMEMBERED:
            known.clear()
        n = len(h) - self.width + 1
        mixed = np.zeros(n, np.uint64)
        for i in range(self.width):  # a word's place counts
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed * np.uint64(0xD6E8FEB86659FD93))


def signature(shingles: np.ndarray) -> np.ndarray:
    """2 x permutations: the least and the greatest shingle under each."""
    least, greatest = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max), np.zeros(len(MULTIPLIERS), np.uint64)
    for s in range(0, len(shingles), AT_ONCE):
        part = MULTIPLIERS[:, None] * shingles[None, s : s + AT_ONCE]
        np.minimum(least, part.min(axis=1), out=least)
        np.maximum(greatest, part.max(axis=1), out=greatest)
    return np.stack([least, greatest])


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A key for each band of minima, then of maxima."""
    rows = signatures.reshape(2 * BANDS, ROWS)
    mixed = np.arange(2 * BANDS, dtype=np.uint64)
    for i in range(ROWS):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + rows[:, i]
    return mixed ^ (mixed >> np.uint64(32))


def sketched(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, node, n (shingles) and bands for every row of texts (doc_id, node, text)."""

    def make():
        shingles = Shingles(width)

        def of(rows: list) -> list:
            sets = [shingles.of(t) for t in rows]
            return [[len(s) for s in sets], [band_keys(signature(s)).view(np.int64) if len(s) else [] for s in sets]]

        return of

    return map_texts(texts, ["doc_id", "node"], "text", pa.schema([("n", pa.int64()), ("bands", pa.list_(pa.int64()))]), make)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    A text's set are its distinct ``width``-word shingles, case of A-Z ignored; with fewer words the whole text is
    one. Texts link if 100 times their common shingles are at least ``percent`` times those
    of either; component_id is the smallest id reachable, kept whether that is the row's own. Null and
    empty texts, and those without words, link with nothing: their row's own id is their component. A row without an id takes part in
    links, and has the component of its text. Rows that repeat have a row each. Only these two columns are read.
    Which texts must be compared is sent to the documents by broadcast if it takes at most
    ``broadcast_bytes``, else by a shuffle.
    """
    # a text's address tells texts apart
    texts = docs.select(named(doc_id).alias("doc_id"), F.unhex(F.sha2(F.coalesce(named(text), F.lit("")).cast("binary"), 256)).alias("node"), named(text).alias("text"))
    rows = written(sketched(texts, width), "minmax")
    nodes = written(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    sent = nodes.select("node", F.explode("bands").alias("band"))
    shared = written(sent.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1").drop("n"), "bands")
    met = written(sent.join(shared, "band"), "met")
    wanted = written(met.select("node").distinct().join(nodes.select("node", "first"), "node"), "wanted")
    sets = written(sets_of(texts, wanted, width, broadcast_bytes), "sets")
    if sets.count() > wanted.count():  # rows that repeat an id and text
        sets = written(sets.dropDuplicates(["node"]), "sets")
    led = met.where("node != leader").groupBy("node", "leader").agg(F.count("*").alias("times")).groupBy("node").agg(F.max(F.struct("times", "leader")).alias("m"))
    links = joined_in_groups(sets, led.select("node", F.col("m.leader").alias("leader")), met.select(F.col("band").alias("g"), "node"), percent, overlapping=True)
    roots = components(links)
    rooted = written(nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    firsts = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    found = written(rooted.join(firsts, "root").select("node", "component_id"), "found")
    out = rows.select("doc_id", "node", F.col("n").alias("n_shingles")).join(found, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def sets_of(texts: DataFrame, wanted: DataFrame, width: int, broadcast_bytes: int) -> DataFrame:
    """node, n and shingles of the wanted nodes (node, first), each read from rows of its smallest id."""
    own = wanted.select(F.col("node").alias("_node"), "first")
    found = texts.join(sent_if_small(own, broadcast_bytes), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "text")

    def make():
        shingles = Shingles(width)

        def of(rows: list) -> list:
            sets = [shingles.of(t) for t in rows]
            return [[len(s) for s in sets], [s.tobytes() for s in sets]]

        return of

    return map_texts(found, ["node"], "text", pa.schema([("n", pa.int64()), ("shingles", pa.binary())]), make)
