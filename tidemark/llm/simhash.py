"""SimHash fingerprints and near-duplicate components by pivot distance tables.

Fingerprints of documents link when few bits differ. Each distinct fingerprint
gets its row of a pivot table: its Hamming distances to many reference
fingerprints. By the triangle inequality two fingerprints within ``radius`` differ
by no more than that in any of these coordinates, so pairs with a larger
coordinate difference are discarded unseen, and only survivors are compared.

A pivot table alone still asks for all pairs, so they come from blocks: of
``radius + 2`` bit blocks two must be equal. A pair of block values shared by many
fingerprints is dealt into tiles of bounded size, and each pair of tiles is one
small task group. A group returns a spanning forest of its links, never the
pairs, so copies of a text cost links in proportion to their number. Components
follow by alternating large and small stars.

Near copies at a similarity of shingles, which lie up to 16 bits apart, share no
bit blocks: ``drop_similar`` lets texts meet that share a band of least shingles,
passes their pairs through the pivot tables, and confirms them by their shingles.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, map_texts, named, sent_if_small, written
from .meetings import by_group, components, joined_in_groups

BITS = 64
#: Reference fingerprints: a rule, so that every task has the same.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(16)], np.uint64)
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, width: int) -> int:
    """As an unsigned integer; no words give 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    h = xxhash.xxh64_digest
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    total, n, held = np.zeros(BITS, np.int64), 0, []
    for s in shingles:
        held.append(h(s, 42))
        if len(held) == SHINGLES_AT_ONCE:
            total += bit_counts(held)
            n, held = n + len(held), []
    if held:
        total += bit_counts(held)
        n += len(held)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def bit_counts(digests: list[bytes]) -> np.ndarray:
    """How many of the hashes have each bit set, highest bit first."""
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
    # uint8 sums of at most 255 rows, then their totals: a quick pass over many rows
    whole = len(bits) // 255 * 255
    total = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        total += np.add.reduce(bits[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = 3) -> DataFrame:
    """``keep`` columns and fp, the fingerprint as a signed long, for every row."""
    return map_texts(docs, keep, text, pa.schema([("fp", pa.int64())]), lambda: lambda texts: [[signed(fingerprint(t, width)) for t in texts]])


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """Links that join the same fingerprints as all pairs within the radius do:
    pairs within left, or between left and right. One row a link.

    Pivot coordinates are compared one after the other, the first by a sorted
    search; survivors of all are verified.
    """
    own = np.concatenate([left, right]) if right is not None else left
    a, b = np.arange(len(left)), np.arange(len(left), len(own)) if right is not None else np.arange(len(left))
    table = np.bitwise_count(own[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    b = b[np.argsort(table[b, 0], kind="stable")]
    coordinate = table[b, 0]
    lo, hi = np.searchsorted(coordinate, table[a, 0] - radius, "left"), np.searchsorted(coordinate, table[a, 0] + radius, "right")
    label = np.arange(len(own))
    links: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    step = max(1, (1 << 20) // max(1, len(b)))
    for s in range(0, len(a), step):
        n = hi[s : s + step] - lo[s : s + step]
        x = np.repeat(a[s : s + step], n)
        y = b[np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[s : s + step], n)]
        ok = x < y
        x, y = x[ok], y[ok]
        for p in range(1, len(PIVOTS)):
            if not len(x):
                break
            ok = np.abs(table[x, p] - table[y, p]) <= radius
            x, y = x[ok], y[ok]
        ok = np.bitwise_count(own[x] ^ own[y]) <= radius
        for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
            ri, rj = root(i), root(j)
            if ri != rj:
                label[max(ri, rj)] = min(ri, rj)
                links.append((i, j))
    return own[np.array(links, np.int64).reshape(-1, 2)]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links whose components are those of all pairs within the radius.

    prints: distinct fingerprints, column fp. Of ``radius + 2`` bit blocks two at
    least are equal, so a fingerprint is sent once for each pair of blocks, to
    those that share both (32 bits at radius 2). A pair of block values of n fingerprints is
    dealt into sqrt(n / 8) tiles, so a pair of tiles holds at most some
    sqrt(32 n) rows and each row is sent sqrt(n / 8) times.
    """
    cuts = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]
    block = lambda lo, hi: F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
    both = list(itertools.combinations(zip(cuts, cuts[1:], strict=False), 2))
    keys = F.array(*[F.struct(F.lit(i).alias("block"), F.shiftleft(block(*x), y[1] - y[0]).bitwiseOR(block(*y)).alias("bits")) for i, (x, y) in enumerate(both)])
    blocks = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.block", "k.bits")
    sizes = blocks.groupBy("block", "bits").agg(F.count("*").alias("n")).where(F.col("n") > 1).withColumn("tiles", F.ceil(F.sqrt(F.col("n") / 8)).cast("int"))
    sizes = written(sizes, "sizes")  # a table of its own, so that Spark may split a hot key of the join
    dealt = blocks.join(sizes, ["block", "bits"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # a tile meets itself and every other tile of its block value once
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    meets = meets.select("fp", "block", "bits", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), (F.col("own") <= F.col("other")).alias("first"))
    # small groups travel together: one Python call handles a whole partition
    meets = meets.repartition("block", "bits", "t", "u").sortWithinPartitions("block", "bits", "t", "u")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def done(t: pa.Table) -> pa.RecordBatch:
            fp = t["fp"].to_numpy().view(np.uint64)
            key = np.stack([t[c].to_numpy().astype(np.int64) for c in ("block", "bits", "t", "u")], axis=1)
            first = t["first"].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            out = []
            for s, e in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                if e - s == 2:
                    away = np.bitwise_count(fp[s] ^ PIVOTS).astype(np.int8) - np.bitwise_count(fp[s + 1] ^ PIVOTS).astype(np.int8)
                    if (key[s, 2] == key[s, 3] or first[s] != first[s + 1]) and np.abs(away).max() <= radius and int(fp[s] ^ fp[s + 1]).bit_count() <= radius:
                        out.append(fp[s : s + 2].reshape(1, 2))
                elif e - s > 2:
                    g, f = fp[s:e], first[s:e]
                    out.append(forest(g, None, radius) if key[s, 2] == key[s, 3] else forest(g[f], g[~f], radius))
            both = np.concatenate(out).view(np.int64) if out else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:  # the last group of a batch may go on in the next
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            key = np.stack([t[c].to_numpy().astype(np.int64) for c in ("block", "bits", "t", "u")], axis=1)
            whole = int(np.argmax((key == key[-1]).all(axis=1))) if len(key) else 0
            if whole:
                yield done(t.slice(0, whole))
            rest = t.slice(whole)
        if rest is not None and rest.num_rows:
            yield done(rest)

    return meets.mapInArrow(join, "a long, b long").where(F.col("a") != F.col("b")).distinct()


def content(text: str) -> Column:
    """A text's address (SHA-256), by which texts are told apart; null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(named(text), F.lit("")).cast("binary"), 256))


def in_components(docs: DataFrame, doc_id: str, text: str, width: int, radius: int) -> DataFrame:
    """doc_id, node (its content), fp, root (of its component), component_id for every row of docs."""
    rows = docs.select(named(doc_id).alias("doc_id"), content(text).alias("node"), named(text).alias("text"))
    prints = written(fingerprints(rows, ["doc_id", "node"], "text", width), "prints")
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    roots = components(links(groups.select("fp"), radius))
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(firsts, "root").select("fp", "root", "component_id"), "fp", "left")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id for every row of docs.

    component_id is the smallest id reachable over links, null only if no row of
    the component has an id. Texts without words (null, empty) have fingerprint 0
    and link like any other; repeated rows share a fingerprint.
    """
    return in_components(docs, doc_id, text, width, radius).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs, with their columns, that stay when each component keeps its smallest id.

    Of several rows of that id in one component a single row stays, that of the
    smallest address. A row without an id has no place in that order and stays as it is.
    """
    found = in_components(docs, doc_id, text, width, radius).where(F.col("doc_id").isNotNull())
    each = written(found.groupBy("root", "doc_id", "node").agg(F.count("*").alias("n")), "each")
    return one_each(docs, each, each.groupBy("root").agg(F.min(F.struct("doc_id", "node", "n")).alias("stay")).select("stay.*"), doc_id, text)


#: What is measured to be no larger is broadcast; beyond it documents are shuffled.
BROADCAST_BYTES = 8 << 20


def one_each(docs: DataFrame, each: DataFrame, stay: DataFrame, doc_id: str, text: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row of docs for each row of stay, and all rows without an id.

    each: doc_id and node of all rows with an id; stay: some of them, and n, how
    many rows of docs are such. Those that go are named, not those that stay: if
    they take at most ``broadcast_bytes`` they are sent to the documents.
    """
    columns = docs.columns
    own, doc, node, one = free_names(columns, "_own", "_doc", "_node", "_one")
    stay = written(stay, "stay")
    gone = written(each.select("doc_id", "node").join(stay, ["doc_id", "node"], "left_anti").distinct().withColumnsRenamed({"doc_id": doc, "node": node}), "gone")
    same = (named(doc_id) == F.col(doc)) & (F.col(own) == F.col(node))
    kept = docs.withColumn(own, content(text)).join(sent_if_small(gone, broadcast_bytes), same, "left_anti")
    again = stay.where("n > 1")
    if not again.isEmpty():
        again = again.select(F.col("doc_id").alias(doc), F.col("node").alias(node))
        plain = [F.to_json(F.struct(named(c))) if "map<" in kind else named(c) for c, kind in docs.dtypes]
        first = Window.partitionBy(named(doc_id), own).orderBy(F.xxhash64(*plain))
        some = kept.join(again, same).withColumn(one, F.row_number().over(first)).where(F.col(one) == 1)
        kept = kept.join(again, same, "left_anti").select(*map(named, columns)).unionByName(some.select(*map(named, columns)))
    return kept.select(*map(named, columns))


#: A candidate group holds about twice so many fingerprints.
CANDIDATES = 4096
#: Texts that share the least shingles in all orders of a band are candidates.
BANDS, ROWS = 32, 5
#: Orders of shingles: a rule, so that every task has the same.
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(f"order {i}") | 1 for i in range(BANDS * ROWS)], np.uint64)


#: The set of a text without words, where a set must not be empty.
WORDLESS = np.zeros(1, np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = xxhash.xxh64_intdigest
    shingles = [b" ".join(words)] if 0 < len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter((h(s, 42) for s in shingles), np.uint64))


def dealt_in_tiles(rows: DataFrame, keys: list[str], each: str, tile: int) -> DataFrame:
    """rows with t and u, sorted by keys, t, u and each within their partitions: a group of n rows is
    dealt into n / tile tiles, and every two tiles meet once; a single tile meets itself."""
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).drop("n"), "sizes")
    dealt = rows.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64(each), F.col("tiles")).cast("int"))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("own != other or tiles = 1")
    meets = meets.withColumn("t", F.least("own", "other")).withColumn("u", F.greatest("own", "other")).drop("tiles", "own", "other")
    return meets.repartition(*keys, "t", "u").sortWithinPartitions(*keys, "t", "u", each)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A key for each band, of the least shingles in as many orders as there are multipliers."""
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), SHINGLES_AT_ONCE >> 3):
        part = MULTIPLIERS[:, None] * shingles[None, at : at + (SHINGLES_AT_ONCE >> 3)]
        np.minimum(least, part.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS) + np.arange(BANDS, dtype=np.uint64)[:, None]
    return (rows * MULTIPLIERS[:ROWS]).sum(axis=1, dtype=np.uint64)


def sketches(docs: DataFrame, keep: list[str], text: str, width: int, words: int) -> DataFrame:
    """``keep`` columns, fp and bands (keys of the sketch of ``words``-word shingles) for every row."""

    def of(texts: list) -> list:
        return [[signed(fingerprint(t, width)) for t in texts], [sketch(shingle_set(t, words)).view(np.int64) for t in texts]]

    return map_texts(docs, keep, text, pa.schema([("fp", pa.int64()), ("bands", pa.list_(pa.int64()))]), lambda: of)


def spanning(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between positions that join the same fingerprints as all pairs within the radius do.

    What the pivot table leaves of a fingerprint's pairs is verified; whatever is
    joined already is not compared again.
    """
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    left, links = np.arange(len(fp)), []
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            at = np.flatnonzero((np.abs(table[left] - table[i]) <= radius).all(axis=1))
            at = at[np.bitwise_count(fp[left[at]] ^ fp[i]) <= radius]
            found, left = left[at].tolist(), np.delete(left, at)
            links += [(i, j) for j in found]
            todo += found
    return links


def linked(t: pa.Table, pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """The nodes of pairs of a table's rows, as a and b; nothing without pairs."""
    if pairs:
        a, b = np.array(pairs, np.int64).T
        node = t["node"].combine_chunks()
        yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], names=["a", "b"])


def candidate_links(sketched: DataFrame, radius: int) -> DataFrame:
    """(a, b, times): links whose components are those of all pairs within the radius that share a band; a < b, times in bands.

    sketched: node, fp and bands, one row a node. Two texts of similarity s share
    one of 32 bands of 5 with probability 1 - (1 - s^5)^32: all but three pairs in
    a million at 0.8, one in 13 at 0.3, one in 3000 at 0.1.
    """
    sent = sketched.select("node", "fp", F.explode("bands").alias("band"))
    meets = dealt_in_tiles(sent, ["band"], "node", CANDIDATES).select("band", "t", "u", "node", "fp")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ("band", "t", "u")):
            yield from linked(t, spanning(t["fp"].to_numpy().view(np.uint64), radius))

    kind = sketched.schema["node"].dataType.simpleString()
    return meets.mapInArrow(join, f"a {kind}, b {kind}").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("times"))


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 16, words: int = 5, similarity: float = 0.8, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs, with their columns, that stay when each group of similar texts keeps its smallest id.

    Two texts are similar if their fingerprints (of ``width``-word shingles) are
    within the radius and the Jaccard similarity of their ``words``-word shingles
    is at least ``similarity``; groups are the components of that. Texts that share
    a band of least shingles meet; pivot tables discard their pairs, and what is
    left is compared by fingerprints. Those links' components hold all similar
    pairs that met. In them every text is compared with its leader, the smaller text it was linked
    with in most bands; then what is outside a component's largest group of
    similar texts is compared with all of it, in blocks of bounded bytes. Texts without words are alike. Rows without an id and
    repeated ids are as in ``drop_near_duplicates``. Which texts to compare, and
    which rows go, is sent to the documents by broadcast if that takes at most
    ``broadcast_bytes``, else by a shuffle.
    """
    texts = docs.select(named(doc_id).alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text"), content(text).alias("node"))
    rows = written(sketches(texts, ["doc_id", "node"], "text", width, words), "sketches")
    each = written(rows.groupBy("node", "doc_id").agg(F.count("*").alias("n"), F.min("fp").alias("fp")), "each")
    own = F.struct("doc_id", "node", "n")
    prints = written(each.groupBy("node").agg(F.min(F.when(F.col("doc_id").isNotNull(), own)).alias("first"), F.min("fp").alias("fp")), "prints")
    sketched = written(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")), "bands")
    edges = written(candidate_links(sketched, radius), "candidates")
    rough = components(edges).withColumnRenamed("root", "part")
    # a component's root is no node of its own list; each node is read from one row of its id; components that share a hash are compared together
    parts = written(rough.unionByName(rough.select(F.col("part").alias("node"), "part")).distinct().join(prints, "node").select("node", "fp", F.xxhash64("part").alias("part"), F.col("first.doc_id").alias("doc_id"), (F.coalesce("first.n", F.lit(2)) > 1).alias("again")), "parts")
    same = (texts["node"] == parts["node"]) & texts["doc_id"].eqNullSafe(parts["doc_id"])
    met = texts.join(sent_if_small(parts, broadcast_bytes), same).select(parts["node"], "fp", "part", "again", "text")
    found = met.where(~F.col("again")).select("node", "fp", "part", "text")
    if not parts.where("again").isEmpty():  # only rows that repeat must be brought together
        found = found.unionByName(met.where("again").groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "part", "text")]))

    def of(ts: list) -> list:
        sets = [shingle_set(t, words) for t in ts]
        sets = [s if len(s) else WORDLESS for s in sets]
        return [[len(s) for s in sets], [s.tobytes() for s in sets]]

    sets = written(map_texts(found, ["node", "fp", "part"], "text", pa.schema([("n", pa.int64()), ("shingles", pa.binary())]), lambda: of), "shingles")
    leaders = edges.groupBy(F.col("b").alias("node")).agg(F.min(F.struct(-F.col("times"), "a")).alias("m")).select("node", F.col("m.a").alias("leader"))
    roots = components(joined_in_groups(sets.drop("part"), leaders, sets.select(F.col("part").alias("g"), "node"), 100 * similarity, radius))
    stay = prints.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("stay")).where("stay is not null").select("stay.*")
    return one_each(docs, each.where("doc_id is not null"), stay, doc_id, text, broadcast_bytes)
