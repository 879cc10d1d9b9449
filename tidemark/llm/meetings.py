"""Rows that meet in groups: streams cut into groups, components of links, and sets compared in blocks of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Two tiles of about so many bytes of shingles meet in a block.
TILE_BYTES = 4 << 20


def by_group(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of rows with equal integers in ``names``, from batches sorted by them."""
    rest: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        key = np.stack([t[c].to_numpy().astype(np.int64) for c in names], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        if last is not None and (key[0] != last).any():
            yield pa.concat_tables(rest)
            rest = []
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s:
                yield pa.concat_tables(rest)
                rest = []
            rest.append(t.slice(s, e - s))
        last = key[-1]
    if rest:
        yield pa.concat_tables(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes with an edge.

    Large stars hang a node's larger neighbours on its smallest; small stars hang
    the smaller ones. Every round is written, and ends when the edges stay.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct(), "stars")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi != lo").distinct()
        edges = written(small, "stars")


def bytes_of(which: Column) -> Column:
    return F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) * 8


def joined_in_block(query: np.ndarray, outside: np.ndarray, rank: np.ndarray, label: np.ndarray, sets: list[np.ndarray], percent: float, fp: np.ndarray | None = None, radius: int = 0) -> list[tuple[int, int]]:
    """Links (positions) between queries and others of a block that join what all its alike pairs do.

    label: rows of equal label are joined from the start. Of two rows that are both
    queries somewhere (outside) only one meets the other, by rank. With fingerprints, alike
    rows link only within the radius. No set is empty.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(len(words), np.int32)
    links = []
    for a in np.flatnonzero(query).tolist():
        may = ~query & (label != label[a]) & (100 * np.minimum(sizes, sizes[a]) >= percent * np.maximum(sizes, sizes[a])) & (~outside | (rank > rank[a]))
        if fp is not None:
            may &= np.bitwise_count(fp ^ fp[a]) <= radius
        at = np.flatnonzero(may)
        if not len(at):
            continue
        own = ids[starts[a] : starts[a] + sizes[a]]
        flag[own] = 1
        if 4 * sizes[at].sum() < len(ids):
            some = np.concatenate([ids[s : s + n] for s, n in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)])
            common = np.add.reduceat(flag[some], np.cumsum(sizes[at]) - sizes[at])
        else:
            common = np.add.reduceat(flag[ids], starts)[at]
        flag[own] = 0
        for b in at[100 * common >= percent * (sizes[at] + sizes[a] - common)].tolist():
            if label[b] != label[a]:
                links.append((a, b))
                label[label == label[b]] = label[a]
    return links


def met_in_blocks(rows: DataFrame, sets: DataFrame, groups: DataFrame, percent: float, radius: int | None = None) -> DataFrame:
    """(a, b): links found when the queries of each group meet its rows, block by block.

    rows: g (the group), node, part (nodes of one part are joined already), query. sets: node, n, shingles; they are
    joined when rows have their blocks, and shuffled to those only.
    groups: g, queries and others, the bytes of its queries' and of its other rows' sets. A group's queries are dealt into
    tiles of ``TILE_BYTES``, and so are all its rows; every tile of queries meets every tile of rows.
    With a radius, sets have a fingerprint fp too, and only those within it link.
    """
    prints = [] if radius is None else ["fp"]
    tiles = lambda c: F.ceil(F.col(c) / TILE_BYTES).cast("int")
    dealt = rows.join(groups.select("g", F.greatest(tiles("queries"), F.lit(1)).alias("is"), F.greatest(F.ceil((F.col("queries") + F.col("others")) / TILE_BYTES).cast("int"), F.lit(1)).alias("js")), "g")
    tile = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_row = F.transform(every("is"), lambda i: F.struct(i.alias("i"), tile("js").alias("j"), F.lit(False).alias("asks")))
    as_query = F.transform(every("js"), lambda j: F.struct(tile("is").alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    sent = dealt.withColumn("b", F.explode(F.when(F.col("query"), F.concat(as_row, as_query)).otherwise(as_row)))
    placed = sent.select("g", "b.i", "b.j", "b.asks", F.col("query").alias("outside"), "node", "part")
    blocks = placed.join(sets, "node").select("g", "i", "j", "asks", "outside", "node", "part", *prints, "shingles").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ("g", "i", "j")):
            asks = t["asks"].to_numpy()
            if not asks.any() or asks.all():
                continue
            nodes = t["node"].to_pylist()
            number = lambda values: np.unique(np.array(values, object), return_inverse=True)[1]
            sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
            fp = t["fp"].to_numpy().view(np.uint64) if prints else None
            links = joined_in_block(asks, t["outside"].to_numpy(), number(nodes), number(t["part"].to_pylist()), sets, percent, fp, radius or 0)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return blocks.mapInArrow(run, "a binary, b binary")


def united(placed: DataFrame) -> DataFrame:
    """g, node, part and n of the groups (in placed) whose nodes are in several parts, where groups that a node or part links are one.

    So a node that is in many groups is sent once. A union whose sets take more than ``TILE_BYTES`` keeps its groups as they are:
    what meets in it is bounded by them.
    """
    mixed = placed.groupBy("g").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").drop("hi")
    live = written(placed.join(mixed, "g"), "live")
    roots = components(live.select(F.col("part").alias("a"), F.col("lo").alias("b")))
    root = F.coalesce("root", "part")
    nodes = written(live.select("node", "part", "n").distinct().join(roots.withColumnRenamed("node", "part"), "part", "left").withColumn("root", root), "united")
    small = written(nodes.groupBy("root").agg(F.sum("n").alias("n")).where(F.col("n") * 8 <= TILE_BYTES).select("root"), "small")
    one = nodes.join(small, "root").select(F.xxhash64("root").alias("g"), "node", "part", "n")
    large = nodes.join(small, "root", "left_anti").select("node")
    return one.unionByName(live.select("g", "node", "part", "n").join(large, "node"))


def joined_in_groups(sets: DataFrame, leaders: DataFrame, members: DataFrame, percent: float, radius: int | None = None, overlapping: bool = False) -> DataFrame:
    """(a, b): links whose components are those of all alike pairs that share a group.

    With ``overlapping``, for nodes that are in many groups, alike pairs that meet through other groups may link as well.

    sets: node, n, shingles (and fp, with a radius), a written table of one row a node; leaders: node, leader; members: g,
    node. First every node meets its leader, so a group of copies costs one comparison a node. Then only
    groups whose nodes are still in several components matter: of each, the nodes outside its largest component meet all its nodes.
    """
    stars = leaders.unionByName(leaders.select(F.col("leader").alias("node"), "leader").distinct())
    stars = written(stars.select(F.xxhash64("leader").alias("g"), "node", (F.col("node") == F.col("leader")).alias("query")), "leaders")
    sized = stars.join(sets.select("node", "n"), "node").groupBy("g").agg(bytes_of(F.col("query")).alias("queries"), bytes_of(~F.col("query")).alias("others"))
    first = met_in_blocks(stars.withColumn("part", F.col("node")), sets, written(sized, "groups"), percent, radius)
    first = written(first, "links")
    parts = written(sets.select("node", "n").join(components(first), "node", "left").select("node", "n", F.coalesce("root", "node").alias("part")), "parts")
    placed = written(members.join(parts, "node"), "placed")
    if overlapping:
        placed = written(united(placed), "united")
    each = placed.groupBy("g", "part").agg(F.count("*").alias("times"), F.sum("n").alias("n"))
    mixed = each.groupBy("g").agg(F.count("*").alias("parts"), F.max(F.struct("times", "part", "n")).alias("main"), F.sum("n").alias("n")).where("parts > 1")
    mixed = written(mixed.select("g", F.col("main.part").alias("main"), ((F.col("n") - F.col("main.n")) * 8).alias("queries"), (F.col("main.n") * 8).alias("others")), "mixed")
    asked = placed.join(mixed.select("g", "main"), "g").select("g", "node", "part", (F.col("part") != F.col("main")).alias("query"))
    second = met_in_blocks(written(asked, "asked"), sets, mixed.drop("main"), percent, radius)
    return first.unionByName(written(second, "links"))
