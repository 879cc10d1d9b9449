"""Hard-negative mining: cover trees over norm-augmented candidates.

A row's score is its inner product with an anchor. One more coordinate,
sqrt(M^2 - |x|^2), gives all candidates of a block the norm M, so that the score is |q| M cos(angle) and
triangles of angles bound it: in a node of a cover tree, whose centre is at the angle t to the anchor and
whose rows are within r of the centre, scores lie between |q| M cos(t + r) and |q| M cos(t - r).

Candidates are dealt by id into blocks of bounded size, whose trees are written
once. Anchors are a table of files of bounded size in the shared folder; a task streams them past its trees, so neither a
shuffle nor the driver carries them. The search descends best-first: nodes in the order of their
upper bound, skipping those outside the windows of scores still wanted, and computes the whole-number
scores of leaves exactly. Spark ranks what the blocks return, a bounded number of rows for each anchor and block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_dir, give_back, written
from .simhash import by_group
from .stores import filesystem, list_files
from .vectors import floored, matrix

#: Rows of a block, at most about; a leaf's, unless its rows are alike; anchors in a file.
BLOCK_ROWS, LEAF_ROWS, ANCHORS_AT_ONCE = 4096, 32, 4096
#: From one level to the next the covering radius shrinks by this.
BASE = 1.3
#: Angles are kept with so much to spare: arc cosines near 1 err by some 1e-8.
SPARE = 1e-6
#: Nodes that a search opens first, and in each turn twice as many as before.
FIRST_NODES = 8


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows: by floats where these hold them, as they are multiplied faster."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if largest < 1 << 53 else a @ b.T


class CoverTree:
    """Nodes in the order of their levels: centre (a row), radius (an angle), children [first, last), rows [start, end).

    A node's children are centres chosen farthest first until they cover its rows within its
    level's radius; the node's own centre is the first of them. A leaf has no children.
    """

    def __init__(self, q: np.ndarray):
        self.norm = float(np.sqrt((q.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))
        more = np.sqrt(np.maximum(self.norm**2 - (q.astype(np.float64) ** 2).sum(axis=1), 0.0))
        unit = np.concatenate([q, more[:, None]], axis=1) / (self.norm or 1.0)
        order = np.arange(len(q))
        nodes: list[list] = []  # centre, radius, first child, last child, start, end
        away = angles(unit @ unit[0])
        level = [(0, away, 0, len(q))]
        nodes.append([0, float(away.max(initial=0.0)), 0, 0, 0, len(q)])
        turn, reach = 0, float(away.max(initial=0.0))
        while level:
            reach /= BASE
            below = []
            for centre, away, s, e in level:
                node = nodes[turn]
                turn += 1
                if e - s <= LEAF_ROWS or node[1] <= SPARE:
                    continue
                target = min(reach, node[1] / BASE)  # a node that one centre would cover goes on at its own radius
                mine = unit[order[s:e]]
                least, of, centres = away.copy(), np.zeros(e - s, np.int64), [centre]
                while least.max() > target and len(centres) < e - s:
                    far = int(least.argmax())
                    centres.append(int(order[s + far]))
                    new = angles(mine @ mine[far])
                    new[far] = 0.0
                    of[new < least] = len(centres) - 1
                    np.minimum(least, new, out=least)
                by = np.argsort(of, kind="stable")
                order[s:e], least, of = order[s:e][by], least[by], of[by]
                cuts = np.searchsorted(of, np.arange(len(centres) + 1))
                node[2], node[3] = len(nodes), len(nodes) + len(centres)
                for k, c in enumerate(centres):
                    lo, hi = int(cuts[k]), int(cuts[k + 1])
                    nodes.append([c, float(least[lo:hi].max(initial=0.0)), 0, 0, s + lo, s + hi])
                    below.append((c, least[lo:hi], s + lo, s + hi))
            level = below
        self.order = order
        table = np.array(nodes, np.float64).reshape(-1, 6)
        self.radius = table[:, 1] + SPARE
        self.centre, self.first, self.last, self.start, self.end = table[:, [0, 2, 3, 4, 5]].astype(np.int64).T

    #: What a block's row holds of its tree.
    SCHEMA = pa.schema([("norm", pa.float64()), ("rows", pa.list_(pa.int32())), ("radius", pa.list_(pa.float64())), ("nodes", pa.list_(pa.int32()))])

    def row(self) -> list:
        return [self.norm, self.order.tolist(), self.radius.tolist(), np.stack([self.centre, self.first, self.last, self.start, self.end]).ravel().tolist()]

    @classmethod
    def of_row(cls, norm: float, rows: np.ndarray, radius: np.ndarray, nodes: np.ndarray) -> CoverTree:
        t = cls.__new__(cls)
        t.norm, t.order, t.radius = norm, rows.astype(np.int64), radius
        t.centre, t.first, t.last, t.start, t.end = nodes.astype(np.int64).reshape(5, -1)
        return t


class Block:
    """Rows with ids, labels (numbers of the block's own) and vectors in the order of their tree's leaves."""

    def __init__(self, tree: CoverTree, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.tree = tree
        self.ids, self.labels, self.q = ids[tree.order], labels[tree.order], q[tree.order]
        self.centres = q[tree.centre]
        leaf = np.flatnonzero(tree.first == tree.last)
        self.leaf_of = np.zeros(len(ids), np.int64)
        for k in leaf.tolist():
            self.leaf_of[tree.start[k] : tree.end[k]] = k
        self.is_leaf = np.zeros(len(tree.first), bool)
        self.is_leaf[leaf] = True

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper): anchors x nodes."""
        t = self.tree
        reach = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1)) * t.norm
        at = angles(products(anchors, self.centres) / np.where(reach > 0, reach, 1.0)[:, None])
        upper = reach[:, None] * np.cos(np.maximum(at - t.radius, 0.0))
        lower = reach[:, None] * np.cos(np.minimum(at + t.radius, np.pi))
        spare = 1e-9 * reach[:, None] + 1e-3
        return lower - spare, upper + spare

    def search(self, anchor: np.ndarray, lower: np.ndarray, upper: np.ndarray, want: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[np.ndarray]:
        """For each window [lo, hi] the rows (positions) of the k best scores in it, best first, ties by id, of the wanted rows."""
        t = self.tree
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows)
        floors = np.array([float(lo) for lo, _ in windows])  # what a row must reach to count, for each window
        tops = np.array([float(hi) for _, hi in windows])
        open_ = np.array([0])
        chosen = np.zeros(len(t.first), bool)
        step = FIRST_NODES
        while len(open_):
            alive = ((upper[open_, None] >= floors) & (lower[open_, None] <= tops)).any(axis=1)
            open_ = open_[alive]
            open_ = open_[np.argsort(-upper[open_], kind="stable")]
            now, open_ = open_[:step], open_[step:]
            step *= 2
            inner, leaves = now[~self.is_leaf[now]], now[self.is_leaf[now]]
            if len(inner):
                open_ = np.concatenate([open_, *[np.arange(t.first[i], t.last[i]) for i in inner.tolist()]])
            if len(leaves):
                chosen[leaves] = True
                rows = np.flatnonzero(chosen[self.leaf_of] & want)
                chosen[leaves] = False
                scores = self.q[rows] @ anchor
                for w, (lo, hi) in enumerate(windows):
                    ok = (scores >= floors[w]) & (scores <= hi)
                    at, s = np.concatenate([found[w][0], rows[ok]]), np.concatenate([found[w][1], scores[ok]])
                    if len(at) > k:
                        best = np.lexsort((self.ids[at], -s))[:k]
                        at, s = at[best], s[best]
                    if len(at) == k:
                        floors[w] = float(s.min())
                    found[w] = (at, s)
        return [at[np.lexsort((self.ids[at], -s))] for at, s in found]


def write_anchors(anchors: DataFrame) -> str:
    """A folder of Parquet files of ``ANCHORS_AT_ONCE`` anchors at most."""
    folder = fresh_dir(anchors.sparkSession, "anchors")
    anchors.write.option("maxRecordsPerFile", ANCHORS_AT_ONCE).parquet(folder)
    return folder


def streamed(trees: DataFrame, folder: str, search: Callable, schema: str) -> DataFrame:
    """Rows (lists, in the order of the schema's columns) that search(block, labels, anchors) finds, each block of trees meeting every file of anchors."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            blocks = []
            for r in range(batch.num_rows):
                one = {c: batch[c].slice(r, 1) for c in batch.schema.names}
                flat = lambda c: one[c].flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                tree = CoverTree.of_row(one["norm"][0].as_py(), flat("rows"), flat("radius"), flat("nodes"))
                ids = flat("ids")
                known: dict = {}
                labels = np.array([known.setdefault(x, len(known)) for x in one["labels"][0].as_py()], np.int64)
                blocks.append((Block(tree, ids, labels, flat("q").astype(np.int64).reshape(len(ids), -1)), known))
            for path, _ in list_files(folder, ".parquet"):
                with fs.open_input_file(path) as f:
                    anchors = pq.read_table(f)
                for block, known in blocks:
                    rows = search(block, known, anchors)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
            blocks = anchors = None
        give_back()

    return trees.mapInArrow(run, schema)


def trees_of(candidates: DataFrame, n: int) -> DataFrame:
    """A row for each block of candidates (vec_id, label, q): its tree, ids, labels and vectors, written."""
    blocks = max(1, -(-n // BLOCK_ROWS))
    dealt = candidates.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).repartition("block").sortWithinPartitions("block", "vec_id")
    label = candidates.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ("block",)):
            q = matrix(t["q"])
            values = [*CoverTree(q).row(), t["vec_id"].to_pylist(), t["label"].to_pylist(), q.ravel().tolist()]
            types = [*CoverTree.SCHEMA.types, pa.list_(pa.int64()), pa.list_(t["label"].type), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, types, strict=True)], names=[*CoverTree.SCHEMA.names, "ids", "labels", "q"])
        give_back()

    return written(dealt.mapInArrow(run, f"norm double, rows array<int>, radius array<double>, nodes array<int>, ids array<long>, labels array<{label}>, q array<int>"), "trees")


def positives_search(k: int) -> Callable:
    whole = [(-(1 << 62), 1 << 62)]

    def search(block: Block, known: dict, anchors: pa.Table) -> list[tuple]:
        q, out = matrix(anchors["q"]), []
        ids, labels = anchors["vec_id"].to_pylist(), anchors["label"].to_pylist()
        for s in range(0, len(ids), 256):
            lower, upper = block.bounds(q[s : s + 256])
            for i, (own, label) in enumerate(zip(ids[s : s + 256], labels[s : s + 256], strict=True)):
                if label in known:
                    (at,) = block.search(q[s + i], lower[i], upper[i], (block.labels == known[label]) & (block.ids != own), whole, k)
                    out += [(own, int(x), int(score)) for x, score in zip(block.ids[at], block.q[at] @ q[s + i], strict=True)]
        return out

    return search


def negatives_search(k: int, low: int, high: int) -> Callable:
    def search(block: Block, known: dict, anchors: pa.Table) -> list[tuple]:
        q, out = matrix(anchors["q"]), []
        ids, labels, positives = anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), anchors["positives"].to_pylist()
        for s in range(0, len(ids), 256):
            lower, upper = block.bounds(q[s : s + 256])
            for i, (own, label, near) in enumerate(zip(ids[s : s + 256], labels[s : s + 256], positives[s : s + 256], strict=True)):
                # low * p <= 100 * n <= high * p, in whole numbers
                windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in near]
                some = [(p, w) for p, w in zip(near, windows, strict=True) if w[0] <= w[1]]
                if some:
                    found = block.search(q[s + i], lower[i], upper[i], block.labels != known.get(label, -1), [w for _, w in some], k)
                    for (p, _), at in zip(some, found, strict=True):
                        out += [(own, p["vec_id"], p["score"], int(x), int(score)) for x, score in zip(block.ids[at], block.q[at] @ q[s + i], strict=True)]
        return out

    return search


def best(rows: DataFrame, keys: list[str], score: str, vec_id: str, k: int) -> DataFrame:
    """The k rows of each group with the highest score, ties by id, with their rank; Spark drops the others before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), vec_id)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor tells, by a column ``vec_id``, which rows are anchors. An anchor's positives are the ``positives``
    best other rows of its label; the negatives of each are the ``negatives`` best rows of other labels
    whose score lies within ``low`` to ``high`` per cent of the positive's. Rows without an id (a whole number) or a label
    take no part, nor do rows whose vector is null, empty, of another length, or
    holds a null or a component that isn't finite. Of rows that repeat an id one counts, that of the
    least label, then the least vector. Anchors without a positive or a negative have no row; no rows give none.
    """
    sound = floored(rows, vec_id, label, vector, scale).where("vec_id is not null and label is not null")
    candidates = written(sound.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct("label", F.col("q").cast("array<int>").alias("q"))).alias("r")).select("vec_id", "r.*"), "candidates")
    n = candidates.count()
    spark = rows.sparkSession
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    trees = trees_of(candidates, n)
    anchors = candidates.where(is_anchor)
    met = streamed(trees, write_anchors(anchors), positives_search(positives), "anchor_id long, vec_id long, score long")
    near = best(met, ["anchor_id"], "score", "vec_id", positives).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    asked = anchors.join(near, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    found = streamed(trees, write_anchors(asked), negatives_search(negatives, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return best(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
