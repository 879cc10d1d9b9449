"""Vector codes, min-max near-duplicates and hard negatives, against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, meetings, minmax, vector_codes
from tidemark.llm.vectors import LARGEST, floored, matrix

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, q string, near int"


def vectors(spark, rows):
    """Rows (id, vector, label) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, k, "q", 1) for i, v, k in rows], SCHEMA)


def made(n, dim, seed, spread=0.3):
    """Vectors around a few centres, some of them equal."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dim))
    v = (centres[r.integers(0, 5, n)] + spread * r.normal(size=(n, dim))).astype(np.float32)
    v[:: 7] = v[0]
    return v.tolist()


ODD = [(900, None, 1), (901, [0.1, None, 0.3, 0.4], 1), (902, [NAN, 0.0, 0.0, 0.0], 1), (903, [0.0, INF, 0.0, 0.0], 2), (904, [], 3), (905, [1.0], 3)]


def brute_codes(rows, positions, entries, rounds, scale=1024):
    """(code, error) of each row, and the codebooks, in plain whole numbers."""
    q = [[math.floor(float(x) * scale) for x in v] for _, v, _ in rows]
    w = len(q[0]) // positions
    parts = [[tuple(v[p * w : p * w + w]) for v in q] for p in range(positions)]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, q[i]))[:entries]
    books = [[parts[p][i] for i in first] for p in range(positions)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p: [min(range(len(books[p])), key=lambda e: (d(x, books[p][e]), e)) for x in parts[p]]
    for _ in range(rounds):
        for p in range(positions):
            at = nearest(p)
            for e in set(at):
                own = [parts[p][i] for i in range(len(at)) if at[i] == e]
                books[p][e] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    codes = list(zip(*map(nearest, range(positions)), strict=True))
    errors = [sum(d(parts[p][i], books[p][c[p]]) for p in range(positions)) for i, c in enumerate(codes)]
    return codes, errors, ",".join(str(x) for b in books for e in b for x in e)


def test_codes(spark):
    rows = [(i, v, i % 3 if i % 4 else None) for i, v in enumerate(made(70, 4, 1))] + [(None, [0.5, -0.5, 0.25, 1.0], 7), (3, [0.5, 0.5, 0.5, 0.5], 1)]
    found, books = vector_codes.compress(vectors(spark, rows + ODD), positions=2, entries=9, rounds=3, pivots=3)
    codes, errors, text = brute_codes(rows, 2, 9, 3)
    want = sorted((str(i), k, list(c), e) for (i, _, k), c, e in zip(rows, codes, errors, strict=True) for k in [str(k)])
    assert sorted((str(r["vec_id"]), str(r["label"]), r["code"], r["error"]) for r in found.collect()) == want
    assert books.sha256() == hashlib.sha256(text.encode()).hexdigest()
    sums: dict = {}
    for (_, _, k), e in zip(rows, errors, strict=True):
        sums[k] = sums.get(k, 0) + e
    for limit in (0, 1 << 20):
        out = vector_codes.with_label_errors(found, limit).collect()
        assert len(out) == len(rows) and all(r["label_error"] == sums[r["label"]] for r in out)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(5, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0, 2.0, 3.0, 4.0], None)]
    found, books = vector_codes.compress(vectors(spark, rows))
    assert [(r["code"], r["error"]) for r in found.collect()] == [([0] * 4, 0)] * 2 and books.entries.shape == (4, 2, 1)
    for none in (vectors(spark, []), vectors(spark, ODD[:3])):
        found, books = vector_codes.compress(none)
        assert vector_codes.with_label_errors(found).columns == ["vec_id", "label", "code", "error", "label_error"] and found.count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(vectors(spark, [(1, [1.0, 2.0, 3.0], 1)]))


def test_pivots_prune_and_stay_exact():
    q = matrix_of(made(3000, 16, 2, 0.05))
    entries = q[:256]
    pivots = vector_codes.far_apart(entries, 8)
    near = vector_codes.distances(q, pivots).astype(np.float32)
    at, best, evaluated = vector_codes.nearest(q, near, entries, pivots)
    d = ((q[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (at == d.argmin(axis=1)).all()
    assert evaluated < 0.5 * d.size
    large = q * 60_000  # floats of 32 bits no longer tell all distances apart
    near = vector_codes.distances(large, large[:5]).astype(np.float32)
    at, best, _ = vector_codes.nearest(large, near, large[:256], large[:5])
    d = ((large[:, None] - large[None, :256]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (at == d.argmin(axis=1)).all()


def matrix_of(v):
    return np.floor(np.array(v, np.float64) * 256).astype(np.int64)


def test_floored_and_too_large(spark):
    got = floored(vectors(spark, [(1, [-0.1, 0.1], 1), *ODD[:4]]), "vec_id", "label", "embedding", 1024).collect()
    assert [(r["vec_id"], r["q"]) for r in got] == [(1, [math.floor(1024 * float(np.float32(-0.1))), 102])]
    import pyarrow as pa

    with pytest.raises(ValueError, match="component"):
        matrix(pa.array([[LARGEST]]))


# min-max near-duplicates


def brute_near(rows, percent=80):
    """(n, component) of each row."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").translate(lower)) if x]
        sets.append(frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [(len(s), least.get(root(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def copies(seed, groups=12, size=8):
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [r.choice("abcdefghijklmnop") + r.choice("xyz") for _ in range(r.randrange(3, 60))]
        for _ in range(r.randrange(1, size)):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 3))):
                w[r.randrange(len(w))] = r.choice(("NEW", "Other", "x"))
            rows.append(" ".join(w))
    r.shuffle(rows)
    return rows


ODD_TEXTS = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE "), (905, "é É"), (906, "É é"), (None, "one"), (None, None), (907, "a\xa0b c"), (903, "two words"), (903, "one"), (903, "one")]


@pytest.mark.parametrize(("tile", "broadcast"), [(1 << 22, 1 << 20), (400, 0)])
def test_minmax(spark, monkeypatch, tile, broadcast):
    monkeypatch.setattr(meetings, "TILE_BYTES", tile)
    rows = [(i + 10, t) for i, t in enumerate(copies(3))] + ODD_TEXTS + [(990, "w " * 30_000), (991, "w " * 20_000 + "v")]
    docs = spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], "doc_id long, text string, node string, n int, kept boolean")
    out = minmax.near_duplicates(docs, broadcast_bytes=broadcast).collect()
    want = sorted((str(i), n, str(c), c is not None and c == i) for (i, _), (n, c) in zip(rows, brute_near(rows), strict=True))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in out) == want


def test_minmax_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minmax.near_duplicates(none).collect() == []
    assert [tuple(r) for r in minmax.near_duplicates(spark.createDataFrame([(1, None)], none.schema)).collect()] == [(1, 0, 1, True)]


def test_signatures_keep_both_ends():
    x = minmax.Shingles(2).of(" ".join(map(str, range(500))))
    least, greatest = minmax.signature(x)
    permuted = minmax.MULTIPLIERS[:, None] * x[None]
    assert (least == permuted.min(axis=1)).all() and (greatest == permuted.max(axis=1)).all() and len(x) == 499
    # the share of equal values estimates the similarity, 400 of 498 here
    r, hits = random.Random(1), []
    for _ in range(30):
        words = [str(r.random()) for _ in range(450)]
        a, b = (minmax.signature(minmax.Shingles(1).of(" ".join(w))) for w in (words[:425], words[25:]))
        hits.append((a == b).mean())
    assert abs(np.mean(hits) - 400 / 450) < 0.01


def test_links_are_a_forest_of_what_is_alike():
    sets = [np.arange(s, s + 100, dtype=np.uint64) for s in (0, 2, 4, 50, 300, 302)]
    n = len(sets)
    ask, outside = np.array([True] * n + [False] * n), np.ones(2 * n, bool)
    links = meetings.joined_in_block(ask, outside, np.tile(np.arange(n), 2), np.tile(np.arange(n), 2), sets + sets, 80)
    assert sorted({(min(a % n, b % n), max(a % n, b % n)) for a, b in links}) == [(0, 1), (0, 2), (4, 5)]


# hard negatives


def brute_negatives(rows, every, k_pos, k_neg, scale=256):
    one: dict = {}
    for i, v, k in rows:
        if i is not None and k is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(float(np.float32(x)) * scale) for x in v]
            one[i] = min(one.get(i, (k, q)), (k, q))
    out = []
    for a, (label, q) in one.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, p, strict=True)), i, k == label) for i, (k, p) in one.items() if i != a)
        for s, p, _ in [x for x in scores if x[2]][:k_pos]:
            ok = [(n, -t) for t, n, same in scores if not same and 50 * -s <= 100 * -t <= 95 * -s][:k_neg]
            out += [(a, p, r, n, -s, t) for r, (n, t) in enumerate(ok, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "files"), [(4096, 4096), (16, 3)])
def test_hard_negatives(spark, monkeypatch, block, files):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", files)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 4)
    rows = [(i, v, int(i % 5 == 2)) for i, v in enumerate(made(150, 4, 5))] + [(200, [0.0] * 4, 0), (205, [0.0] * 4, 0), (210, [0.0] * 4, 1), (300, [1.0] * 4, None), (None, [1.0] * 4, 1), (40, [9.0] * 4, 0)]
    found = hard_negatives.mine(vectors(spark, rows + ODD), F.col("vec_id") % 10 == 0)
    got = sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute_negatives(rows + ODD, 10, 5, 3) and len(got) > 30
    assert hard_negatives.mine(vectors(spark, []), F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("spread", [0.0, 0.02, 1.0])
def test_covering_radii_hold_and_skip(spread):
    q = matrix_of(made(2000, 16, 6, spread))
    t = hard_negatives.CoverTree(q)
    assert sorted(t.order.tolist()) == list(range(len(q)))
    more = np.sqrt(np.maximum(t.norm**2 - (q.astype(float) ** 2).sum(axis=1), 0))
    unit = np.concatenate([q, more[:, None]], axis=1) / t.norm
    for k in range(len(t.first)):
        rows = t.order[t.start[k] : t.end[k]]
        assert np.arccos(np.clip(unit[rows] @ unit[t.centre[k]], -1, 1)).max() <= t.radius[k]
        if t.first[k] < t.last[k]:
            assert t.start[t.first[k]] == t.start[k] and t.end[t.last[k] - 1] == t.end[k]
    block = hard_negatives.Block(t, np.arange(len(q)), np.zeros(len(q), np.int64), q)
    anchors = q[:20]
    lower, upper = block.bounds(anchors)
    scores = block.q @ anchors.T
    for k in range(len(t.first)):
        s = scores[t.start[k] : t.end[k]]
        assert (s >= lower[:, k]).all() and (s <= upper[:, k]).all()
    if 0 < spread < 1:  # clusters: most nodes lie outside a narrow window
        s = np.sort(scores[:, 0])
        assert ((upper[0] < s[-100]) | (lower[0] > s[-1])).mean() > 0.5


@pytest.mark.parametrize("tile", [200, 1 << 20])
def test_a_node_of_many_groups_is_sent_once(spark, monkeypatch, tile):
    """Ten nodes, no two alike but one pair, that meet in 30 overlapping groups: their sets are sent once, or group by group where they fit no block."""
    monkeypatch.setattr(meetings, "TILE_BYTES", tile)
    sent = []
    met = meetings.met_in_blocks
    monkeypatch.setattr(meetings, "met_in_blocks", lambda rows, *rest: sent.append(rows.count()) or met(rows, *rest))
    own = {b"%d" % k: np.arange(20 * k, 20 * k + 20, dtype=np.uint64) for k in range(9)} | {b"x": np.arange(1, 21, dtype=np.uint64)}
    sets = spark.createDataFrame([(n, 20, bytearray(x.tobytes())) for n, x in own.items()], "node binary, n int, shingles binary")
    r = random.Random(1)
    members = spark.createDataFrame([(g, n) for g in range(30) for n in {b"0", b"x", *r.sample(sorted(own), 5)}], "g long, node binary")
    leaders = spark.createDataFrame([(n, b"1") for n in own if n != b"1"], "node binary, leader binary")
    links = meetings.joined_in_groups(sets, leaders, members, 80, overlapping=True).collect()
    assert {frozenset((bytes(x["a"]), bytes(x["b"]))) for x in links} == {frozenset((b"0", b"x"))}
    assert (sent[1] == len(own)) == (tile > 200)


@pytest.mark.parametrize("tile", [200, 1 << 20])
def test_groups_are_joined_as_by_all_pairs(spark, monkeypatch, tile):
    """Whatever the leaders, groups of copies, chains and strangers get the components of all alike pairs within the radius."""
    monkeypatch.setattr(meetings, "TILE_BYTES", tile)
    r = random.Random(4)
    rows, sets = [], {}
    for g in range(6):
        base = set(r.sample(range(1, 10_000), 40))
        for k in range(14):
            own = set(base)
            if k % 3 == 0:  # a chain
                base = set(list(base)[4:]) | set(r.sample(range(1, 10_000), 3))
            elif k % 5 == 0:
                own = set(r.sample(range(1, 10_000), 40))
            node, fp = b"%d-%d" % (g, k), r.choice([0, 1, 3, (1 << 40) - 1])
            sets[node] = (g, fp, own)
            rows.append((node, fp, len(own), bytearray(np.sort(np.array(list(own), np.uint64)).tobytes()), g))
    table = spark.createDataFrame(rows, "node binary, fp long, n int, shingles binary, g long")
    leaders = spark.createDataFrame([(n, r.choice([m for m in sets if sets[m][0] == sets[n][0]])) for n in sets if r.random() < 0.7], "node binary, leader binary")
    leaders = leaders.where("node != leader")
    for radius in (None, 2):
        own = table.drop("g") if radius else table.drop("g", "fp")
        links = meetings.joined_in_groups(own, leaders, table.select("g", "node"), 80, radius)
        got = {bytes(x["node"]): bytes(x["root"]) for x in meetings.components(links).collect()}
        root = {n: n for n in sets}
        for a in sorted(sets):
            for b in sorted(sets):
                (g, p, s), (h, q, t) = sets[a], sets[b]
                if a < b and g == h and (not radius or (p ^ q).bit_count() <= 2) and 5 * len(s & t) >= 4 * len(s | t) and root[a] != root[b]:
                    lo, hi = sorted((root[a], root[b]))
                    root = {n: lo if x == hi else x for n, x in root.items()}
        assert {n: got.get(n, n) for n in sets} == root and len(set(root.values())) < len(sets)
