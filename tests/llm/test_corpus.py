"""Operators across texts, against brute force: decontamination, SimHash, lines, media, WARC, the pipeline."""

import base64
import hashlib
import os
import random
import shutil
import zipfile
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lines, media, meetings, simhash, warc
from tidemark.llm.common import fresh_dir
from tidemark.llm.stores import Stretch, filesystem, list_files

from .test_texts import docs

R = random.Random(5)


def local(path):
    return filesystem(path)[1]


# decontamination


def brute_contamination(text, items, width=10):
    words = decontaminate.words_of(text)
    hit, ids = set(), set()
    for item_id, t in items:
        w = decontaminate.words_of(t)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            p = w[i : i + width]
            for s in range(len(words) - len(p) + 1):
                if words[s : s + len(p)] == p:
                    hit.update(range(s, s + len(p)))
                    ids.add(str(item_id))
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination(spark, block_bytes):
    say = lambda n: " ".join(R.choice(["a", "B", "c1", "é"]) for _ in range(n))
    items = [(i, say(R.randrange(1, 15))) for i in range(8)] + [(50, None), (51, ""), (52, "..."), (0, "c1 c1 c1"), (53, "z, z")]
    rows = [(i, say(R.randrange(0, 80)), "en") for i in range(60)] + [(100, None, "en"), (101, "", "en"), (None, "z z z", "en"), (102, "Z-z", "en"), (102, "Z-z", "en"), (103, "a " * 30_000, "en")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_contamination(docs(spark, rows), bench, ["doc_id"], block_bytes=block_bytes).collect()
    by_id = {i: t for i, t, _ in rows}
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] != 103:
            assert (r["n_words"], r["n_hit"], r["items"]) == brute_contamination(by_id[r["doc_id"]], items), r
    kept = decontaminate.drop_contaminated(docs(spark, rows), bench, block_bytes=block_bytes)
    assert kept.columns == docs(spark, rows).columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in out if not r["n_hit"])
    assert decontaminate.find_contamination(docs(spark, rows), bench.limit(0), ["doc_id"]).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find_contamination(docs(spark, []), bench, ["doc_id"]).count() == 0


def test_shifts_skip_words():
    p = [f"w{i}" for i in range(10)]
    search = decontaminate.WuManber([("1", " ".join(p))], 10)
    (table,) = search.tables
    at = lambda words: table.shift[table.slot(decontaminate.window_hashes(decontaminate.word_hashes(words), table.block))][0]
    assert at(p[-2:]) == 0 and at(p[:2]) == 8 and at(["x", "y"]) == 9
    text = ["x"] * 25 + p + ["y"]
    assert list(search.find([["z"] * 3, text, []])) == [(1, 25, 35, 0)]
    looked = len(table.candidates(decontaminate.window_hashes(decontaminate.word_hashes(text), table.block), [(0, len(text))]))
    assert looked == 1


def test_long_items_and_many_patterns():
    """Pieces overlap, so no window is lost at a cut; blocks grow with the number of patterns."""
    assert [decontaminate.block_words(n, 10) for n in (10, 2000, 500_000, 10**9)] == [2, 2, 3, 4] and decontaminate.block_words(10**9, 1) == 1
    r = random.Random(2)
    words = [f"w{r.randrange(5000)}" for _ in range(20_000)]
    search = decontaminate.WuManber([(str(i), " ".join(words[s : s + 109])) for i, s in enumerate(range(0, len(words) - 9, 100))], 10)
    ends = {e for _, _, e, _ in search.find([words])}
    assert ends == set(range(10, len(words) + 1))
    assert search.search([" ".join(words[95:115])])[1:] == ([[[0, 20]]], [["0", "1"]])


# SimHash


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, linked):
    root = {i: i for i in range(len(pairs))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if linked(pairs[i][1], pairs[j][1]):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            ids[find(i)] = min(ids.get(find(i), doc), doc)
    return [ids.get(find(i)) for i in range(len(pairs))]


def test_near_duplicates(spark):
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(R.choice(words) for _ in range(200)) for _ in range(3)]
    rows = []
    for b in base:
        for _ in range(40):
            w = b.split()
            for _ in range(R.randrange(3)):
                w[R.randrange(len(w))] = R.choice(words)
            rows.append(" ".join(w))
    rows += ["", None, " \t", "One", "one", "one two", "ONE  two", "É é", "É É"] + [" ".join(R.choice(words) for _ in range(R.randrange(1, 9))) for _ in range(40)]
    R.shuffle(rows)
    rows = [(1000 - i, t, "en") for i, t in enumerate(rows)] + [(None, base[0], "en"), (None, "alone here today", "en"), (1000, rows[0], "en")]
    prints = [(i, brute_fingerprint(t)) for i, t, _ in rows]
    want = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    out = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted(map(str, ((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in out))) == sorted(map(str, ((i, f, c) for (i, f), c in zip(prints, want, strict=True))))
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({c for (i, _), c in zip(prints, want, strict=True) if i == c and i is not None}) and kept.where("doc_id is null").count() == 2
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_dense_fingerprints(spark):
    """Many fingerprints around a few centres, over several tiles: components as of all pairs."""
    prints = set()
    for c in [0, (1 << 64) - 1, 0x0F0F0F0F0F0F0F0F]:
        for _ in range(150):
            x = c
            for _ in range(R.randrange(5)):
                x ^= 1 << R.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp long")
    edges = simhash.links(df).collect()
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 2 for r in edges) and len(edges) < 20 * len(prints)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    pairs = [(simhash.signed(x), x) for x in prints]
    want = brute_components(pairs, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [got.get(i, i) for i, _ in pairs] == want


def brute_similarity(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_similar_texts(spark, monkeypatch):
    """Near copies at 0.8 or more over five-word shingles go though many are further apart than 2 bits; others stay."""
    monkeypatch.setattr(meetings, "TILE_BYTES", 7000)  # several tiles
    monkeypatch.setattr(simhash, "CANDIDATES", 20)
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "One two", "one  TWO", "one three"]
    for _ in range(12):
        base = [r.choice(words) for _ in range(240)]
        for edits in (0, 1, 2, 4, 4, 8, 30):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    texts += [texts[8]] * 30
    r.shuffle(texts)
    rows = [(1000 - i, t, "en") for i, t in enumerate(texts)] + [(None, texts[0], "en"), (1000, texts[0], "en")]
    pairs = [(i, (brute_fingerprint(t), t)) for i, t, _ in rows]
    alike = lambda a, b: (a[0] ^ b[0]).bit_count() <= 16 and brute_similarity(a[1], b[1]) >= 0.8
    want = {i for (i, _), c in zip(pairs, brute_components(pairs, alike), strict=True) if i is not None and i == c}
    by_two = {i for (i, _), c in zip(pairs, brute_components(pairs, lambda a, b: (a[0] ^ b[0]).bit_count() <= 2), strict=True) if i is not None and i == c}
    import corpus_pipeline

    out = dict(corpus_pipeline.STAGES)["simhash"](spark, docs(spark, rows), "")
    got = [x["doc_id"] for x in out.collect()]
    assert out.columns == docs(spark, rows).columns and len(want) < len(by_two)
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1
    assert sorted(map(str, simhash.drop_similar(docs(spark, rows), broadcast_bytes=-1).collect())) == sorted(map(str, out.collect()))


@pytest.mark.parametrize("tile", [4096, 50])
def test_candidates_are_complete(spark, monkeypatch, tile):
    """Candidates join what all pairs do that share a band, computed number by number, and are within the radius."""
    monkeypatch.setattr(simhash, "CANDIDATES", tile)
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = ["", "one", "x " * 300_000]
    for _ in range(40):
        base = [r.choice(words) for _ in range(200)]
        for edits in (0, 1, 3, 6, 12, 40):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    rows, own = [], []
    multipliers = [xxhash.xxh64_intdigest(f"order {i}") | 1 for i in range(160)]
    for i, t in enumerate(texts):
        w = t.split()
        shingles = {xxhash.xxh64_intdigest(" ".join(x), 42) for x in zip(*(w[k:] for k in range(5)), strict=False)} if len(w) >= 5 else {xxhash.xxh64_intdigest(t, 42)} if w else set()
        least = [min((m * x % (1 << 64) for x in shingles), default=(1 << 64) - 1) for m in multipliers]
        own.append((brute_fingerprint(t), {(k // 5, *least[k : k + 5]) for k in range(0, 160, 5)}))
        rows.append((i, t))
    table = simhash.sketches(spark.createDataFrame(rows, "node long, text string"), ["node"], "text", 3, 5)
    got = {x["node"]: x["root"] for x in simhash.components(simhash.candidate_links(table, 12)).collect()}
    met = lambda a, b: (a[0] ^ b[0]).bit_count() <= 12 and bool(a[1] & b[1])
    want = brute_components(list(enumerate(own)), met)
    assert [got.get(i, i) for i in range(len(own))] == want and len(set(want)) < len(want)
    similar = [(i, j) for i in range(len(texts)) for j in range(i) if abs(len(texts[i]) - len(texts[j])) < 200 and brute_similarity(texts[i], texts[j]) >= 0.8]
    assert len(similar) > 100 and all(own[i][1] & own[j][1] for i, j in similar)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


# lines


def word_edits(a, b):
    """Edit distance over words, 2 if it is more than 1."""
    if abs(len(a) - len(b)) > 1:
        return 2
    if len(a) == len(b):
        return min(2, sum(x != y for x, y in zip(a, b, strict=True)))
    if len(a) < len(b):
        a, b = b, a
    return 1 if any(a[:i] + a[i + 1 :] == b for i in range(len(a))) else 2


def brute_lines(rows, least=5):
    """Of each (doc_id, text) the numbers of the lines that stay."""
    key = lambda t: simhash.signed(xxhash.xxh64_intdigest(t.encode(), 42))
    seen = sorted((i, n, key(t), line.encode().split()) for i, t in rows if i is not None and t is not None for n, line in enumerate(t.split("\n")))
    first = {}
    for *place, w in seen:
        if w:
            first.setdefault(tuple(w), tuple(place))
    places = sorted((p, list(w)) for w, p in first.items())
    stay = {p for k, (p, w) in enumerate(places) if not any(min(len(w), len(v)) >= least and word_edits(v, w) <= 1 for _, v in places[:k])}
    return [[n for n, line in enumerate(t.split("\n")) if i is None or not line.encode().split() or (i, n, key(t)) in stay] if t is not None else [] for i, t in rows]


def test_lines(spark):
    say = lambda n: [R.choice("abcdef") for _ in range(n)]
    pool = [say(R.randrange(1, 12)) for _ in range(25)]

    def line():
        w = list(R.choice(pool))
        for _ in range(R.randrange(3)):
            k = R.randrange(3)
            at = R.randrange(len(w)) if w else 0
            w = w[:at] + (say(1) if k else []) + w[at + (k != 1) :]
        return R.choice([" ", "  "]).join(w)

    rows = [(i, "\n".join(line() for _ in range(R.randrange(1, 7)))) for i in range(80)] + [(100, None), (101, ""), (102, "\n \n"), (None, "a b c d e f"), (103, "x " * 20_000), (104, "x " * 19_999 + "y")]
    rows.append(rows[5])
    rows += [(110 + i // 3, "\n".join(line() for _ in range(3))) for i in range(12)]  # ids repeat with other texts
    want = brute_lines(rows)
    table = docs(spark, [(i, t, "en") for i, t in rows])
    out = lines.dedup_lines(table).collect()
    assert sorted(str((r["doc_id"], r["n_lines"], r["kept"])) for r in out) == sorted(str((i, len(lines.lines_of(t)), k)) for (i, t), k in zip(rows, want, strict=True))
    shuffled = lines.kept_lines(table, broadcast_bytes=-1)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, lines.kept_lines(table).collect()))
    cut = lines.drop_lines(table)
    assert cut.columns == table.columns
    texts = []
    for (i, t), k in zip(rows, want, strict=True):
        left = None if t is None else "\n".join(t.split("\n")[n] for n in k)
        if t is None or not t.split() or left.split():
            texts.append(str((i, left, None if t is None else len(left))))
    assert sorted(str((r["doc_id"], r["text"], r["n_chars"] if r["text"] is not None else None)) for r in cut.collect()) == sorted(texts)
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_rows_of_one_id_keep_what_stands_nowhere_else(spark):
    texts = [("1", "one two three four five SIX"), ("5", "alpha beta gamma delta epsilon zeta"), ("5", "one two three four five six")]
    names = ("_kept", "_doc", "_of", "_key", "kept", "key", "line", "_stay", "_one", "_own", "_node", "_n", "fp", "node")
    table = spark.createDataFrame([(i, t, *["e"] * len(names)) for i, t in texts], "doc_id string, text string, " + ", ".join(f"`{n}` string" for n in names))
    for out in (lines.drop_lines(table), simhash.drop_similar(table), simhash.drop_near_duplicates(table)):
        assert out.columns == table.columns and all(r[n] == "e" for r in out.collect() for n in names)
        got = sorted((r["doc_id"], r["text"]) for r in out.collect())
        assert got[0] == texts[0] and texts[1] in got
    assert lines.drop_lines(table).count() == 2


def test_variant_hashes():
    words = [b"a", b"b", b"c", b"d"]
    h = lines.variant_hashes(words, lines.BASES[0])
    assert [h[i] == lines.variant_hashes(words[:i] + words[i + 1 :], lines.BASES[0])[-1] for i in range(4)] == [True] * 4 and len(set(h.tolist())) == 5


# media


def test_media(spark):
    rows = [(i, "é" * i, "en") for i in range(0, 300, 7)] + [(None, "x", "en"), (900, None, "en"), (901, "same", "en"), (901, "same", "en"), (902, "line\n" * 60_000, "en")]
    out = media.media_columns(docs(spark, rows)).collect()
    by = {None if i is None else str(i): t for i, t, _ in rows}
    assert sorted(str(r["key"]) for r in out) == sorted(str(i) for i, _, _ in rows)
    for r in out:
        raw = (by[r["key"]] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        steps = sum(abs(a - b) for a, b in zip(payload, payload[1:], strict=False))
        bins = ",".join(str(sum(b // 32 == k for b in payload)) for k in range(8))
        assert r["feature"] == f"sum={sum(payload)};squares={sum(b * b for b in payload)};steps={steps};bins={bins}"
    assert media.media_columns(docs(spark, [])).count() == 0


def png_samples(image):
    """Samples of an 8-bit grey PNG without interlace, read by the format's own rules, all filters but Average and Paeth."""
    assert image[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts, names = 8, {}, []
    while at < len(image):
        n, name = int.from_bytes(image[at : at + 4]), image[at + 4 : at + 8]
        assert int.from_bytes(image[at + 8 + n : at + 12 + n]) == zlib.crc32(image[at + 4 : at + 8 + n])
        parts[name] = parts.get(name, b"") + image[at + 8 : at + 8 + n]
        names.append(name)
        at += 12 + n
    assert names[0] == b"IHDR" and names[-1] == b"IEND" and parts[b"IHDR"][8:] == bytes([8, 0, 0, 0, 0])
    width, height = int.from_bytes(parts[b"IHDR"][:4]), int.from_bytes(parts[b"IHDR"][4:8])
    raw, rows, above = zlib.decompress(parts[b"IDAT"]), [], bytes(width)
    for y in range(height):
        kind, line = raw[y * (width + 1)], bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            line[x] = (line[x] + {0: 0, 1: line[x - 1] if x else 0, 2: above[x]}[kind]) % 256
        rows.append(above := bytes(line))
    return b"".join(rows)


def test_stored_form_is_a_png_of_the_payload():
    for text in ("", "é" * 500, "line\n" * 3000):
        payload, n = media.payload_of(text)
        image = media.encode_image(payload, n)
        assert png_samples(image) == payload and media.decode_image(image) == (payload, n)


def test_archives_of_a_lost_attempt_do_not_count(spark, monkeypatch):
    """A file beside the committed ones is read by nobody; one that is missing or short is an error."""
    pages = spark.createDataFrame([(i, "http://x/" + "é" * 20_000 * (i == 3), f"<p>{i}</p>" * 300, None) for i in range(20)], PAGES)
    monkeypatch.setattr(warc, "FILE_BYTES", 500)
    folder = fresh_dir(spark, "test-warc")
    warc.write_archives(pages, folder)
    files = list_files(folder, ".warc.gz")
    assert len(files) > 1
    shutil.copy(files[0][0], files[0][0].replace("part-", "part-9"))
    assert warc.read_archives(spark, folder).count() == 20  # a header of 120 kB too
    texts = docs(spark, [(i, "x" * 100, "en") for i in range(20)])
    zips = fresh_dir(spark, "test-media")
    media.write_archives(texts, zips)
    (one, *_) = list_files(zips, ".zip")
    shutil.copy(one[0], one[0].replace("part-", "part-9"))
    assert media.read_archives(spark, zips).count() == 20
    for path in (files[0][0], one[0]):
        os.remove(path)
    for read in (warc.read_archives, media.read_archives):
        with pytest.raises(Exception, match="missing"):
            read(spark, folder if read is warc.read_archives else zips).count()


def test_ranges_and_retries(spark, monkeypatch):
    folder = fresh_dir(spark, "test-media")
    media.write_archives(docs(spark, [(i, str(i) * 500, "en") for i in range(50)]).coalesce(1), folder)
    whole = media.MediaReader(folder, 1 << 30)
    parts = media.MediaReader(folder, 3000)
    read = lambda reader: [(m, o) for p in reader.partitions() for b in reader.read(p) for m, o in zip(b["member"].to_pylist(), b["offset"].to_pylist(), strict=True)]
    assert len(parts.partitions()) > 3 and read(parts) == read(whole) and len(read(whole)) == 50
    (part,) = whole.partitions()
    fs, _ = filesystem(folder)
    entry = zipfile.ZipFile(part.path).infolist()[7]

    class Flaky:
        """Fails twice, then reads."""

        left = 2

        def open_input_file(self, path):
            Flaky.left -= 1
            if Flaky.left >= 0:
                raise OSError("gone for a moment")
            return fs.open_input_file(path)

    assert media.decode_image(media.read_member(Stretch(Flaky(), part.path), entry))[0].strip() == b"7" * 500
    opened = []
    counting = type("Counting", (), {"open_input_file": lambda self, path: opened.append(path) or fs.open_input_file(path)})()
    archive = Stretch(counting, part.path)
    assert len({media.read_member(archive, i) for i in zipfile.ZipFile(part.path).infolist()}) == 50 and len(opened) == 1
    with open(part.path, "r+b") as f:
        f.seek(entry.header_offset + 60)
        f.write(b"XX")
    with pytest.raises(OSError):
        media.read_member(Stretch(fs, part.path), entry)
    with pytest.raises(ValueError):
        media.decode_image(b"no image")


# WARC

PAGES = "page_id long, url string, html string, record_type string"


def fake(page_id, compress):
    data = warc.record(b"x" * 50, page_id, "http://fake/", hashlib.sha1(b"x" * 50).hexdigest(), False, None, "2000-01-01T00:00:00Z")
    if compress:
        c = zlib.compressobj(9, zlib.DEFLATED, 31)
        data = c.compress(data) + c.flush()
    return data


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("range_bytes", [2500, 1 << 20])
def test_only_reachable_records_count(spark, compress, range_bytes):
    """Whole records inside payloads are candidates, and are rejected."""
    folder = local(fresh_dir(spark, "test-warc"))
    os.makedirs(folder)
    r, out, want = random.Random(1), b"", []
    for i in range(12):
        inner = fake(1000 + i, compress) * 2
        payload = bytes(r.randrange(256) for _ in range(300)) + inner + inner[:40] + b"WARC/1.1\r\nContent-Length: 5\r\n\r\n"
        data = warc.record(payload, i, "http://x/ y\n", hashlib.sha1(payload).hexdigest(), False, None, "2000-01-01T00:00:00Z")
        if compress:
            c = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored as it is, with the records inside
            data = c.compress(data) + c.flush()
        out += data
        want.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "response", None))
    name = "a.warc.gz" if compress else "a.warc"
    for n in ("", "2"):
        with open(f"{folder}/{n}{name}", "wb") as f:
            f.write(out)
    reader = warc.CandidateReader(folder, name[1:], range_bytes)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2 * 36 + 2  # and a row for each file
    got = warc.read_archives(spark, folder, compress, range_bytes)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want * 2)
    with open(f"{folder}/{name}", "r+b") as f:
        f.truncate(len(out) - 100)
    with pytest.raises(ValueError):
        warc.read_archives(spark, folder, compress, range_bytes)


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_revisits(spark, broadcast_bytes):
    long, short = "<p>" + "é" * 600, "<p>short"
    rows = [(i, f"http://h/{i}", long, "x") for i in (3, 9, 5, 9)] + [(1, None, short, "x"), (2, "u", short, "x"), (7, "u", None, "x"), (8, "u", "", "x"), (None, "u", long, "x"), (None, "u", "z" * 2000, "x"), (11, "u", "y" * 200_000, "x")]
    folder = fresh_dir(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, PAGES), folder, broadcast_bytes=broadcast_bytes)
    got = sorted((tuple(r) for r in warc.read_archives(spark, folder).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(i, len((t or "").encode()), sha(t), "response", None) for i, _, t, _ in rows]
    first = True
    for k, (i, n, d, _, _) in enumerate(want):
        if d == sha(long):
            if i == 9 and first:
                first = False
            else:
                want[k] = (i, n, d, "revisit", 9)
    assert got == sorted(want, key=str)
    assert base64.b32encode(bytes.fromhex(sha(short)))
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0


# the pipeline


def test_pipeline_is_its_stages(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no tables here")
    import sentencepiece

    import corpus_pipeline
    from tidemark.llm import language_id, tokens

    # near copies within and beyond 2 bits, and texts below 0.8, so that other rules would give other results
    table = spark.read.parquet(f"{path}/documents.parquet")
    r = random.Random(8)
    long = [x for x in table.collect() if x["text"] and x["lang"] and 150 < len(x["text"].split()) < 800][:40]
    changed = []
    for k, x in enumerate(long):
        w = x["text"].split()
        for _ in range(max(1, round(len(w) * (0.004, 0.012, 0.02, 0.08)[k % 4]))):
            w[r.randrange(len(w))] = r.choice(w)
        cut_at = sorted(r.sample(range(5, len(w) - 5), 3))  # lines of their own, so that line dedup leaves them
        lines_ = [" ".join(w[s:e]) for s, e in zip([0, *cut_at], [*cut_at, len(w)], strict=True)]
        changed.append({**x.asDict(), "doc_id": 10**6 + k, "text": "\n".join(lines_)})
    table = table.unionByName(spark.createDataFrame(changed, table.schema))
    shutil.copytree(path, f"{tmp_path}/in", ignore=shutil.ignore_patterns("documents.parquet"))
    path = f"{tmp_path}/in"
    table.write.parquet(f"{path}/documents.parquet")
    table = spark.read.parquet(f"{path}/documents.parquet")
    model = language_id.learn(table)
    bound = language_id.least_known_of(table, model)
    assert bound > 0.3
    predict = model.predictor()
    known = {r["doc_id"] for r, lang, share in zip(table.collect(), *[predict([r["text"] for r in table.collect()])[k] for k in (0, 2)], strict=True) if lang != "und" and share >= bound}
    rows = sorted((r["doc_id"], r["text"]) for r in table.collect() if r["doc_id"] in known)
    cut = []
    for (i, t), k in zip(rows, brute_lines(rows), strict=True):
        left = "\n".join(t.split("\n")[n] for n in k)
        if left.split() or not t.split():
            cut.append((i, left))
    sets = [(i, (brute_fingerprint(t), frozenset(tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))) if t.split() else frozenset())) for i, t in cut]
    alike = lambda a, b: (a[0] ^ b[0]).bit_count() <= 16 and (a[1] == b[1] or 5 * len(a[1] & b[1]) >= 4 * len(a[1] | b[1]))
    stay = {i for (i, _), c in zip(sets, brute_components(sets, alike), strict=True) if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in (decontaminate.words_of(t) for _, t in items) if w for i in range(max(1, len(w) - 9))}

    def leaks(text):
        w = decontaminate.words_of(text)
        return any(tuple(w[i : i + m]) in windows for m in {len(x) for x in windows} for i in range(len(w) - m + 1))

    judge = sentencepiece.SentencePieceProcessor(model_file=tokens.MODEL)
    want = {i: judge.encode(t) for i, t in cut if i in stay and not leaks(t)}
    least = {i for (i, _), c in zip(sets, brute_components(sets, lambda a, b: (a[0] ^ b[0]).bit_count() <= 2), strict=True) if i == c}
    wide = {i for (i, _), c in zip(sets, brute_components(sets, lambda a, b: (a[0] ^ b[0]).bit_count() <= 16), strict=True) if i == c}
    assert stay not in (least, wide) and stay < {i for i, _ in cut}  # the rules differ here
    got = {r["doc_id"]: r["tokens"] for r in corpus_pipeline.run(spark, path).collect()}
    assert got == want and len(want) < len(rows)


def test_stages_take_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and blank texts, repeated rows, and further columns with the operators' names."""
    import corpus_pipeline

    spark.createDataFrame([(None, "some leaked words"), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ("kept", "n_lines", "fp", "component_id", "tokens", "score", "spans", "lang_pred", "_text", "items", "parity", "a.b", "c0")
    extra = "e"
    rows = [
        (None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", None), (3, " \n ", "en", "s", 3), (4, "the cat sat on the mat\nthe dog sat on the mat", "en", "s", 44),
        (4, "the cat sat on the mat\nthe dog sat on the mat", "en", "s", 44), (5, "the cat sat on the mat", None, "s", 22), (None, "the end of a text without id", "en", "s", None), (6, "here are some leaked words today", "en", "s", 1),
        (7, "the " * 20_000, "en", "s", 80_000), (8, "123 456", "en", "s", 7), (8, "789", "en", None, 7),
    ]
    df = spark.createDataFrame([r + (extra,) * len(names) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    df = df.withColumn("some map", F.create_map(F.lit("k"), F.lit(1)))
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == df.columns and out.schema == df.schema and all(r[n] == extra for r in out.collect() for n in names)
        counts[name] = sorted((r["doc_id"] for r in out.collect()), key=str)
    assert counts["language_id"] == sorted([4, 4, 5, 6, 7, None], key=str)
    assert counts["line_dedup"] == sorted([1, 2, 3, 4, 4, 6, 7, 8, 8, None, None], key=str)  # 5 repeats a line of 4
    assert counts["decontaminate"] == sorted([r[0] for r in rows if r[0] != 6], key=str)
    assert counts["simhash"].count(None) == 2 and counts["simhash"].count(4) == 1 and len(counts["sentencepiece"]) == len(rows)
