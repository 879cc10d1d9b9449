"""Operators on single texts: language ID, secrets, personal data, HTML, tokens."""

import math
import os
import random
import re
import struct
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import html_text, language_id, personal_data, secrets, tokens
from tidemark.llm.common import fresh_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, _text string, h string"
ODD = [(None, "no id here", "en"), (1, None, "en"), (2, "", None), (3, "  \n\t ", "de"), (4, "12 34 !?", "de"), (5, "the cat sat on the mat and the dog", "en"), (5, "the cat sat on the mat and the dog", "en")]


def docs(spark, rows):
    """Rows (doc_id, text, lang) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), 0.5, "x", "y", "z") for i, t, g in rows], DOCS)


EN, DE = "the and of that with this from have".split(), "der die das und nicht mit von wird".split()


def say(words, seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


# language ID


def test_languages(spark):
    rows = [(100 + i, say(EN, i), "en") for i in range(60)] + [(200 + i, say(DE, i), "de") for i in range(60)] + ODD + [(900, "WORD " * 50_000, None), (901, say(DE, 7), None)]
    got = {r["doc_id"]: r for r in language_id.identify(docs(spark, rows)).collect()}
    assert language_id.identify(docs(spark, rows)).count() == len(rows)
    assert all(got[100 + i]["lang_pred"] == "en" and got[200 + i]["lang_pred"] == "de" for i in range(60)) and got[901]["lang_pred"] == "de"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 4)) and got[5]["lang_pred"] == "en" and got[900]["lang_pred"] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    import zlib

    assert all(r["held_out"] == (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0) for i, r in got.items())


def test_more_languages_than_bits_of_a_byte(spark):
    words = {f"l{k:02}": [f"{c}{v}{c}" for c in "bcdfg"[k % 5] + "klmnp"[k // 5 % 5] for v in "aeiou"[k % 5] + "xyzwq"[k // 5]] for k in range(11)}
    rows = [(100 * k + i, say(words[g], 100 * k + i), g) for k, g in enumerate(sorted(words)) for i in range(20)]
    out = language_id.identify(docs(spark, rows)).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id'] // 100:02}" for r in out) >= 0.95 * len(rows)


def test_no_labels_and_no_rows(spark):
    rows = [(1, "some words", None), (2, "more", None)]
    assert [r["lang_pred"] for r in language_id.identify(docs(spark, rows)).collect()] == ["und", "und"]
    assert language_id.identify(docs(spark, [])).count() == 0


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    table = spark.read.parquet(path)
    got = language_id.identify(table).where("held_out").join(table.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got > 0.97


UNLEARNED = [
    "La mattina presto il mercato della piazza si riempie di gente che compra frutta, verdura e pesce fresco, mentre i bambini corrono verso la scuola e gli anziani leggono il giornale seduti davanti alla chiesa.",
    "Wczesnym rankiem targ na placu wypelnia sie ludzmi, ktorzy kupuja owoce, warzywa i swieze ryby, podczas gdy dzieci biegna do szkoly, a starsi czytaja gazety siedzac na lawkach przed kosciolem.",
    "Sang som cho o quang truong day nguoi mua trai cay rau va ca tuoi trong khi tre em chay den truong va nguoi gia doc bao ngoi tren ghe truoc nha tho.",
    "Varhain aamulla torin markkinat tayttyvat ihmisista, jotka ostavat hedelmia, vihanneksia ja tuoretta kalaa, kun lapset juoksevat kouluun ja vanhukset lukevat sanomalehtea penkeilla kirkon edessa.",
    "Vroeg in de ochtend vult de markt op het plein zich met mensen die fruit, groente en verse vis kopen, terwijl de kinderen naar school rennen en de ouderen op de banken voor de kerk de krant lezen.",
    "Рано утром рынок на площади наполняется людьми",
]


def test_unlearned_languages_and_noise_go(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    import corpus_pipeline

    r = random.Random(4)
    noise = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 10))) for _ in range(50)) for _ in range(40)]
    table = spark.read.parquet(path)
    more = spark.createDataFrame([(10**9 + i, t, None, None, None) for i, t in enumerate(UNLEARNED + noise)], table.schema)
    left = dict(corpus_pipeline.STAGES)["language_id"](spark, table.unionByName(more), "")
    assert left.where(f"doc_id >= {10**9}").count() == 0 and left.count() == table.count()


def test_filter_has_no_false_negatives():
    import numpy as np

    table = np.zeros((1 << 12, 1), np.uint8)
    h = next(language_id.gram_hashes([(0, " hello world ", 13)]))[0]
    for p in language_id.positions(h, 12):
        table[p, 0] |= 2
    model = language_id.LanguageModel(("aa", "bb"), 12, table)
    best, score, _ = model.predictor()(["hello"])
    assert best == ["bb"] and score[0] > 0.9 and model.false_rate()[0] == 0


def brute_predict(model, text):
    """(language, score, known) with the filter read bit by bit, and its false positives counted for themselves."""
    mask64, clean = (1 << 64) - 1, language_id.letters(text)
    masks = [int.from_bytes(row.tobytes(), "little") for row in model.table]
    false = [min(0.999, (sum(m >> k & 1 for m in masks) / len(masks)) ** language_id.HASHES) for k in range(len(model.langs))]
    counts, total = [0] * len(model.langs), 0
    for n in language_id.ORDERS:
        for i in range(len(clean) - n + 1):
            h = 0
            for c in clean[i : i + n]:
                h = (h * language_id.STEP + ord(c)) & mask64
            h = (h + n) & mask64
            h ^= h >> 29
            both = -1
            for m in language_id.MULTIPLIERS[: language_id.HASHES]:
                both &= masks[(h * m & mask64) >> (64 - model.bits)]
            total += 1
            counts = [c + (both >> k & 1) for k, c in enumerate(counts)]
    own = [max(0.0, (c - total * f) / (1 - f)) for c, f in zip(counts, false, strict=True)]
    if not clean:
        return "und", 0.0, 0.0
    k = own.index(max(own))
    return model.langs[k], own[k] / sum(own) if sum(own) else 0.0, min(1.0, own[k] / total) if total else 0.0


@pytest.mark.parametrize("full", [0.2, 0.95])
def test_predictions_by_brute_force(monkeypatch, full):
    """Also on a nearly full filter, whose answers are mostly false, and with texts cut into pieces."""
    import numpy as np

    r = np.random.default_rng(1)
    table = np.packbits(r.random((1 << 10, 16)) < full, axis=1, bitorder="little")
    model = language_id.LanguageModel(tuple(f"l{k:02}" for k in range(11)), 10, table)
    texts = [None, "", "1 2", "a", "ab", *[say(EN + DE, i, 30) for i in range(20)], "Größe und Länge, 3 mal 4"]
    want = [brute_predict(model, t) for t in texts]
    for chars in (1 << 18, 50, 7):
        monkeypatch.setattr(language_id, "PIECE_CHARS", chars)
        got = list(zip(*model.predictor()(texts), strict=True))
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1:] for g in got], [w[1:] for w in want])


def test_every_label_counts_and_characters_are_bounded(spark):
    rows = docs(spark, [(i, say(EN, i), "en") for i in range(90)] + [(1000 + i, say(DE, i), "de") for i in range(60)] + [(2000 + i, "odd words", f"x{i}") for i in range(300)])
    model = language_id.learn(rows, filter_bytes=1 << 15)
    assert len(model.langs) > 200 and {"en", "de"} <= set(model.langs) and model.table.size <= 1 << 15
    pair = rows.select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("_text")).union(spark.createDataFrame([(9, "long", "xyz " * 500_000)], "id long, lang string, _text string"))
    some, _ = language_id.sampled(pair, 10**6, 2000, "s")
    n = {r["lang"]: r["n"] for r in some.groupBy("lang").agg(F.sum(F.length("_text")).alias("n")).collect()}
    assert {"en", "de", "long"} <= set(n) and n["long"] == 2000 and all(x <= 2100 for x in n.values())


def test_the_model_and_the_bound_come_from_all_rows(spark, monkeypatch):
    """Words that stand in three documents of thousands are learned, and the bound is the quantile over every held-out document."""
    import numpy as np

    monkeypatch.setattr(language_id, "HELD_GRAMS", 500)
    odd = [f"{a}q{b}x{a}j{b}" for a in "bcdfgh" for b in "klmnp"]
    train = [i for i in range(12000) if zlib.crc32(str(i).encode()) % 5]
    extra = {i: odd[k % len(odd)] for k, i in enumerate(train[:: len(train) // (3 * len(odd))][: 3 * len(odd)])}
    table = docs(spark, [(i, f"{say(EN, i, 6)} {extra.get(i, i % 7 * 'zq')}", "en") for i in range(12000)])
    model = language_id.learn(table)
    assert all(x == 1 for x in model.predictor()(odd)[2])
    share = [k for k, in language_id.predict(table.where(language_id.held_out(F.col("doc_id"))), model, ["doc_id"]).select("known").collect()]
    assert len(share) > 1500 and abs(language_id.least_known_of(table, model) - 0.55 * np.quantile(share, 0.05)) < 1e-12


# secrets


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PASSWD", "secret", "toKen", "api_key", "apikey", "=", ": ", '"', "'", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789ab", "f", " ", "ſecret", "K", "é", "\n"]), max_size=14).map("".join))
def test_secret_patterns(text):
    assert secrets.find_secrets(text) == plain_secrets(text)


def test_ledger(spark):
    key = "password=abcdef123"
    rows = [(i, key + " tail", "en") for i in range(20)] + [(50, None, "en"), (51, "", "en"), (52, "x " + "0a" * 20, "en"), (None, key, "en"), (60, key, "en"), (60, key, "en")]
    ledger = fresh_dir(spark, "test-ledger")
    out, scanned = secrets.scan(docs(spark, rows), ledger)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in out.collect()}
    assert out.count() == len(rows) and got[3] == [("assign", 0, 18)] and got[50] == got[51] == [] and got[52] == [("hex", 2, 42)] and got[None] == got[60] == [("assign", 0, 18)]
    assert scanned.count() == 4  # four contents, whatever the number of paths
    _, again = secrets.scan(docs(spark, rows), ledger)
    assert again.count() == 0
    more = rows + [(70, "AKIA" + "A" * 16, "en")]
    out, again = secrets.scan(docs(spark, more), ledger)
    assert again.count() == 1 and out.where("doc_id = 70").first()["spans"][0]["kind"] == "access"
    newer = (*secrets.RULES, secrets.Rule("fruit", 1, re.compile("tail"), lambda m: True))
    out, again = secrets.scan(docs(spark, more), ledger, rules=newer)
    assert [r["rules"] for r in again.collect()] == [["fruit@1"]] * 5  # only the new pairs
    assert [s["kind"] for s in out.where("doc_id = 3").first()["spans"]] == ["assign", "fruit"]
    late = docs(spark, more + [(i, f"other {i} " + "0a" * 20, "en") for i in range(80, 90)])
    _, again = secrets.scan(late, ledger, broadcast_bytes=0)
    assert again.count() == 10  # brought together by address: the same
    out, again = secrets.scan(late, ledger, rules=secrets.RULES[:1])  # a rule is withdrawn
    assert again.count() == 0 and {s["kind"] for r in out.collect() for s in r["spans"]} == {"assign"}
    odd = docs(spark, rows).withColumnsRenamed({"h": "_found", "score": "_blob", "lang": "_own"})
    assert secrets.scan(odd, ledger)[0].columns == [c for c in odd.columns if c not in ("text", "spans")] + ["blob", "spans"]
    assert secrets.scan(docs(spark, []))[0].count() == 0


# personal data


def test_ledger_after_a_version_change(spark):
    """What only an earlier version of a rule found is withdrawn; other rules' findings stay."""
    from dataclasses import replace

    ledger = fresh_dir(spark, "ledger")
    short, long = "0123456789abcdef01234567", "0123456789abcdef" * 3
    table = docs(spark, [(1, f"token = abcdefgh {short}", "en"), (2, long, "en")]).select("doc_id", "text")
    kinds = lambda out: {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in out.collect()}
    assert kinds(secrets.scan(table, ledger)[0]) == {1: ["assign", "hex"], 2: ["hex"]}
    stricter = tuple(replace(r, version=2, keep=lambda m: m.end() - m.start() >= 40) if r.kind == "hex" else r for r in secrets.RULES)
    out, scanned = secrets.scan(table, ledger, rules=stricter)
    assert kinds(out) == {1: ["assign"], 2: ["hex"]} and {tuple(r["rules"]) for r in scanned.collect()} == {("hex@2",)}


def plain_personal(text):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(k, s, e) for s, _, k, e in sorted(out)]


PIECES = ["a", "b.c", "@", "x-y", ".", "..", "1", "255", "256", "0001", "1.2.3.4", "4111 1111 1111 1111", "4242-4242-4242-4242", "+1", "(555)", "123-4567", " ", "+", "-", "é", "٣", "%", "\n", "000000000000"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_personal_patterns(text):
    assert personal_data.base_spans(text) == plain_personal(text)


def test_patterns_are_linear():
    start = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "a@b" * 150_000, "+1" + "(" * 400_000, "a-" * 200_000, "a(at)" * 80_000, "a(at)b(dot)" * 40_000, "a." * 200_000 + "(at)", "a1 " * 150_000, "-" * 400_000 + "1" + "-" * 400_000):
        personal_data.candidates(text, personal_data.base_spans(text))
    assert time.time() - start < 20


def test_overlaps_are_found_in_linear_time():
    text = "call 212-555-0100 or +1 212 555 0100 now\n" * 16_000
    start = time.time()
    found = personal_data.candidates(text, personal_data.base_spans(text))
    assert len(found) == 32_000 and sum(known for _, known, *_ in found) == 16_000 and time.time() - start < 6


@pytest.mark.parametrize(
    ("text", "value", "want"),
    [
        ("phone: 5-5", "5-5", ["phone _"]), ("my phone is:   5-5, thanks a lot", "5-5", ["is _", "phone is _", "_ thanks", "_ thanks a"]), ("a\nx 5-5\nb", "5-5", ["x _"]), ("at4 5-5 x_y", "5-5", []),
        ("the w4 one 5-5é", "5-5", ["one _"]), ("5-5", "5-5", []), ("É ß 5-5", "5-5", ["ß _", "é ß _"]), ("a " + "." * 200 + " b" + "-" * 99 + "5-5", "5-5", ["b _", "a b _"]),
    ],
)
def test_contexts_of_a_value(text, value, want):
    at = text.index(value)
    assert personal_data.contexts(text, at, at + len(value)) == want


def brute_scores(edges, rounds, confidence, support):
    """score_graph in plain Python: edges {(context, kind, value): known}."""
    score = {e: float(k) for e, k in edges.items()}
    for _ in range(rounds):
        patterns = {}
        for c, k in {e[:2] for e in edges}:
            f, n = sum(s for e, s in score.items() if e[:2] == (c, k)), len({e[2] for e in edges if e[0] == c})
            if sum(known for e, known in edges.items() if e[:2] == (c, k)) >= support and f / n >= confidence:
                patterns[c, k] = f / n
        for e, known in edges.items():
            doubts = [max(1e-9, 1 - conf) for (c, k), conf in patterns.items() if k == e[1] and not known and (c, *e[1:]) in edges]
            new = 1.0
            for d in doubts:
                new *= d
            score[e] = 1.0 if known else 1 - new if doubts else 0.0
    sure = {e[1:]: score[e] for e, known in edges.items() if not known and score[e] >= confidence}
    return {min((-s, k, v) for (k, v), s in sure.items() if v == value)[1:] for _, value in sure}


def test_graph_scores(spark):
    r = random.Random(8)
    known = {(k, f"v{i}"): r.random() < 0.8 for k in ("phone", "card") for i in range(60)}
    for confidence, support in ((0.8, 4), (0.6, 2)):
        edges = {(f"c{c}", k, v): known[k, v] for (k, v) in known for c in r.sample(range(12), r.randrange(1, 4)) if k == "phone" or c % 3 == 0}
        df = spark.createDataFrame([(*e, v) for e, v in edges.items()], "context string, kind string, value string, known boolean")
        got = {(x["kind"], x["value"]) for x in personal_data.score_graph(df, 3, confidence, support).collect()}
        assert got == brute_scores(edges, 3, confidence, support) and got


def test_one_word_patterns_and_values_without_context(spark):
    rows = [(i, f"phone: +1 212 555 {1000 + i}", "en") for i in range(50)]
    rows += [(100, "phone: 212-555-2000", "en"), (101, "212-555-2000", "en"), (102, "write to me (at) host (dot) org", "en"), (103, "order 212-555-3000", "en")]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in personal_data.extract(docs(spark, rows), ["doc_id"]).collect()}
    assert got[100] == [("ctx_phone", 7, 19)] and got[101] == [("ctx_phone", 0, 12)] and got[102] == got[103] == []
    assert list(personal_data.masked_emails("write to a-b.c (at) host (dot) org")) == [(9, 34)]


def test_contexts_find_what_the_patterns_miss(spark):
    rows = [(i, f"Please call me on +1 (555) 010-{1000 + i} today", "en") for i in range(12)]
    rows += [(100, "Please call me on (555) 010-7777 today", "en"), (101, "version number (555) 010-8888 of it", "en"), (102, None, "en"), (103, "", "en"), (None, "mail a@b.co", "en"), (100, "Please call me on (555) 010-7777 today", "en")]
    out = personal_data.extract(docs(spark, rows), ["doc_id"]).collect()
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in out}
    assert len(out) == len(rows) and got[3] == [("phone", 18, 35)] and got[100] == [("ctx_phone", 18, 32)] and got[101] == got[102] == got[103] == [] and got[None] == [("email", 5, 11)]
    assert all([tuple(s) for s in r["base"]] == [tuple(s) for s in r["spans"] if not s["kind"].startswith("ctx_")] for r in out)
    assert personal_data.extract(docs(spark, []), ["doc_id"]).count() == 0


def test_shapes_of_identifiers():
    text = "passport X1234567, account DE89 3704 0044 0532 0130 00. Host fe80::1234 or 020 7946 0958; not 1999 or v2, a12b=3456 or " + "7" * 41
    assert [text[s:e] for s, e in personal_data.identifiers(text)] == ["X1234567", "DE89 3704 0044 0532 0130 00", "fe80::1234", "020 7946 0958"]
    assert list(personal_data.identifiers("(12345)\n67890 é12345")) == [(1, 6), (8, 13)]
    assert list(personal_data.identifiers("")) == list(personal_data.identifiers("no digit")) == []


def test_contexts_find_identifiers_that_no_pattern_knows(spark):
    """Passport numbers, IBANs and numbers of other lands stand in some contexts of seeds and in others; other values of their
    shapes stand in contexts of their own."""
    r = random.Random(12)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    shapes = {"passport": lambda: r.choice(upper) + digits(7), "iban": lambda: f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", "london": lambda: f"020 {digits(4)} {digits(4)}"}
    frames = ["my number is {} thanks", "reach me under {} always", "verify identity with {} first"]
    others = ["order reference {} shipped", "build {} failed again", "invoice {} was paid"]
    rows, want = [], {}
    for i in range(300):
        rows.append((i, r.choice(frames).format(f"+1 212 555 {1000 + i}"), "en"))
    for i, shape in enumerate(list(shapes) * 10):
        hidden, plain = shapes[shape](), shapes[shape]()
        text = r.choice(frames).format(hidden)
        rows += [(1000 + i, text, "en"), (2000 + i, f"Unrelated words around {hidden} here", "en")] + [(3000 + 10 * i + j, x.format(plain), "en") for j, x in enumerate(others)]
        want |= {1000 + i: {hidden}, 2000 + i: {hidden}}
    by_id = {i: t for i, t, _ in rows}
    got = {x["doc_id"]: {by_id[x["doc_id"]][s["start"] : s["end"]] for s in x["spans"] if s["kind"].startswith("ctx_")} for x in personal_data.extract(docs(spark, rows), ["doc_id"]).collect()}
    assert {k: v for k, v in got.items() if v} == want


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
<body class="has-sidebar"><header>Site</header><nav><ul><li><a href="/">Home</a><li>About</ul></nav><div class="cookie-notice">We use cookies on this page, a long notice about them</div>
%s<aside class="sidebar">Related things to read</aside><div id="comments"><p>First! a reader comment of some length, and more of it</div>
<form><input name="q"><button>Go</button></form><footer>&copy; Us</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>Head &amp; tail</h1><p>One\n  two <b>three</b>.<br><p>Four &lt;five&gt; &#233;&nbsp;x<div class='ad'>Buy</div></article>", "Head & tail\nOne two three.\nFour <five> é x"),
        ("<article><p>Hi.</p></article>", "Hi."),
        ("<article></article>", ""),
        ("<main><p>A main text without article, of some length.</p><script>x</script><p>Its second part.</p></main>", "A main text without article, of some length.\nIts second part."),
        ("<article><p>In <span class='ad'>Buy</span>one <button>Go</button>line.</article>", "In one line."),
        ("<article><p>R&D and &am and &amp</p><!-- <p>no</p> --><ul><li>a<li>b</ul></article>", "R&D and &am and &\na\nb"),
    ],
)
def test_pages(body, want):
    assert html_text.main_text(PAGE % body) == want


def test_pages_without_regions(spark):
    assert html_text.main_text("<p>Just a paragraph of text here.</p><p>And one more of them.</p>") == "Just a paragraph of text here.\nAnd one more of them."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", PAGE % "<article><p>x</p></article>"), (2, "u", PAGE % "<article><p>x</p></article>")], "page_id long, url string, html string")
    got = [tuple(r) for r in html_text.extract(pages, ["page_id", "url"]).collect()]
    assert sorted(got, key=str) == sorted([(1, None, ""), (None, "u", ""), (2, "u", "x"), (2, "u", "x")], key=str)
    assert len(html_text.main_text("<article>" + "<p>word " * 20_000)) == 5 * 20_000 - 1


LONG = "A paragraph of some length with enough words in it to stand out clearly, number"
TEXT = "".join(f"<div>{LONG} {i}</div>" for i in range(6))
LINES = "\n".join(f"{LONG} {i}" for i in range(6))


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<main><h1>Head</h1><p>Lead.</p><article>{TEXT}</article><p>End.</p></main>", f"Head\nLead.\n{LINES}\nEnd."),
        (f"<article><h2>One</h2>{TEXT}</article><article><h2>Two</h2>{TEXT}</article>", f"One\n{LINES}\nTwo\n{LINES}"),
        (f"<div><h1>Head</h1>{TEXT}</div><article><p>{LONG}</p></article>", f"Head\n{LINES}\n{LONG}"),
        (f"<h1>Head</h1><p>By X</p>{TEXT}<p>End.</p><p>X</p>", f"Head\nBy X\n{LINES}\nEnd.\nX"),
        (f"{TEXT}<div class='ad'>Buy this</div><p>Yes.</p><div class='ad'>Buy that</div>{TEXT}", f"{LINES}\nYes.\n{LINES}"),
        (f"<p><a href='#'>x</a></p><nav>{'<a>Home</a>' * 30}</nav>{'<div></div>' * 9}<p>y</p>{'<div></div>' * 9}<nav>{'<a>Home</a>' * 30}</nav>{TEXT}", LINES),
    ],
)
def test_all_parts_of_the_cluster_stay(body, want):
    assert html_text.main_text(f"<html><head><title>T</title></head><body>{body}<footer>&copy; Us</footer></body></html>") == want


def brute_main(html):
    """Ratio, smoothing, cluster and choice of parts in plain Python, from the parser's lines."""
    lines = lines_of(html)
    ratio = [len(t) / (1 + n) for t, n, *_ in lines]
    smooth = []
    for i in range(len(lines)):
        near = [(math.exp(-((i - j) ** 2) / 2), ratio[j]) for j in range(len(lines)) if abs(i - j) <= 3]
        smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    mean = sum(smooth) / max(1, len(smooth))
    bound = math.sqrt(sum((x - mean) ** 2 for x in smooth) / max(1, len(smooth)))
    stretches, label = [], []
    for i, (_, _, region, out, _) in enumerate(lines):
        if out:
            label.append(None)
        elif region:
            label.append(("region", region))
        else:
            if not i or lines[i - 1][3] or lines[i - 1][2]:
                stretches.append(("body", len(stretches)))
            label.append(stretches[-1])
    chosen = {k for k, x in zip(label, smooth, strict=True) if k and x >= bound * (1 - 1e-9)} or {k for k in label if k}
    body = [k[1] for k in chosen if k[0] == "body"]
    if body:
        low, high = min(body), max(body)
        plain = lambda n: 0 <= n < len(stretches) and all(x[4] for k, x in zip(label, lines, strict=True) if k == ("body", n))
        while plain(low - 1):
            low -= 1
        while plain(high + 1):
            high += 1
        chosen |= {("body", n) for n in range(low, high + 1)}
    return "\n".join(t for (t, *_), k in zip(lines, label, strict=True) if k in chosen)


def test_pages_by_brute_force():
    r = random.Random(6)
    decided = 0
    for _ in range(300):
        part = lambda d: r.choice(["<p>%s</p>", "<div>%s</div>", "<article>%s</article>", "<main>%s</main>", "<nav>%s</nav>", "<ul><li>%s</ul>", "<div class='ad'>%s</div>", "<section id='related-work'>%s</section>"]) % "".join(part(d - 1) if d and r.random() < 0.6 else r.choice(["word ", "<a href='#'>x</a>", LONG + " ", "<b>few</b> words "]) for _ in range(r.randrange(1, 5)))
        page = "<body>" + "".join(part(3) for _ in range(r.randrange(1, 7))) + "</body>"
        assert html_text.main_text(page) == brute_main(page)
        decided += len(html_text.main_text(page)) < len("\n".join(t for t, _, _, out, _ in lines_of(page) if not out))
    assert decided > 50  # pages of which the cluster leaves parts out


def lines_of(page):
    return html_text.read(page).lines


ARTICLE = f"<article><h1>Head</h1>{TEXT}</article>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<div class='content-with-sidebar'>{ARTICLE}</div>", f"Head\n{LINES}"),
        (f"<form id='aspnetForm'><nav>Home</nav><h1>Head</h1>{TEXT}</form>", f"Head\n{LINES}"),
        (f"<form><div class='page'>{TEXT}</div></form>", LINES),
        (f"<div class='ad-free story'><h1>Head</h1>{TEXT}</div>", f"Head\n{LINES}"),
        (f"<div class='page with nav'>{ARTICLE}<div class='nav'>Home</div></div>", f"Head\n{LINES}"),
        (f"<div class='article-comment'>{TEXT}</div><p>x</p>", f"{LINES}\nx"),
        (f"<div class='product-promo'>{TEXT}</div><p>x</p>", f"{LINES}\nx"),
        (f"<h1>Head</h1><div class='share'>Share this</div>{TEXT}", f"Head\n{LINES}"),
        (f"<article><header><h1>Head</h1><p>By X</p></header>{TEXT}</article>", f"Head\n{LINES}"),
        (f"{TEXT}<div class='ad'>Buy</div><p>The end.</p><div class='ad'>Buy</div><p><a href='#'>More.</a></p>", f"{LINES}\nThe end."),
        (f"<article><p>Short.</p></article><div class='comments'><h1>All</h1>{TEXT}</div>", "Short."),
        (f"<article><p>Short.</p></article><div class='sidebar'>{TEXT}</div>", "Short."),
        (f"<div class='related'><article>A card</article></div>{ARTICLE}<form><input><p>Write</p></form>", f"Head\n{LINES}"),
        (f"<div class='cookie-notice'>We use cookies.</div><div class='site-header'>Site</div>{ARTICLE}", f"Head\n{LINES}"),
    ],
)
def test_wrappers_are_no_notices(body, want):
    assert html_text.main_text(f"<html><head><title>T</title></head><body>{body}<footer>&copy; Us</footer></body></html>") == want


def test_ids_headings_and_depth():
    body = f"<section id='related-work'><h2 id='share-prices'>Prices</h2>{TEXT}</section><h2 class='menu-planning'>Menus</h2>{TEXT}<div id='comments'>First</div>"
    assert html_text.main_text(f"<body>{body}</body>") == f"Prices\n{LINES}\nMenus\n{LINES}"
    start = time.time()
    for page in ("<div>x" * 40_000, "<p>" + "<span>" * 40_000 + "</i>" * 40_000, "<div>" * 40_000 + "</section>" * 40_000):
        html_text.main_text(page)
    assert time.time() - start < 12


def test_smoothing_keeps_a_constant():
    import numpy as np

    assert np.allclose(html_text.smoothed(np.full(7, 3.0), 1.0), 3.0)


# tokens

TEXTS = ["", " ", "a", " a", "  a  b ", "a\n\n b", "<s> hi </s>", "\x00a", "日本 語😀", "\t tab", "é́", "<0x41>", "x" * 3000 + " " * 50, " " * 17 + "the", "The quick brown fox"]


def need_model():
    if not os.path.exists(tokens.MODEL):
        pytest.skip("no vocabulary here")
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokens.MODEL)


def test_parity_with_sentencepiece():
    judge, codec, r = need_model(), tokens.Codec(tokens.MODEL), random.Random(3)
    texts = TEXTS + ["".join(r.choice(" xa  the\n<é▁") for _ in range(r.randrange(60))) for _ in range(2000)]
    ids = codec.encode(texts)
    assert ids == judge.encode(texts) and codec.encode(texts) == ids
    assert all(b == t for t, b in zip(texts, codec.decode(ids), strict=True) if "▁" not in t)
    assert codec.decode(ids) == [codec.tokenizer.decode(i, skip_special_tokens=False) for i in ids]


def test_tokenize(spark):
    judge = need_model()
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, "x", None), (90, None, None), (91, "same", None), (91, "same", None)]
    out = tokens.tokenize(docs(spark, rows), ["doc_id"], verify_every=1).collect()
    assert len(out) == len(rows)
    for r in out:
        t = dict((i, t) for i, t, _ in rows)[r["doc_id"]]
        assert r["tokens"] == (None if t is None else judge.encode(t)) and r["parity"] is (None if t is None else True) and r["round_trip"] is (None if t is None else True)
    assert "tokens" not in tokens.tokenize(docs(spark, []), ["doc_id"], ids=False).columns


def test_every_text_is_verified(spark):
    judge = need_model()
    rows = [(i, f"{t} {i}", "en") for i, t in enumerate(TEXTS * 4)] + [(900, None, None)]
    for r in tokens.tokenize(docs(spark, rows), ["doc_id"]).collect():
        t = dict((i, t) for i, t, _ in rows)[r["doc_id"]]
        assert r["parity"] is (None if t is None else True) and r["tokens"] == (None if t is None else judge.encode(t))


@pytest.mark.parametrize("by_word", [True, False])
def test_ids_that_differ_are_replaced(monkeypatch, by_word):
    """With a tokenizer whose merges are in a wrong order, ids are sentencepiece's and parity tells where they weren't."""
    judge, right, r = need_model(), tokens.merges_of, random.Random(3)
    monkeypatch.setattr(tokens, "merges_of", lambda pieces: right(pieces)[::-1])
    texts = TEXTS + ["".join(r.choice(" xa  the\n<é▁") for _ in range(r.randrange(60))) for _ in range(500)]
    plain, codec = tokens.Codec(tokens.MODEL), tokens.Codec(tokens.MODEL, judge=judge)
    plain.by_word = codec.by_word = codec.words_judged = by_word
    own, want = plain.encode(texts), judge.encode(texts)
    for part in (slice(0, 300), slice(200, None)):  # the second time some words are known
        ids, same = codec.verified(texts[part])
        assert ids == want[part] and same == [a == b for a, b in zip(own[part], want[part], strict=True)] and not all(same) and any(same)


def test_unseen_words_are_judged_together_and_a_codec_is_kept():
    """Words are met once a call, joined for both libraries; a worker's next task has the codec, and its words, of the last."""
    judge, codec = need_model(), tokens.codec_of(tokens.MODEL, 2)
    assert tokens.codec_of(tokens.MODEL, 2) is codec
    asked = []

    class Judge:
        def encode(self, texts, **how):
            asked.extend([texts] if isinstance(texts, str) else texts)
            return judge.encode(texts, **how)

    codec = tokens.Codec(tokens.MODEL, judge=Judge())
    texts = [" ".join(f"w{n}ord{k * n % 991}" for n in range(100)) for k in range(40)] + TEXTS
    assert codec.verified(texts) == (judge.encode(texts), [True] * len(texts)) and len(asked) < 100
    del asked[:]
    assert codec.encode(texts) == judge.encode(texts) and len(asked) <= 1


def message(*fields):
    """A protobuf message of (number, bytes or int or float)."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for n, v in fields:
        if isinstance(v, float):
            out += varint(n << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(n << 3) + varint(v)
        else:
            out += varint(n << 3 | 2) + varint(len(v)) + v
    return out


FIRST = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
BYTES = [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
UNI = [("▁", -2.0), ("▁a", -2.5), ("a", -3.0), ("b", -3.1), ("ab", -3.5), ("▁ab", -3.2), ("c", -4.0), ("abc", -9.0), ("<", -5.0), (">", -5.0), ("s", -5.0), ("0", -6.0), ("x", -6.0), ("4", -6.0), ("1", -6.0), ("<s", -7.0)]
ODD_TEXTS = ["ab abc", "aab é b", "", "cab  ab", "abcabc", "a <s> b", "x <0x41> y", "\nthe fox", " \n a b \n ", "the <tag> fox", "<tag><tag> a<tag>b", "a<ta g>", "日本 <unk> </s>", "  a", "b  ", "\ta", "é\n\n é", "<sep>ab<sep><tag>"]


def model_file(tmp_path, pieces, kind, remove=0, fallback=1):
    """A model written by hand."""
    model = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    model += message((2, message((3, kind), (35, fallback))), (3, message((1, b"identity"), (3, 1), (4, remove), (5, 1))))
    path = tmp_path / f"{kind}-{remove}-{fallback}-{len(pieces)}.model"
    path.write_bytes(model)
    return str(path)


@pytest.mark.parametrize("remove", [0, 1])
@pytest.mark.parametrize("fallback", [0, 1])
@pytest.mark.parametrize("symbols", [(), ("<tag>", "<sep>")])
def test_unigram_model(tmp_path, remove, fallback, symbols):
    """Scores, metaspace, byte fallback, control and user-defined pieces as sentencepiece reads them."""
    import sentencepiece

    path = model_file(tmp_path, FIRST + [(x, 0.0, 4) for x in symbols] + BYTES * fallback + [(p, s, 1) for p, s in UNI], 1, remove, fallback)
    judge, codec, r = sentencepiece.SentencePieceProcessor(model_file=path), tokens.Codec(path), random.Random(3)
    texts = ODD_TEXTS + ["".join(r.choice(["a", "b", "c", " ", "ab", "<s>", "<0x41>", "<tag>", "<sep>", "\n", "é", "x"]) for _ in range(r.randrange(30))) for _ in range(500)]
    assert codec.encode(texts) == judge.encode(texts)
    if fallback and not remove:
        assert codec.decode(codec.encode(texts)) == texts


@pytest.mark.parametrize("symbols", [(), ("<tag>", "<sep>")])
def test_bpe_model(tmp_path, symbols):
    import sentencepiece

    letters = [(c, -20.0 - i, 1) for i, c in enumerate("▁abctheofx<>sg0142")]
    merged = [(p, -float(i), 1) for i, p in enumerate(["th", "▁th", "▁the", "ab", "abc", "▁a", "ta", "▁f", "<s", "ox"])]
    path = model_file(tmp_path, FIRST + [(x, 0.0, 4) for x in symbols] + BYTES + merged + letters, 2)
    judge, codec, r = sentencepiece.SentencePieceProcessor(model_file=path), tokens.Codec(path), random.Random(4)
    texts = ODD_TEXTS + ["".join(r.choice(["a", "b", "c", " ", "the", "<s>", "<0x41>", "<tag>", "<sep>", "\n", "é", "fox"]) for _ in range(r.randrange(30))) for _ in range(500)]
    assert codec.encode(texts) == judge.encode(texts) and codec.decode(codec.encode(texts)) == texts
