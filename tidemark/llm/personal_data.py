"""Personal data: base patterns, and contextual extraction bootstrapped from them.

Base matches are the seeds. The word before a seed in its line, the two words before it, the word
after it and the two after it are lexical patterns;
what patterns and instances (values) meet in the corpus forms a graph. Spark
scores it in turns: a pattern by the part of its instances that are known, an
instance by its patterns. Instances are, besides seeds, all values with the shape of an identifier:
words with digits, and runs of such words, of 5 to 40 letters and digits of which
4 or more are digits. What kind of data such a value is, contexts alone say; only few shapes bring
a kind with them (a phone number without a plus, a masked e-mail address, a card
number with a wrong check digit, an IPv6 address). Values become known once patterns of
high confidence vouch for them, and are then spans of kind ``ctx_<kind>`` wherever they stand.
"""

from __future__ import annotations

import bisect
import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns are fixed by the contract; possessive digits and the scan
#: from the @ keep them linear on any text.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Values that resemble a kind without being one.
LIKE = {
    "phone": re.compile(r"(?<![\w+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])"),
    "ip": re.compile(r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])"),
}
#: A word that holds a digit; what an identifier is made of; and how many letters and digits it has, and digits at least.
DIGIT_WORD = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*+")
MADE_OF = re.compile(r"[A-Za-z0-9./:_+()-]+")
LENGTHS, DIGITS = range(5, 41), 4
AT = re.compile(r" ?[\[(]at[\])] ?")
DOTTED = re.compile(r"[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Matches of local@domain: each @ takes the local part that ends there, back
    to the last match at most, and the longest domain after it."""
    reach, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > reach and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            reach = m.end()
        at = text.find("@", max(reach, at + 1))


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind as listed."""
    if not text:
        return []
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def masked_emails(text: str):
    """Spans of addresses written as ``name (at) host (dot) org``, found from the mark, as ``emails`` does."""
    reach = 0
    for m in AT.finditer(text):
        start = m.start()
        while start > reach and text[start - 1] in LOCAL:
            start -= 1
        while start < m.start() and not text[start].isalnum():
            start += 1
        if start < m.start() and m.start() >= reach and (d := DOTTED.match(text, m.end())):
            yield start, d.end()
            reach = d.end()


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without signs at its ends."""
    while start < end and not text[start].isalnum():
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    return start, end


def identifiers(text: str):
    """Spans of values with the shape of an identifier: words with digits, joined where one blank lies between them and no other sign."""
    run: tuple[int, int, bool] | None = None  # where it starts and ends, without signs at its ends, and whether its last word may be joined
    for m in itertools.chain(DIGIT_WORD.finditer(text), [None]):
        start, end = trimmed(text, *m.span()) if m else (0, 0)
        fits = bool(m and MADE_OF.fullmatch(text, start, end))
        if fits and run and run[2] and start == m.start() == run[1] + 1 and text[run[1]] == " ":
            run = run[0], end, end == m.end()
            continue
        if run and run[1] - run[0] <= 3 * LENGTHS.stop and sum(map(str.isalnum, value := text[run[0] : run[1]])) in LENGTHS and len(digits_of(value)) >= DIGITS:
            yield run[:2]
        run = (start, end, end == m.end()) if fits else None


def clear_of(spans: list[tuple], near: list[tuple]) -> list[tuple]:
    """Of (kind, start, end) those that overlap none of the spans."""
    taken = sorted((s, e) for _, s, e in spans)
    starts, reach = [s for s, _ in taken], list(itertools.accumulate((e for _, e in taken), max))
    before = lambda e: bisect.bisect_left(starts, e)
    return [(k, s, e) for k, s, e in near if not (n := before(e)) or reach[n - 1] <= s]


def next_words(text: str, at: int, step: int) -> list[str]:
    """Up to two words of letters that follow each other from a position on, going back or forth in its line; next to the position, first."""
    out: list[str] = []
    i = at if step > 0 else at - 1
    is_word = lambda c: c.isalnum() or c == "_"
    while len(out) < 2:
        gap = i
        while 0 <= i < len(text) and text[i] != "\n" and not is_word(text[i]):
            i += step
        if not 0 <= i < len(text) or text[i] == "\n" or (out and i == gap):
            break
        begin = i
        while 0 <= i < len(text) and is_word(text[i]):
            i += step
        word = text[begin:i] if step > 0 else text[i + 1 : begin + 1]
        if not word.isalpha() or (not out and begin == gap):  # other signs in it, or no gap before the value
            break
        out.append(word.lower())
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns around a value, _ being its place."""
    before, after = next_words(text, start, -1), next_words(text, end, 1)
    return [" ".join([*reversed(before[:n]), "_"]) for n in range(1, len(before) + 1)] + [" ".join(["_", *after[:n]]) for n in range(1, len(after) + 1)]


def candidates(text: str | None, spans: list[tuple[str, int, int]]) -> list[tuple]:
    """(kind, known, start, end, value, contexts) of base spans, of what resembles one outside them, and,
    of no kind, of other values with the shape of an identifier."""
    if not text:
        return []
    near = [(k, m.start(), m.end()) for k, p in LIKE.items() for m in p.finditer(text)]
    near += [("email", s, e) for s, e in masked_emails(text)]
    near += [("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and not luhn(d) and not text[max(0, m.start() - 1) : m.start()].isalnum() and not text[m.end() : m.end() + 1].isalnum()]
    near = clear_of(spans, near)
    near += clear_of([*spans, *near], [(None, s, e) for s, e in identifiers(text)])
    found = [(k, True, s, e) for k, s, e in spans] + [(k, False, s, e) for k, s, e in near]
    return [(k, known, s, e, text[s:e].lower(), contexts(text, s, e)) for k, known, s, e in found]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
CANDIDATE = pa.struct([("kind", pa.string()), ("known", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("contexts", pa.list_(pa.string()))])


def read_texts(texts: list) -> list:
    spans = [base_spans(t) for t in texts]
    near = [candidates(t, s) for t, s in zip(texts, spans, strict=True)]
    as_dicts = lambda rows, kind: [[dict(zip(kind.names, x, strict=True)) for x in row] for row in rows]
    return [as_dicts(spans, SPAN), as_dicts(near, CANDIDATE)]


def score_graph(edges: DataFrame, rounds: int, confidence: float, support: int) -> DataFrame:
    """Instances outside the base that patterns vouch for: (kind, value).

    edges: (context, kind, value, known), once for each context, kind and value; a value of no kind of its own has an edge for each kind.
    In each round a pattern (context and kind) has confidence F/N, where N counts its context's
    values and F sums the scores of those of its kind; it counts with at least ``support`` known instances. An
    instance's score is one less the product of its patterns' doubts. Of a value's kinds the one with the
    highest score counts, the first by name of equal ones. Scores are written before they are
    joined, so that Spark can split a value or context that stands everywhere.
    """
    edges = written(edges.withColumn("score", F.col("known").cast("double")), "pii-graph")
    for _ in range(rounds):
        n = edges.groupBy("context").agg(F.countDistinct("value").alias("n"))
        f = edges.groupBy("context", "kind").agg(F.sum("score").alias("f"), F.sum(F.col("known").cast("long")).alias("known")).where(F.col("known") >= support).drop("known")
        patterns = written(f.join(n, "context").withColumn("conf", F.col("f") / F.col("n")).where(F.col("conf") >= confidence).select("context", "kind", "conf"), "pii-patterns")
        unknown = edges.where(~F.col("known")).join(patterns, ["context", "kind"])
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf")))))
        scores = written(unknown.groupBy("kind", "value").agg((1 - doubt).alias("new")), "pii-scores")
        rescored = edges.join(scores, ["kind", "value"], "left").withColumn("score", F.when(F.col("known"), 1.0).otherwise(F.coalesce("new", F.lit(0.0)))).drop("new")
        edges = written(rescored.select("context", "kind", "value", "known", "score"), "pii-graph")
    sure = edges.where(~F.col("known") & (F.col("score") >= confidence))
    return sure.groupBy("value").agg(F.min_by("kind", F.struct(-F.col("score"), "kind")).alias("kind")).select("kind", "value")


def extract(docs: DataFrame, keep: list[str], text: str = "text", rounds: int = 3, confidence: float = 0.8, support: int = 4) -> DataFrame:
    """``keep`` columns, base (base spans) and spans (these and the discovered ones) for every row.

    A null text is the empty one; repeated rows keep their rows. Spans are
    sorted by start, then kind as listed, discovered kinds last.
    """
    schema = pa.schema([("base", pa.list_(SPAN)), ("near", pa.list_(CANDIDATE))])
    read = written(map_texts(docs, keep, text, schema, lambda: read_texts).withColumn("_row", F.monotonically_increasing_id()), "pii")
    near = read.select("_row", F.explode("near").alias("c")).select("_row", "c.*")
    kinds = F.when(F.col("kind").isNull(), F.array(*[F.lit(k) for k in KINDS])).otherwise(F.array("kind"))
    edges = near.select(F.explode("contexts").alias("context"), kinds.alias("kinds"), "value", "known").select("context", F.explode("kinds").alias("kind"), "value", "known")
    edges = edges.groupBy("context", "kind", "value").agg(F.max("known").alias("known"))
    chosen = written(score_graph(edges, rounds, confidence, support), "pii-chosen").withColumnRenamed("kind", "of")
    met = near.where(~F.col("known")).join(chosen, "value").where(F.col("kind").isNull() | (F.col("kind") == F.col("of")))
    new = met.groupBy("_row").agg(F.collect_list(F.struct(F.concat(F.lit("ctx_"), "of").alias("kind"), "start", "end")).alias("new"))
    order = F.create_map(*[F.lit(x) for i, k in enumerate([*KINDS, *(f"ctx_{k}" for k in KINDS)]) for x in (k, i)])
    both = F.concat("base", F.coalesce("new", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    keyed = F.array_sort(F.transform(both, lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("k"), x["kind"].alias("kind"), x["end"].alias("end"))))
    spans = F.transform(keyed, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return read.drop("near").join(new, "_row", "left").select(*keep, "base", spans.alias("spans"))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
