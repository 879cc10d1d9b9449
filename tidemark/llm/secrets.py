"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content. The
ledger, Parquet files in a shared folder, holds for each blob the rules
(name and version) it was scanned with and what each found. A run scans only the
pairs of blob and rule version that the ledger lacks, adds what it found, and
joins findings back to all paths that hold the blob.

Addresses are shuffled, texts are not: where the unseen blobs are few, their addresses
are sent to the paths; where there is no ledger yet, every blob is unseen. Tasks
then scan texts where they are read. Copies in one task are scanned once; copies in different
tasks are scanned by each, and the ledger takes one of their equal findings. Only if
a large part of an older ledger is unseen are its texts brought together by address.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, fresh_dir, named, text_chunks, written

#: The three base patterns are fixed by the contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
SPANS = "array<struct<kind: string, start: int, end: int>>"
LEDGER_SPANS = "array<struct<kind: string, start: int, end: int, rule: string>>"


@dataclass(frozen=True)
class Rule:
    """keep decides on a match; kinds are listed in the order of the rules."""

    kind: str
    version: int
    pattern: re.Pattern
    keep: Callable[[re.Match], bool]

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, re.compile(ASSIGN, re.IGNORECASE | re.ASCII), lambda m: len(m[2]) >= 6),
    Rule("access", 1, re.compile(ACCESS), lambda m: m.end() - m.start() >= 20),
    Rule("hex", 1, re.compile(HEX), lambda m: m.end() - m.start() >= 24),
    Rule("pem", 1, re.compile(PEM), lambda m: True),
)
BASE = ("assign", "access", "hex")


def matches(text: str | None, rules=RULES) -> list[tuple[Rule, int, int]]:
    """Spans by start, then by the order of the rules."""
    found = [(m.start(), k, m.end()) for k, r in enumerate(rules) for m in r.pattern.finditer(text or "") if r.keep(m)]
    return [(rules[k], s, e) for s, k, e in sorted(found)]


def find_secrets(text: str | None, rules=RULES) -> list[tuple[str, int, int]]:
    return [(r.kind, s, e) for r, s, e in matches(text, rules)]


#: A task remembers so many addresses that it has scanned.
REMEMBERED = 1 << 17
FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("rule", pa.string())]))
LEDGER = f"blob string, rules array<string>, spans {LEDGER_SPANS}"


def search(batches: Iterator[pa.RecordBatch], rules: tuple) -> Iterator[pa.RecordBatch]:
    """Ledger rows of texts (blob, todo, _text): each address once, as far as remembered."""
    done: dict[str, None] = {}
    for piece, texts in text_chunks(batches, "_text"):
        blobs, rows, out = [], [], []
        for blob, todo, t in zip(piece["blob"].to_pylist(), piece["todo"].to_pylist(), texts, strict=True):
            if blob in done:
                continue
            done[blob] = None
            wanted = [r for r in rules if r.tag in todo]
            blobs.append(blob)
            rows.append(todo)
            out.append([{"kind": r.kind, "start": s, "end": e, "rule": r.tag} for r, s, e in matches(t, wanted)])
        while len(done) > REMEMBERED:
            del done[next(iter(done))]
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(rows, pa.list_(pa.string())), pa.array(out, FOUND)], names=["blob", "rules", "spans"])


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """All that earlier runs found, or None before the first."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan(paths: DataFrame, ledger: str | None = None, text: str = "text", rules=RULES, broadcast_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """(paths with their blob and spans, blobs scanned in this run).

    paths: one row for each version of a path; its columns stay, but for the
    text; ``blob`` and ``spans`` follow (a column so named beforehand gives way). A null text is the empty one; repeated
    rows and paths share their blob's findings and keep their rows. ledger: the
    ledger's folder, to which each run adds a folder of its own, whole or not at all; without one a fresh ledger is begun in the shared folder. Its
    spans carry the tag of their rule, and those of rules that no longer hold don't count.
    Unseen addresses are broadcast if they take less than ``broadcast_bytes``.
    """
    spark = paths.sparkSession
    ledger = ledger or fresh_dir(spark, "ledger")
    content = F.coalesce(named(text), F.lit(""))
    address = F.sha2(content.cast("binary"), 256)
    tags = F.array(*[F.lit(r.tag) for r in rules])
    known = read_ledger(spark, ledger)
    texts = paths.select(address.alias("blob"), content.alias("_text"))
    if known is None:
        todo = texts.withColumn("todo", tags)
    else:
        seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))  # at most the versions there ever were
        unseen = F.array_except(tags, F.coalesce("seen", F.array().cast("array<string>")))
        wanted = written(paths.select(address.alias("blob")).distinct().join(seen, "blob", "left").select("blob", unseen.alias("todo")).where(F.size("todo") > 0), "unseen")
        n = wanted.agg(F.sum(F.size("todo") * 24 + 80)).first()[0] or 0
        if n <= broadcast_bytes:
            todo = texts.join(F.broadcast(wanted), "blob")
        else:  # copies meet within each task first
            todo = texts.groupBy("blob").agg(F.first("_text").alias("_text")).join(wanted, "blob")
    run = f"{ledger}/run-{uuid.uuid4().hex}"
    todo.select("blob", "todo", "_text").mapInArrow(lambda batches: search(batches, rules), LEDGER).write.parquet(run)
    scanned = spark.read.schema(LEDGER).parquet(run).dropDuplicates(["blob"])
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)])
    entry = F.struct(F.col("s.start").alias("start"), order[F.col("s.kind")].alias("k"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"))
    current = read_ledger(spark, ledger).where(F.arrays_overlap("rules", tags) & (F.size("spans") > 0))
    spans = current.select("blob", "rules", F.explode("spans").alias("s")).where(F.col("s.rule").isin([r.tag for r in rules]))
    # a blob's findings are bounded by its own text; those of copies are equal. They are a table before
    # the join, so that Spark can split the paths of one blob that stands at a share of them all
    blob, spans_of, own = free_names(paths.columns, "_blob", "_found", "_own")
    found = written(spans.groupBy(F.col("blob").alias(blob)).agg(F.array_sort(F.collect_set(entry)).alias(spans_of)), "findings")
    plain = F.transform(spans_of, lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end")))
    keep = [named(c) for c in paths.columns if c not in (text, "blob", "spans")]
    left = paths.select(*keep, address.alias(own))
    out = left.join(found, F.col(own) == F.col(blob), "left")
    return out.select(*keep, F.col(own).alias("blob"), F.coalesce(plain, F.array().cast(SPANS)).alias("spans")), scanned


def span_string(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
