"""The thin queries of this subpackage: (spark, sf_dir) -> DataFrame.

Each applies one operator with production parameters to its whole table and
derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, html_text, language_id, lines, media, minmax, personal_data, secrets, simhash, tokens, vector_codes, warc
from .common import fresh_dir
from .oracles import ORACLES  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha256_text(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the second finds all blobs in it and scans none again."""
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_dir(spark, "ledger")
    secrets.scan(docs, ledger)
    found, _ = secrets.scan(docs, ledger)
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))
    counts = [personal_data.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, sha256_text(secrets.span_string(base)).alias("base_sha256"), secrets.span_string(F.col("spans")).alias("spans"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.extract(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [personal_data.count_kind(F.col("base"), k).alias(f"n_{k}") for k in personal_data.KINDS]
    return found.select("doc_id", *counts, sha256_text(secrets.span_string(F.col("base"))).alias("base_sha256"), secrets.span_string(F.col("spans")).alias("spans"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").cast("long").alias("doc_id"), *media.FEATURES.names)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize(table(spark, sf_dir, "documents"), ["doc_id"], ids=False)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_kept", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digits = F.array_join(F.transform("code", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    return vector_codes.with_label_errors(codes).select("vec_id", digits.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved to the next one; anchors are the ids divisible by 50."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_decontaminate, op3_secret_ledger, op4_personal_data, op5_media_columns, op6_html_text, op7_sentencepiece, op8_simhash, op9_warc, op10_line_dedup,
        op11_vector_codes, op12_minmax, op13_hard_negatives,
    )
}
