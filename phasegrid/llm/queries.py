"""The queries of this package and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm.common import table
from phasegrid.llm import embeddings, lines, minhash, mixing, quality, secrets, substrings, tokens, warc
from phasegrid.llm.decontaminate import decontaminate
from phasegrid.llm.oracle import ORACLES  # noqa: F401


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and benchmark items of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), texts=False)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from each document, its source as the site."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = lines.drop_lines(docs, min_pages=5)  # as its SQL has it
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document."""
    out = secrets.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(secrets.joined(F.col("secrets"), secrets.KINDS[: secrets.BASE]), 256)
    return out.select("doc_id", *map(number, secrets.KINDS[: secrets.BASE]), base.alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of a label with a cosine of 0.98."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document covered by a repeated string of 200 bytes."""
    out = substrings.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance, key and decision for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by encoded length and at the usual context limits,
    with their suffix sums."""
    return tokens.length_table(table(spark, sf_dir, "documents").select("text"), limits=tokens.LIMITS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read back from the archives written of all pages."""
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document, how often, and where along the curriculum
    its first and last copies stand; in the order of the run."""
    out = mixing.schedule(table(spark, sf_dir, "documents"), keep=["doc_id"])
    places = [F.round(c, 9).alias(c) for c in ("first_position", "last_position")]
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", *places)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles are 80 % alike."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4).drop("print", "group")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_mixing": op9_mixing,
    "op10_minhash": op10_minhash,
}
