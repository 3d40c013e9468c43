"""The corpus pipeline: five operators in a row over `documents`.

A stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns
of documents; the last returns the training run. Stages stand alone: each works
on whatever table of documents it is given.

- quality: documents that importance resampling rejects go.
- line_dedup: boilerplate lines of a source go from the texts.
- near_dedup: of documents that are near copies (shingles of five words,
  similarity 0.8) the one with the least id stays.
- decontamination: words inside benchmark windows go from the texts, and
  documents with two or more benchmark items go whole.
- mixing: documents are repeated to their source's target and ordered along
  the curriculum; copy, position and take (words) come with each.

Defined cases: a null text has importance 0, no lines, no near copies and no
windows, and stays until mixing, which takes no document without words; the
same holds for an empty text. Very long texts are worked on whole. Repeated
rows are pages of their own for line_dedup, and one of them is left by
near_dedup. Of documents with the same id each is judged by its own text. A
null id is labelled by nothing; a null source is a source. Ties are broken by
hashes of the rows, so reruns agree. An empty table gives no rows, a table of
labels or benchmark items that is empty rejects nothing. Columns beside those
of documents pass through; one with the name of a stage's own column (n_words,
kept, copy, ...) keeps its values in all stages but mixing, which sets copy,
position and take.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm import lines, minhash, mixing, quality
from phasegrid.llm.common import aside, delete, shared_path, table, tidy
from phasegrid.llm.decontaminate import decontaminate


def _apart(docs: DataFrame, *made: str) -> DataFrame:
    """docs, with columns that have the name of one that a stage makes renamed."""
    return docs.toDF(*[aside(docs, f"{c}_")[0] if c.lower() in made else c for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = _apart(docs, "importance", "sample_key", "kept")
    found = quality.classify(own, table(spark, sf_dir, "labels"))
    return found.filter("kept").select(*[f"`{c}`" for c in own.columns]).toDF(*docs.columns)


def _new_text(found: DataFrame, docs: DataFrame) -> DataFrame:
    """docs' columns, the text replaced where the operator changed it."""
    changed = ~F.col("clean_text").eqNullSafe(F.col("text"))
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("clean_text")).alias("text")
    size = F.when(changed & F.col("text").isNotNull(), F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return found.select(*[{"text": text, "n_chars": size}.get(c, F.col(f"`{c}`")) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = _apart(docs, "n_lines", "n_dropped", "clean_text")
    return _new_text(lines.drop_lines(own), own).toDF(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = _apart(docs, "n_words", "n_hit", "items", "spans", "clean_text", "n_items", "contaminated")
    found = decontaminate(own, table(spark, sf_dir, "benchmark"))
    return _new_text(found.filter("NOT contaminated"), own).toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.curriculum(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
#: The first stage hashes n-grams and draws noise in ways SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage but it is written as Parquet in
    the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        with tidy():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
