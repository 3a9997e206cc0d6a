"""The corpus pipeline: documents are filtered by language, deduplicated, decontaminated and packed.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written and read again before the
next. A stage works on every row that the one before it kept. Keys may be null or repeated, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, language, lines, near, packing
from veilspark.llm.common import stored, table
from veilspark.llm.queries import VOCABULARY

def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in any known language or mixture of languages stay; those without a letter, or without a text, go.

    Columns stay as they are, whatever their names; a table without labelled rows has no languages, and nothing stays.
    """
    model = language.fit(spark, docs)
    # The row travels as one column, so that no name of its own can clash with a prediction's.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return language.identify(rows, model).where(F.col("lang_pred") != language.UNKNOWN).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages are deleted from the texts; no document goes. ``n_chars``, where there is one, follows."""
    done = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more.

    Candidates are the links of SimHash (4 of 64 bits), and those of MinHash, as most pairs near that similarity differ in more bits.
    Texts without a word (null ones too) are copies of each other.
    """
    return near.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 2048 tokens. A null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), ids=False)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
