"""A training corpus from raw documents: five stages, each written as Parquet and read again.

All stages take any documents table: null texts count as empty ones, texts of
any length are read whole, an empty table gives an empty one, and extra columns
pass through all stages but the last, whatever their names. What else is odd,
the stages' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, toxicity
from tidemark.llm.common import keep_table
from tidemark.llm.decontaminate import find_copies
from tidemark.llm.jaccard_join import jaccard_groups
from tidemark.llm.line_dedup import drop_shared_lines


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field scores below 0.5.

    Each row is judged by its own text, so rows that repeat an id may part and
    equal rows stay or go together. A score of just 0.5 goes. Empty texts stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that they share with later ones; n_chars follows the text.

    Every row stays, if with an empty text. Rows that repeat an id count as one
    document; rows with a null id keep their lines. A null text becomes an empty one.
    """
    # The operator adds counts of its own under names that the table may have.
    own = {c: f"__given_{c}" for c in docs.columns if c in ("n_lines", "n_dropped")}
    kept = drop_shared_lines(docs.withColumnsRenamed(own))
    return kept.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(own.get(c, c)).alias(c) for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group that near-duplicate links connect.

    All rows that bear that id stay. Rows with a null id or an empty text are in
    no group and stay.
    """
    gone = jaccard_groups(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item.

    All rows that bear the id of a document with a copy go; rows with a null id
    stay. Null or empty items have no copies.
    """
    leaks = find_copies(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count and digests of its IDs and of what they decode to, a row for a row; null ids stay."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("jaccard_join", one_of_each_group), ("decontamination", drop_leaks), ("bpe", tokens)]

#: SQL cannot express the toxicity field, the alignment and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = keep_table(stage(spark, docs, sf_dir))
    return docs
