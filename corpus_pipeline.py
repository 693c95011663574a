"""A training-data pipeline: toxic documents out, repeated lines out, near duplicates out, sources mixed, texts encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents`` (extra columns stay as they are). A stage that
changes texts sets ``n_chars`` anew. Nulls, empty texts, empty tables and repeated rows: see the operators' docstrings; no
stage drops a document but for the reason that its name gives.
"""

from __future__ import annotations

from hashlib import sha256

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanlens.llm.common import table, unused, written
from urbanlens.llm.line_dedup import drop_repeated_lines
from urbanlens.llm.mixing import mix
from urbanlens.llm.near_dedup import near_duplicates
from urbanlens.llm.toxicity import without_toxic
from urbanlens.llm.word_bpe import word_bpe


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator, learned from the labelled ones, doesn't predict toxic."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of a line that ten of them or more hold the first occurrence stays, by document and position. So the
    text of a document copied ten times or more stays once, and near copies that each add lines of their own keep these."""
    cut = drop_repeated_lines(docs, least=10, keep_first=True)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five-word shingles, similarity of 0.8).
    Rows without an id and texts without words are no duplicates."""
    (dropped,) = unused(docs.columns, "_near_doc")
    out = near_duplicates(docs, words=5, percent=80).filter(~F.col("kept")).select(F.col("doc_id").alias(dropped)).distinct()
    return docs.join(out, F.col("doc_id") == F.col(dropped), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (weights 3, 1, 2 in turn, half as many words again)."""
    return mix(docs)


def word_bpe_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each row its id, token ids (as little-endian unsigned 32-bit integers), their number, and the digest of
    the decoded text."""
    return word_bpe(docs, public_tokenizers.path("word_bpe_49k.json"), {
        "n_tokens": ("long", lambda ids, _: len(ids) // 4),
        "ids": ("binary", lambda ids, _: ids),
        "decoded_sha256": ("string", lambda _, text: sha256(text.encode()).hexdigest()),
    })


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("word_bpe", word_bpe_codes)]

#: SQL can't express the learned scores, the hashes of the mix or the encoding: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
