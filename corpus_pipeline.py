"""Corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing, applied to ``documents``.

Each stage takes all rows that its predecessor kept, as they were written to the shared folder and read back.  All
stages but the last return the columns of ``documents``.  An empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontamination import without_contaminated
from tidemark.llm.near_copies import one_copy_of_each
from tidemark.llm.packing import packed, pieces
from tidemark.llm.quality import quality_cascade
from tidemark.llm.secrets import redact
from tidemark.llm.tokens import public_tokenizer
from tidemark.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; a null, empty or short text is rejected, repeated rows are judged alike."""
    return quality_cascade(docs).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8), that with the smallest id.

    Null and blank texts are one class; of rows with equal ids those of other classes stay, of equal rows one.
    """
    return one_copy_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs; null and blank texts stay, each row is judged by itself."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts redacted; null texts stay null, repeated rows stay."""
    return redact(docs, chars_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences; a null text has the end id alone."""
    return packed(pieces(docs, public_tokenizer()))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("pack", pack),
]

# Near-duplicate links, banded alignment and packing have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is stored before the next one starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
