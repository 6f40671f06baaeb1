"""Corpus pipeline: language, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its
predecessor kept, and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of
documents; the last returns the packed pieces. Every stage is one operator of
``quakespark.llm`` with its production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quakespark.llm.common import settle, table
from quakespark.llm.exact_dedup import drop_copies
from quakespark.llm.language import label_languages
from quakespark.llm.mixing import repeat_mixed
from quakespark.llm.ngram_join import drop_near_copies
from quakespark.llm.packing import pack


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told, with lang as the text has it: missing labels, and those that a sure prediction contradicts, are replaced. Texts without a letter go."""
    return label_languages(docs)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside: that with the smallest doc_id."""
    return drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 0.8 of their five-word shingles or more."""
    return drop_near_copies(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often (0 to 2 times) as the mixture of sources takes them."""
    return repeat_mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", remove_copies),
    ("ngram_jaccard", remove_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the language model nor the shingle hashes' order.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = settle(docs, name)
    return docs
