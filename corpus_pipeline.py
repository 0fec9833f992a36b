"""The corpus pipeline: language ID, line dedup, near-duplicates, source mix, packing.

Each stage takes the documents that the one before kept, written as Parquet and
read again, and returns documents with the same columns; the last one returns
packed pieces.

Every stage takes nulls in any column, empty and very long texts (whole), ties,
repeated rows, empty tables (no rows come out) and further columns with any
names, which the first four pass on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmroll.llm import language_id, line_dedup, mixing, ngram_join, packing
from filmroll.llm.common import documents, materialize


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt from ``docs``; those without a letter, or without a likely language, go.

    So null and empty texts go; repeated rows are judged alike.
    """
    return language_id.keep_identified(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources carry.

    All rows stay, null texts null; ``n_chars`` counts the text that is left.
    """
    cleaned = line_dedup.clean_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of every group of near-duplicates.

    Rows are judged one by one: of repeated ones one stays, null doc_ids come
    last, and texts without words stay.
    """
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the source mix takes them.

    Rows without words go; null sources are one source.
    """
    return mixing.curriculum(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens.

    Every row, null and repeated ones too, has at least the piece of its end token.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the language model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
