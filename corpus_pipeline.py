"""A corpus pipeline: five operators, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripleforge.llm import exact_dedup, language_id, mixing, sentencepiece_viterbi, simhash
from tripleforge.llm.common import new_path, read, remove, staged


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language can be told.  Null texts and texts without a letter go; repeated rows are told alike."""
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest id.  Null texts count as empty; of rows that repeat id and text one stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the one with the smallest id.  Null and empty texts are near copies of each other."""
    return simhash.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as often as the mix of sources takes them.  Null is a source; null texts have no words and are not taken."""
    return mixing.repeat(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts: doc_id, ids, n_ids, round_trip.  Null texts have null ids; repeated rows are encoded alike."""
    return sentencepiece_viterbi.encode(docs, sentencepiece_viterbi.model_bytes())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The stages train a network, search near copies and encode; SQL expresses none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again, and removed once the next is written.

    Rows without an id, with a null or empty text or repeated are taken as each stage's operator says; an empty table
    gives an empty result.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = new_path(spark)
            docs = staged(docs, path)
            if before:
                remove(spark, before)
            before = path
    return docs
