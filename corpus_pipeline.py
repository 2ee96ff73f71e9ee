"""A corpus pipeline: documents to packed sequences, each stage on all that the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents.

Defined results: a null or empty text has no language, so its row goes in stage 1; rows that
repeat are copies, of which stage 2 keeps one; rows without an id take part like all others;
further columns, of any name, are handed on; very long texts are read whole; an empty table
gives no rows at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import jaccard, langid, packing, pii, substrings
from tessella.llm.common import materialise, table
from tessella.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1 (operator 6): documents without a letter, of no language that the model finds
    likelier than chance, or too surprising for any language that it learned, go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2 (operator 10): of each group of near duplicates the smallest id stays."""
    return jaccard.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3 (operator 2): passages that occurred before are cut out of the texts."""
    return substrings.remove_repeats(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4 (operator 4): personal data and the words that give it away are replaced."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5 (operator 1): the kept texts as pieces of packed sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("PII", sanitise),
    ("best-fit packing", pack),
]

#: The trained model, MinHash and the tokenizer can't be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with the lineage cut behind each."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
