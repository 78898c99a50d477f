"""The corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes what its predecessor kept. The first four return documents with their columns; the last returns the
pieces of the packed sequences.

In every stage rows are documents each: null ids are no common id, and rows that share an id but differ in text stay
apart. Null and empty texts have no words, so that the quality rules drop them; later stages, given them, keep them as
they are (near_duplicates: one of them, as they are alike). Repeated rows are duplicates of each other. Very long texts
are taken whole. Ties are broken by id and then by a hash of the text. Empty tables give no rows. Columns may have any
names besides and keep their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import materialize, read_table
from tidewater.llm.packing import pack, pieces
from tidewater.llm.pii import redact
from tidewater.llm.quality import quality_filter
from tidewater.llm.simhash import simhash_dedup
from tidewater.llm.substring_dedup import substring_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go (operator 5)."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (operator 9)."""
    return simhash_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document of smaller id holds go from the texts (operator 2)."""
    return substring_filter(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind (operator 8)."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, packed into sequences (operator 4)."""
    return pack(pieces(docs))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packing)]

#: Tokenizers, fingerprints and fitted classifiers are beyond SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
