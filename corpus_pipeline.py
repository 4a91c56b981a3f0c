"""The corpus pipeline: quality rules, near-dedup, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from changelens.llm import mixing, packing, pii, quality, simhash
from changelens.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of documents that the quality rules keep.

    Null and empty texts have no words and go; repeated rows are judged alike
    and stay repeated; of an unknown or null language only the base rules judge;
    an empty table gives none; further columns stay as they are.
    """
    return quality.judge(docs).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates (5-word shingles, Jaccard of 0.8 or more): that of the smallest doc_id.

    All null, empty and blank texts are one component; a null doc_id is never
    the smallest unless all are null; of repeated rows one stays; an empty table
    gives none; further columns stay as they are.
    """
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind and n_chars set anew.

    Null texts stay null, repeated rows are all kept, an empty table gives none.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows as often, and with the words, as the targets of their sources take them.

    Null and empty texts have no words and are not taken; a null source is a
    source, the last; repeated rows count each; an empty table gives none.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the rows' ids and their places in training sequences.

    A null text has its end id alone; repeated rows are packed each; an empty
    table gives none.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashes, fitted patterns and the window plan have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
