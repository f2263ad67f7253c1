"""The corpus pipeline: language ID, near-dedup, decontamination, source mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each one as Parquet in the cluster's shared
folder and reads it again as the next stage's input.

All stages but the last return the columns of ``documents`` (COLUMNS); other columns are left out, whatever their names.
An empty table stays empty in every stage. Null columns other than those that a stage reads are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.llm import blocks, decon, langid, mix, neardup
from panemill.llm.common import fold, table, written

#: A document goes if less of its letters than this is in scripts of learned languages.
LEAST_KNOWN = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language or several; lang is only learned from, never used to judge a document.

    A text without letters (null and empty ones among them) goes, and one most of whose letters are of scripts that no
    learned language has; a text that mixes learned languages stays. Rows are judged one by one: repeated rows all stay or
    all go. Rows without a doc_id are judged as well; whether they are learned from follows from the hash of an empty
    text. Where no row has a lang, nothing is learned and all rows go.
    """
    model = langid.learn(docs.where(fold(F.col("doc_id"), langid.FOLDS) != 0))
    judged = langid.identify(_columns(docs), model)
    return _columns(judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("known_share") >= LEAST_KNOWN)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, by shingles of five words.

    Of equal rows one stays. Rows that share a doc_id are judged each by its own text. Rows without a doc_id or words
    are in no group and all stay.
    """
    return _columns(neardup.without_near_duplicates(_columns(docs), words=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows with one doc_id are one document: all stay or all go. Rows without
    a doc_id or text stay."""
    return _columns(decon.decontaminated(_columns(docs), table(spark, sf_dir, "benchmark")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, repeated to the target weights of their sources and shuffled. Null sources share a weight; null
    texts count as empty; rows with one doc_id (all null ones too) are repeated equally often."""
    return _columns(mix.poisson_mix(_columns(docs), mix.WEIGHTS))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents: doc_id, start, n_tokens, ids_crc32. Null text is empty; every row is written.

    The files keep the order that the mix has dealt all copies in, so that those of a document do not stand next to
    each other; nothing is shuffled again.
    """
    return blocks.read_token_files(blocks.write_token_files(docs, as_they_come=True))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_files", token_files),
]

#: Viterbi labels and token ids are not SQL's; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
