"""Corpus preparation: language ID, near-duplicate removal, benchmark decontamination, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared checkpoint
folder and read again as the next stage's documents.  All stages but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tambo.llm.common import read_table
from tambo.llm.decontaminate import decontaminate
from tambo.llm.langid import drop_unidentified
from tambo.llm.packing import pack
from tambo.llm.simhash import drop_near_duplicates
from tambo.session import scratch_path


#: A text whose best language is less likely than this is no text of any one language: mixed, or too short to tell.
MIN_LANGUAGE_SCORE = 0.6


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has an identified language with a score of at least ``MIN_LANGUAGE_SCORE``.

    Null, empty and letterless texts go.  Every row is judged by its own text, so repeated rows stay or go together; ties
    of languages go to the first by name.  Any length of text; an empty table stays empty; further columns are carried
    along under any names.
    """
    return drop_unidentified(docs, min_score=MIN_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest id, null ids last.

    Texts without words (null and empty ones too) share a fingerprint and so are one group.  Rows that agree in id and
    text are one document.  Any length of text; an empty table stays empty; further columns are carried along under
    any names.
    """
    return drop_near_duplicates(docs, k=3, max_bits=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark table.

    Null and empty texts are never contaminated, nor is anything by null or wordless items; all rows of one id and text
    go together; a null id is an id of its own.  Whole texts are read, however long; an empty table stays empty; further columns are
    carried along under any names.
    """
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"), mode="drop_documents")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 2048 tokens.

    A null or empty text is the end id alone; repeated rows each get their pieces; pieces of equal length are
    interchangeable.  Longer texts are cut into pieces, never shortened; an empty table gives no rows; only the id and
    the text are read.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048).withColumnRenamed("doc", "doc_id")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("best_fit_packing", best_fit_packing)]

#: SQL cannot express the language model, the fingerprints' hash or the packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
