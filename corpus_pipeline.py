"""From raw documents to token files, in five stages.

Each stage takes (spark, documents so far, folder of the tables) and works on all that the stage before it
kept. Its result is a written table, which is the next stage's input: a lost executor costs a stage's
running tasks, never an earlier stage.

1. language_id: documents whose language is not recognised with confidence go.
2. near_duplicates: of each group of near copies (0.8 of the shingles of five words) the document with the smallest
   id stays.
3. decontaminate: documents go of which benchmark passages are a twentieth; from others the passages are cut.
4. source_mix: documents repeat, or go, so that sources have their target weights.
5. token_files: all documents are written as token files; a row tells where each lies in them.

Null and empty documents have no letter and go in the first stage; an empty input gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crmkiln.llm import decontaminate, language_id, mixing, ngram_join, token_files
from crmkiln.llm.common import DOCUMENT_COLUMNS, saved, table
from crmkiln.llm.queries import tokenizer_path

#: Words of a shingle, and similarity in hundredths, of the stage near_duplicates.
SHINGLE, THRESHOLD = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.first_documents(docs, DOCUMENT_COLUMNS, THRESHOLD, SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, DOCUMENT_COLUMNS)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_digests(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_files", write_token_files),
]

#: The language model and the hashed draws of the mix have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
