"""From raw documents to token ids: the stages of the training-text pipeline, in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's result to the shared folder and reads it back for the next one.
SQL can't express the stages, so there is no ORACLE_SQL; tests hold each against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontam, langid, mixing, pfor, simhash
from lamina.llm.common import TEXT_ROWS, arrow_rows, free_name, staged
from lamina.llm.queries import table, tokenizer_path

ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID learns from the labelled rows of docs. Documents go that have no letter or whose n-grams are less
    likely in each learned language than by chance; without a labelled row only those without a letter."""
    return langid.known(docs, langid.fit(docs))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest doc_id stays."""
    return simhash.without_copies(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    leak_id = free_name(docs, "leak_id")
    found = decontam.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(leak_id)).distinct()
    with arrow_rows(spark, TEXT_ROWS):
        found = staged(found, "leaks")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(leak_id)), "left_anti")


def mixed_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in PFOR blocks; a row for each document, read back from the files."""
    return pfor.token_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", distinct_documents),
    ("benchmark decontamination", clean_of_benchmarks),
    ("mixing", mixed_by_source),
    ("token ids", token_blocks),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return last(spark, docs, sf_dir)
