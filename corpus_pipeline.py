"""From raw documents to token files: quality, near duplicates, benchmark leaks, mixture, token IDs.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage
before kept; all but the last return the columns of documents.

Edge cases, for all stages: null texts count as empty; texts are read whole, however long; an
empty table gives an empty result; columns beyond those of documents come through the
first four stages as they are, whatever their names.  Null or repeated doc_ids, repeated rows
and ties are told at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import clean_documents
from tessera.llm.mixing import sample
from tessera.llm.ngram_join import one_of_each
from tessera.llm.quality import kept_documents
from tessera.llm.shared import remove, scratch, written
from tessera.llm.token_blocks import token_digest


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep; empty texts fail.  Each row is judged by itself: repeated rows stay or go together."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 5-word shingles, similarity 0.8.

    The smallest doc_id stays; of rows with one doc_id and text one stays, of different texts of
    one doc_id that are alike the one with the smaller hash.  Rows without words or doc_id stay.
    """
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.  All rows of a doc_id and text share their fate; rows without doc_id are judged by their text too."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that meets the mixture's source, language and topic shares.  Nulls are categories; repeated rows are drawn together."""
    drawn, _ = sample(docs)
    return drawn.where("kept").select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and their digest: a row a document, repeated ones in order of their texts, null doc_ids first as 0."""
    return token_digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: The first stage is learned and the third aligns templates: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # a stage's own tables go when its result is written
            docs = keep(written(stage(spark, docs, sf_dir), name))
        if before is not None:
            remove(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
