"""Corpus pipeline: language ID, near duplicates, benchmark decontamination, source mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs; a table goes when the next is written. All but the last return the columns of documents, whatever their names and
further ones there are.

Defined results: an empty table stays empty through all stages; rows of one doc_id are rows of their own in each of them; null ids and null
columns are carried along. What becomes of null and empty texts, of ties and of very long texts is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociflow.llm import decontam, language, mixing, ngram_join, token_store
from lociflow.llm.common import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language stay; null texts and texts without a letter have none and go. Without a language to
    learn from every text with a letter stays."""
    return language.keep_identified(docs, language.fit(language.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the smallest doc_id, of different texts under it the one of the smallest
    digest, of equal rows one. Texts without words all stay."""
    return ngram_join.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage stay, texts without words among them; an empty benchmark takes none away."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, repeats as rows of their own; a null source is a source. Texts without words have size 0 and go."""
    return mixing.mix_sources(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's rows: doc_id, start, n_tokens, ids_crc32, in ascending doc_id order, null ids first; rows of one id lie side by side in the
    order of their text's hash."""
    path = Scratch(spark, "pipeline-tokens").path("store")
    token_store.write_tokens(docs, path)
    return token_store.checksums(spark, path)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing_sources", mixing_sources),
    ("token_ids", token_ids),
]
#: The classifier of the first stage is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(name, stage(spark, docs, sf_dir))
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
