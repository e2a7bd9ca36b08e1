"""The corpus pipeline: language, toxicity, near duplicates, mix, tokens.

Each stage works on all rows that the stage before it has kept. run() writes each stage's rows as
Parquet in a shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import bpe, language_id, mixing, near_dup, toxicity
from rankweave.llm.queries import vocabulary
from rankweave.llm.shared import delete, scratch, shared_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models accept; the models learn from the rows that state a lang."""
    return docs.where(language_id.accepts(language_id.train(docs), docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labelled ones among them."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return docs.where(~toxicity.is_toxic(toxicity.train(docs, labels), docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, on five-word shingles at a similarity of 0.8."""
    return near_dup.without_near_duplicates(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    return bpe.round_trip_digests(docs, vocabulary(), carry=("lang", "source", "n_chars"), with_ids=True)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mix), ("bpe", tokens)]
#: No stage's rows can be stated in SQL (models, sketches and draws); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written for itself goes once its rows are written, and
    its rows go once the next stage's are; the last stage's are read from those before it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
