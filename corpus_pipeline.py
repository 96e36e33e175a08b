"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Documents that the toxicity classifier rejects go; of each group of near duplicates the one with the smallest
id stays; documents with benchmark passages go; sources are mixed to their target weights; what is left becomes token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import decontaminate, mixing, near_dup, tokens, toxicity
from lumenframe.llm.common import delete, shared_path


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier, trained on the labelled ones, scores one half or more; null and empty texts stay."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those in the class of a smaller doc_id; rows that repeat an id go or stay together, and those without words or id stay."""
    return near_dup.drop_near_duplicates(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold ten consecutive words of a benchmark item, or a whole shorter item; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs' rows, each as often as its source's rate and its id say; the null source is one of its own.  docs' columns, any called "copy" too, stay."""
    copy = "copy"
    while copy in docs.columns:
        copy += "_"
    return mixing.replicate(docs, copy_col=copy).drop(copy)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row, read back from the written ids; null texts have the end id alone."""
    return tokens.token_digests(spark, docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: No SQL has the classifier or the tokenizer; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; a stage's table goes when the next one's is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return docs
