"""A training corpus from raw documents, in five stages.

Each stage works on all that its predecessor kept, and the next one reads what
it wrote. Training data of the classifiers comes from the documents of the stage
itself and the labels table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkstone.llm import decontaminate, jaccard_join, language_id, mixing, quality_cnn
from inkstone.llm.scratch import Scratch

LANGUAGES = ("de", "en", "es", "fr")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_cnn.keep_good(docs, model)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages."""
    return language_id.keep_languages(docs, language_id.train(docs), LANGUAGES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights select, and how often."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: Two stages are learned models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline", "snappy")
    for _, stage in STAGES[:-1]:
        after = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
