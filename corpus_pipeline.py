"""A corpus from raw documents: filters, one copy of each group, no benchmark passages, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontamination, language, near_duplicates, packing, toxicity
from barloom.llm.common import fold, prepared, shared_path

#: SQL has no counterpart of the learned filters: tests compare with brute-force versions.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the subsequence-kernel machine scores 0.3 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, fold(F.col("doc_id"), 4) != 2)
    return toxicity.kept(docs, model)


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose best language has a probability under 0.5."""
    return language.kept(docs, language.fit(docs, fold(F.col("doc_id"), 3) != 1))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of copies and near copies."""
    return near_duplicates.first_of_groups(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark passage."""
    return decontamination.kept(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.packed(docs)


def _prepared(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(prepared(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _prepared(without_toxic)),
    ("language", _prepared(in_known_language)),
    ("near_duplicates", _prepared(one_of_each_group)),
    ("decontamination", _prepared(without_benchmark)),
    ("packing", _prepared(packed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
