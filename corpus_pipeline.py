"""From documents to packed training sequences: language ID, near-dedup, suffix-array dedup,
benchmark decontamination, packing."""

from pyspark.sql import DataFrame, SparkSession

from weekloom.llm import decontaminate, language, packing, repeats, simhash
from weekloom.llm.common import documents, stage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; dictionaries are learned from the same documents."""
    return language.keep_identified(docs, language.learn(docs))


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def repeats_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without byte strings that stand elsewhere too; characters stay whole."""
    return repeats.keep_new(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, each at its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identified),
    ("SimHash near-dedup", near_deduplicated),
    ("suffix-array dedup", repeats_removed),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: compression, suffixes and tokenizers are beyond SQL
ORACLE_SQL = None
