"""A corpus pipeline: quality rules, near-duplicate removal, secret scans, mixing and packing, each over all its input.

Defined results: a null or empty text fails the quality rules; a row without an id that passes them stays and links with nothing;
of repeated rows one stays; a null source is a source of its own; all other columns go through to the last stage, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm import common, op1_mixing, op4_packing, op5_secrets, op8_quality, op10_partenum

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees fitted on the labels."""
    trees = op8_quality.fit_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select(F.struct("*").alias("row"), op8_quality.judged(F.col("text"), trees).alias("q")).where("q.kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of n-gram Jaccard links."""
    return op10_partenum.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return op5_secrets.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says."""
    return op1_mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows that keep the sources' shares."""
    return op4_packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing to target weights", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
