"""From raw documents to a training mix: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All stages but the last return the columns
of the documents; the last adds what mixing decides. Rows with null ids or texts pass where a stage has nothing against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from risklattice.llm import copies, decontaminate, lines, mixing, toxicity
from risklattice.session import scratch_path


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, does not reject."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that at least three of them share, but for the one that keeps them. No document goes."""
    return lines.dedup_lines(docs).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are no near copy of one that stays: five-word shingles, Jaccard similarity of 0.8 or more."""
    return copies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken words; taken / size is the number of copies."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [("toxicity", keep_clean), ("line dedup", cut_lines), ("near copies", one_of_each), ("decontamination", decontaminated), ("mixing", mixed)]
ORACLE_SQL = None  # the toxicity model cannot be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; each result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
