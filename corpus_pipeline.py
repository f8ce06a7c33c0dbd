"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

quality rules, line dedup, MinHash near-dedup, mixing sources to target weights, BPE encoding and decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep."""
    from storygraph.llm import quality

    return quality.kept(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; n_chars follows."""
    from storygraph.llm import line_dedup

    return _counted(line_dedup.clean(docs).select(*docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest doc_id; every row that goes has one of its group that stays."""
    from storygraph.llm import near_dedup

    return near_dedup.kept(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each document and epoch that takes any of its words; n_chars follows."""
    from storygraph.llm import mixing

    return _counted(mixing.mixed(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, text, and the text's ids (packed), their number and what they decode to."""
    from storygraph.llm import bpe

    return bpe.encoded(docs.select("doc_id", "source", "text"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else docs


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("MinHash near-dedup", dedup_near), ("mixing sources", mix), ("BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storygraph.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


#: SQL cannot express the minimum-covariance-determinant estimates, the pseudorandom mix or BPE; tests hold them against brute force.
ORACLE_SQL = None
