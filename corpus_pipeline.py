"""A training corpus from ``documents``: five stages, each over all rows that the one before it kept.

quality: documents that the compression classifier rejects go; near duplicates: one document of each
class stays; decontamination: documents that hold a benchmark item go; secrets: each is replaced in the
text; packing: the rest is tokenised and packed, a row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citespan.llm.common import cut, table
from citespan.llm.decontamination import decontaminate
from citespan.llm.jaccard_join import keep_one
from citespan.llm.packing import pack, tokenizer_path
from citespan.llm.quality import keep_good
from citespan.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path(), known=250_000)  # workers hold what earlier stages left them


STAGES = [
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces.  What a stage keeps is written to the checkpoint folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
