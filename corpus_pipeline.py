"""A corpus pipeline from five operators: quality rules, line dedup, near-dedup, mixing, packing.

Every stage reads what the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmask.llm import line_templates, mixing, near_copies, packing, quality
from quillmask.llm.common import shared_dir, written
from quillmask.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every document stays."""
    return line_templates.without_templates(docs).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) stays."""
    return near_copies.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.packed(docs, tokenizer_path())


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Fingerprints, line templates and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), base, name)
    return STAGES[-1][1](spark, docs, sf_dir)
