"""The queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmask.llm import line_templates, mixing, ogg, packing, quality, simhash, substring_dedup, suffix_index, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_column(_table(spark, sf_dir, "documents"))


def op4_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.template_report(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_retrieval_packing, op2_substring_dedup, op3_ogg_media, op4_suffix_index, op5_simhash, op6_toxicity, op7_mixing, op8_line_templates, op9_warc, op10_quality)}

ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": substring_dedup.SQL, "op4_suffix_index": suffix_index.SQL, "op7_mixing": mixing.SQL, "op8_line_templates": line_templates.SQL, "op9_warc": warc.SQL, "op10_quality": quality.SQL}
