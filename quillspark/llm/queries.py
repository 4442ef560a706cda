"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .exact_dedup import exact_dedup
from .language_id import language_id
from .license_scan import license_scan
from .minhash_dedup import minhash_dedup
from .packing import pack
from .quality_rules import quality_rules
from .site_quality import site_quality
from .source_mix import mix_sources
from .substring_dedup import substring_dedup
from .token_shards import token_shards


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_docs(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_docs(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_docs(spark, sf_dir))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(_docs(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_docs(spark, sf_dir))


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(_docs(spark, sf_dir), tokenizer_path())


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir), tokenizer_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_docs(spark, sf_dir)).drop("cleaned")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_license_scan, op2_substring_dedup, op3_language_id, op4_minhash_dedup, op5_exact_dedup, op6_site_quality, op7_token_shards, op8_packing, op9_quality_rules, op10_source_mix)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """Fitted models, sampling, training order and packing have none."""
    return {"op1_license_scan": oracles.license_scan(), "op2_substring_dedup": oracles.substring_dedup(), "op4_minhash_dedup": oracles.minhash_dedup(), "op5_exact_dedup": oracles.exact_dedup(), "op9_quality_rules": oracles.quality_rules()}
