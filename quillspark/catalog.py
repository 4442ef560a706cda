"""The registered queries of the library, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.chunking import chunk_fixed
from .operators import retrieval
from .plans import corpus, evaluation, extraction, knowledge, logs, reports, search
from .providers import hashed_embedding

MODULES = (corpus, search, extraction, knowledge, evaluation, logs, reports)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks to vectors, exact search for the first chunk's like, heuristic reranking."""
    chunks = chunk_fixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("embedding", hashed_embedding(F.col("content")))
    query = "the and of with that"
    vector = spark.range(1).select(hashed_embedding(F.lit(query)).alias("v")).first()["v"]
    hits = retrieval.search(chunks, vector, 20, id_col="chunk_id").join(chunks.select(F.col("chunk_id").alias("id"), "content"), "id")
    return retrieval.heuristic_rerank(hits, query).select("id", "rank", "old_rank", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"), "content")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q[0] for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for m in MODULES for name, q in m.QUERIES.items() if q[1]}
