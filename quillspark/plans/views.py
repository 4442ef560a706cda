"""The driver's tables seen as papers, entities, facts, claims and jobs, in Spark and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    flag = F.concat("l_returnflag", "l_linestatus")
    predicate = F.when(flag == "AF", "CONTRADICTS").when(flag == "NF", "REQUIRES_RESOURCE").when(flag == "NO", "IMPROVES").when(flag == "RF", "EXTENDS").otherwise("APPLIES_TO")
    num = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("long")
    key = F.concat_ws("-", F.lit("f"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return li.select(key.alias("fact_id"), F.concat(F.lit("s"), "l_suppkey").alias("subject_id"), predicate.alias("predicate"), F.concat(F.lit("p"), "l_partkey").alias("object_id"), F.concat(F.lit("o"), "l_orderkey").alias("source_paper"), (1 - F.col("l_discount")).alias("confidence"), (F.col("l_tax") > 0.06).alias("is_inferred"), num.alias("seq"))


FACTS = """facts AS (SELECT 'f-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS fact_id, 's' || l_suppkey AS subject_id,
 CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'CONTRADICTS' WHEN 'NF' THEN 'REQUIRES_RESOURCE' WHEN 'NO' THEN 'IMPROVES' WHEN 'RF' THEN 'EXTENDS' ELSE 'APPLIES_TO' END AS predicate,
 'p' || l_partkey AS object_id, 'o' || l_orderkey AS source_paper, 1 - l_discount AS confidence, l_tax > 0.06 AS is_inferred, CAST(l_orderkey * 100 + l_linenumber AS BIGINT) AS seq FROM lineitem)"""


def entities(spark: SparkSession, d: str) -> DataFrame:
    s, p, n = (table(spark, d, t) for t in ("supplier", "part", "nation"))
    one = lambda df, pre, key, kind, name, off: df.select(F.concat(F.lit(pre), key).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(name).alias("name"), (F.col(key).cast("long") + off).alias("seq"))
    return one(s, "s", "s_suppkey", "METHOD", "s_name", 0).union(one(p, "p", "p_partkey", "FINDING", "p_name", 10_000_000)).union(one(n, "n", "n_nationkey", "DOMAIN", "n_name", 90_000_000)).withColumn("source_paper", F.lit(None).cast("string"))


ENTITIES = """entities AS (SELECT 's' || s_suppkey AS entity_id, 'METHOD' AS entity_type, s_name AS name, CAST(s_suppkey AS BIGINT) AS seq FROM supplier
 UNION ALL SELECT 'p' || p_partkey, 'FINDING', p_name, CAST(p_partkey + 10000000 AS BIGINT) FROM part UNION ALL SELECT 'n' || n_nationkey, 'DOMAIN', n_name, CAST(n_nationkey + 90000000 AS BIGINT) FROM nation)"""


def papers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("paper_id"), F.col("p_name").alias("title"), F.col("p_name").alias("content"), F.col("p_brand").alias("topic"), F.array(F.lower("p_type"), F.concat(F.lit("size"), (F.col("p_size") % 5).cast("string"))).alias("keywords"), (2000 + F.col("p_size") % 25).cast("int").alias("year"), F.col("p_partkey").alias("seq"))


PAPERS = """papers AS (SELECT 'p' || p_partkey AS paper_id, p_name AS title, p_name AS content, p_brand AS topic, [lower(p_type), 'size' || (p_size % 5)] AS keywords,
 CAST(2000 + p_size % 25 AS INTEGER) AS year, p_partkey AS seq FROM part)"""
