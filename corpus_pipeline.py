"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Rows are told apart by numbers of their own, so repeated rows, repeated doc_ids and rows without doc_id are rows like any other in
the first four stages, and columns besides doc_id, text, lang and source go along as they are, whatever their names. An empty
table gives an empty result in every stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import drop_tables, made_since, scratch_path, staged
from quillspark.llm.exact_dedup import without_copies
from quillspark.llm.minhash_dedup import without_near_copies
from quillspark.llm.packing import pack
from quillspark.llm.queries import tokenizer_path
from quillspark.llm.site_quality import good_documents
from quillspark.llm.source_mix import mixed_documents


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables of the stage before.
_left: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """A stage's result is written before the next one reads it, so the next one deletes what the first left behind, unless it reads that."""

    @functools.wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _left, docs)
        mark = len(made_since(0))
        out = stage(spark, docs, sf_dir)
        # the last stage's tables are the caller's to read, whenever that is
        _left[:] = made_since(mark) if stage is not STAGES[-1][1].__wrapped__ else []
        return out

    return tidied


@_tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts have neutral counts and are judged like any other; a null source or language is a site of its own. Scores at
    the threshold are kept. Without labels nothing is rejected.
    """
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_tidy
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space.

    The one of the longest text stays, then of the smallest doc_id, null last, then any one of equal rows. Null counts as empty, and
    all empty texts are one group.
    """
    return without_copies(docs)


@_tidy
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more.

    The one of the smallest doc_id stays, null last, then any one of equal rows. Null and empty texts are like nothing and stay;
    a text of fewer words than a shingle is one shingle.
    """
    return without_near_copies(docs, percent=80, width=5)


@_tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, three times at most.

    A null source is one of its own, the last. Null and empty texts have no words and are taken as often as their source's
    share says. Of equal documents some may be taken and some not.
    """
    return mixed_documents(docs)


@_tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences; the last stage, so columns of its own.

    A null text is empty and has its closing id alone. Repeated rows are packed each for itself.
    """
    return pack(docs, tokenizer_path())


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("near_dedup", near), ("source_mix", mix), ("packing", packed)]

#: Fitted models, sampling and packing are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written as Parquet and read by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        docs = staged(stage(spark, docs, sf_dir), name, path)
        drop_tables(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
