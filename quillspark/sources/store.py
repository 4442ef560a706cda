"""A chunk store on Parquet: append, point lookup, update, delete, counts, re-index; scoped reads; file and report readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ChunkStore:
    """Rows chunk_id, paper_id, content, source, metadata and embedding under one path. Rewrites go to a new version folder, and a
    one-row pointer says which counts, so readers never see half a rewrite."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _version(self) -> int:
        try:
            return self.spark.read.schema("v long").json(f"{self.path}/pointer").agg(F.max("v")).first()[0] or 0
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0

    @property
    def table(self) -> str:
        return f"{self.path}/v{self._version()}"

    def read(self, job: str | None = None) -> DataFrame:
        """All rows, or those of one job: a scoped reader sees no others."""
        df = self.spark.read.parquet(self.table)
        return df if job is None else df.filter(F.col("analysis_job_id") == job)

    def add(self, rows: DataFrame, key: Column | None = None) -> None:
        """Appends; ids are made from the key where they are missing."""
        made = F.substring(F.md5(F.concat_ws("/", *[F.col(c).cast("string") for c in ("paper_id", "content")]) if key is None else key), 1, 16)
        rows.withColumn("chunk_id", F.coalesce("chunk_id", made) if "chunk_id" in rows.columns else made).write.mode("append").parquet(self.table)

    def _rewrite(self, rows: DataFrame) -> None:
        new = self._version() + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{new}")
        self.spark.range(1).select(F.lit(new).alias("v")).write.mode("append").json(f"{self.path}/pointer")

    def get(self, chunk_id: str) -> DataFrame:
        return self.read().filter(F.col("chunk_id") == chunk_id)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        return self.read().orderBy("chunk_id").offset(offset).limit(limit)

    def update(self, changes: DataFrame) -> None:
        """changes: chunk_id and the columns to replace where they aren't null."""
        cols = [c for c in changes.columns if c != "chunk_id"]
        new = changes.select("chunk_id", *[F.col(c).alias(f"__{c}") for c in cols])
        df = self.read().join(new, "chunk_id", "left")
        self._rewrite(df.select(*[F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in self.read().columns]))

    def delete(self, where: Column) -> int:
        """Deletes the rows of a condition; says how many."""
        gone = self.read().filter(where).count()
        if gone:
            self._rewrite(self.read().filter(~F.coalesce(where, F.lit(False))))
        return gone

    def count(self, by: str | None = None) -> DataFrame:
        return self.read().groupBy(by).count() if by else self.read().agg(F.count("*").alias("count"))

    def reindex(self, embed: Callable[[Column], Column], target: str, dry_run: bool = False) -> int:
        """Re-embeds all rows into another store, ids unchanged; raises if the counts differ."""
        rows, n = self.read().withColumn("embedding", embed(F.col("content"))), self.read().count()
        if not dry_run:
            to = ChunkStore(self.spark, target)
            to._rewrite(rows)
            if to.read().count() != n:
                raise RuntimeError("the new collection has another number of rows")
        return n


def needs_ocr(chars: Column, pages: Column, enabled: bool = True, least: int = 50) -> Column:
    return F.lit(enabled) & (chars / F.greatest(pages, F.lit(1)) < least)


def files(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = True, most_mb: int = 50) -> DataFrame:
    """path, length, content of files, with error where extension, magic bytes or size are wrong."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    error = F.when(~F.lower("path").endswith(".pdf"), "extension").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "magic").when(F.col("length") > most_mb << 20, "size")
    return df.select("path", "length", "content", error.alias("error"))


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """doc_id and text of whole text files: the supported source where no PDF parser is at hand."""
    df = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    return df.select(F.substring(F.md5(F.input_file_name()), 1, 16).alias("doc_id"), F.col("value").alias("text"), F.input_file_name().alias("path"))


def safe_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(name, "^.*[/\\\\]", ""), "[^\\w.\\- ]+", "_"), 1, 100)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Experiment reports, a row each, without backups, replicas and seeds."""
    df = spark.read.option("multiLine", "true").option("pathGlobFilter", "experiment_*.json").json(path).withColumn("file", F.input_file_name())
    return df.filter(~F.col("file").rlike("backup|seed|\\.run\\d+"))


def report_indicators(df: DataFrame) -> DataFrame:
    """One row per indicator of each topic of each report."""
    t = df.select("file", F.explode("phase3_gap_detection.topics").alias("t"))
    return t.select("file", F.col("t.topic_key").alias("topic_key"), F.explode("t.indicators").alias("i")).select("file", "topic_key", "i.*")


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a small result."""
    rows = df.limit(most).collect()
    line = lambda xs: "| " + " | ".join(xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(["" if v is None else str(v) for v in r]) for r in rows]])
