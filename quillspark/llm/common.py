"""What the operators share: scratch tables in the cluster's shared folder, joins that survive hot keys, words."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than this share of all rows is joined by broadcast, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 2000
#: The six ASCII white-space characters \x09-\x0D and \x20.
SPACES = " \t\n\x0b\x0c\r"
#: A word by the contracts, as Java's regular expressions have it.
WORD = "[^\\x20\\x09-\\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def product_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for what a caller is to keep: it outlives the session."""
    return f"{shared_dir(spark)}/quill-products/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files behind: the written table takes their place."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs staged with a number of its own for each row, and that column's name, which docs doesn't have."""
    name = "row_no"
    while name in docs.columns:
        name += "_"
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def drop_tables(spark: SparkSession, paths: list[str], reader: DataFrame | None = None) -> None:
    """Deletes these scratch tables, but for those that reader still reads."""
    read = reader.inputFiles() if reader is not None and paths else []
    # files are named with a scheme or without
    read = [x.split(":", 1)[-1].lstrip("/") for x in read]
    for path in paths:
        own = path.split(":", 1)[-1].lstrip("/")
        if any(x.startswith(f"{own}/") for x in read):
            continue
        to = spark._jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)
        _made[:] = [x for x in _made if x[1] != path]


def kept_only(df: DataFrame, name: str, mark: int) -> DataFrame:
    """df staged, and the scratch tables made after the first mark ones dropped: they have served."""
    path = scratch_path(df.sparkSession, name)
    out = staged(df, name, path)
    drop_tables(df.sparkSession, [x for x in made_since(mark) if x != path])
    return out


def made_since(mark: int) -> list[str]:
    """Scratch tables made after the first mark ones; the number of all so far is len(made_since(0))."""
    return [path for _, path in _made[mark:]]


@atexit.register
def drop_scratch() -> None:
    """Deletes this session's scratch tables, if the session still runs."""
    while _made:
        spark, path = _made[-1]
        try:
            drop_tables(spark, [path])
        except Exception:  # noqa: BLE001  the JVM has gone; its folder is the cluster's to clean
            return


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches that stay small where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tasks_for(df: DataFrame, mb: int = 256, most: int = 20_000) -> int:
    """Tasks for a shuffle of df: four a core, and more where the plan's size gives one more than mb; most bounds what a range exchange samples."""
    least = 4 * df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # a plan of unknown size says 2^63 - 1, or products of that
    return least if size >= 1 << 60 else max(least, min(most, size // (mb << 20)))


def spread(df: DataFrame, n_groups: int, *by: str) -> DataFrame:
    """df dealt by its groups to a fixed number of tasks: few bytes can be much work, which adaptive merging doesn't see."""
    return df.repartition(max(1, min(n_groups, 4 * df.sparkSession.sparkContext.defaultParallelism)), *by)


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """left join right (inner or left), where right has one row per key and how many rows of left have it (count).

    Keys above HOT_SHARE of total go by broadcast: there are at most 1 / HOT_SHARE of them, whatever the data.
    All others go by shuffle, and none of those is large. count is dropped.
    """
    least = max(200, int(total * HOT_SHARE))
    hot = F.broadcast(right.filter(F.col(count) > least).drop(count))
    cold = right.filter(F.col(count) <= least).drop(count)
    return left.join(hot, on).unionByName(left.join(hot, on, "left_anti").join(cold, on, how))


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of an undirected graph of links a, b; a table all the way.

    Each round takes the smallest label around, then the label of the label, so long chains shorten fast.
    """
    edges = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    total = edges.count()
    labels = staged(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count("*").alias("n")).withColumnRenamed("a", "node"), "labels")
    while total:
        near = join_counted(edges, labels.select(F.col("node").alias("b"), "label", "n"), ["b"], "n", total).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("label"), "n", F.col("label").alias("was"))
        step = staged(step, "labels")
        heads = step.groupBy(F.col("label").alias("head")).agg(F.count("*").alias("m")).join(step.select(F.col("node").alias("head"), F.col("label").alias("top")), "head")
        new = join_counted(step.withColumnRenamed("label", "head"), heads, ["head"], "m", total)
        new = staged(new.select("node", F.col("top").alias("label"), "n", (F.col("top") != F.col("was")).alias("moved")), "labels")
        labels = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            break
    return labels.select("node", "label")


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of sorted record batches; only one key's rows are in memory."""
    key, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def key_of(c: str) -> Column:
    """A key that is never null: null and every string differ."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


class WordHashes(dict):
    """64-bit hash of a word (bytes); remembers the words seen, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts_of(column: pa.Array) -> list[bytes | None]:
    """A string column's values in UTF-8; bytes.split() then splits at ASCII white space only."""
    return column.cast(pa.large_binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def windows_hash(words: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of width words; the position in the run counts."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    rng = np.random.default_rng(seed * 1000 + width)
    out = np.zeros(n, np.uint64)
    for j, odd in enumerate(rng.integers(0, 2**63, width, np.uint64) * np.uint64(2) + np.uint64(1)):
        out += words[j : j + n] * odd
    return mix(out)
