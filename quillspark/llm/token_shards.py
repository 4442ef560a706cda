"""Training-order materialisation of token sequences in fixed-stride binary shards.

Rows are put in order of doc_id and text by a range exchange, and each document's ids, closed by end_id, are cut into
sequences of one length. The written table numbers them by range and place, so the numbers are dense and the same however the
input is split. A keyed Feistel permutation over a rectangle just larger than the count, walked in cycles until it falls below
the count, gives each number its global slot in training order, with no state but the key. Shards are ranges of slots, and
tasks write ranges of shards: one file a shard, records of a fixed stride, slot s at byte (s mod per_shard) * stride of shard
s div per_shard, so a reader resumes anywhere by arithmetic. Shards are written in waves, each a job and a range of its own,
so only a wave's share of the ids is in shuffle files at a time. Files go through Spark's own committer to any store, and
a manifest beside them states all that a reader needs.

Ids lie unpadded in the written table and are padded as shards are written. An id that width bytes can't hold is an error.
Null texts are empty: a sequence of end_id and padding. Null doc_ids come first. Repeated rows give their own sequences. An
empty table writes a manifest and no shard. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import product_path, shuffles_dropped, small_batches, staged, tasks_for
from .tokens import encoder

ROUNDS = 4
#: Steps that a walk takes at most. The rectangle has fewer cells beyond the count than one of its sides, so below 4,096
#: numbers no walk is longer; above, a step misses with odds of 1 in 64 at most.
WALK = 66
#: One byte after each record, as Spark's text writer ends lines.
END = "\n"
#: Sequences of a shard: the least, and the most, which 2^28 sequences and more have.
LEAST_SHARD, MOST_SHARD = 1 << 12, 1 << 18
SEQUENCES = "task int, place long, doc_id long, part long, n_tokens long, ids binary"


def _feistel(number: Column, a: int, b: int, key: int) -> Column:
    """A keyed permutation of range(a * b): the halves, high below a and low below b, move each other in turn."""
    high, low = F.floor(number / F.lit(b)).cast("long"), F.pmod(number, F.lit(b))
    for r in range(ROUNDS):
        high = F.pmod(high + F.pmod(F.xxhash64(low, F.lit(key), F.lit(r)), F.lit(a)), F.lit(a))
        low = F.pmod(low + F.pmod(F.xxhash64(high, F.lit(key), F.lit(-1 - r)), F.lit(b)), F.lit(b))
    return high * F.lit(b) + low


def feistel_slots(number: Column, count: int, key: int) -> Column:
    """A keyed permutation of range(count): Feistel rounds, walked on until the result is in range."""
    a = max(1, math.isqrt(max(count, 1) - 1) + 1)
    b = max(1, -(-count // a))
    a, b = int(a), int(b)
    first = _feistel(number.cast("long"), a, b, key)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda at, _: F.when(at < count, at).otherwise(_feistel(at, a, b, key)))
    return F.when(first < count, first).otherwise(walked)


def sequences(docs: DataFrame, tokenizer: str, length: int, width: int, end_id: int, n_tasks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents' ids, in order of doc_id and text, cut into sequences; with the range that made each and its place there."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    kind, most = np.dtype(f"<u{width}"), 1 << (8 * width)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, ends = encoder(tokenizer).encode(batch.column(1), end_id)
            if int(flat.max()) >= most:
                raise ValueError(f"id {int(flat.max())} doesn't fit {width} bytes")
            counts = np.diff(ends, prepend=0)
            parts = -(-counts // length)
            doc = np.repeat(np.arange(len(ends)), parts)
            part = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = (ends - counts)[doc] + part * length
            n = np.minimum(length, ends[doc] - begin)
            # sequences follow one another without a gap, so they are slices of one buffer
            offsets = (np.append(begin, ends[-1]) * width).astype(np.int64)
            ids = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype(kind))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), task, np.int32)), pa.array(place + np.arange(len(doc))), batch.column(0).take(pa.array(doc)), pa.array(part), pa.array(n), ids], names)
            place += len(doc)

    names = [x.split()[0] for x in SEQUENCES.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # rows alike in all else change places freely: the last key only lets a range end among them
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("tie", F.monotonically_increasing_id())
    n_tasks = n_tasks or tasks_for(rows)
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc(), F.col("tie").asc()]
    rows = rows.repartitionByRange(n_tasks, *order).sortWithinPartitions(*order[:2], "t")
    return rows.select("doc_id", "t").mapInArrow(cut, SEQUENCES)


def token_shards(docs: DataFrame, tokenizer: str, path: str | None = None, length: int = 256, width: int = 2, end_id: int = 1, pad_id: int = 0, key: int = 20_240_229, per_shard: int | None = None, waves: int = 2, n_tasks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards under path and returns a row per sequence: where it lies, and a check sum of its record.

    width: bytes an id, little-endian; 2 suffices below 65,536 ids. Shards are path/shard=N/part-*, the manifest is
    path/_manifest. per_shard depends on the number of sequences unless given. Without path, a new folder that stays.
    """
    spark = docs.sparkSession
    path = path or product_path(spark, "shards")
    pad = F.unhex(F.lit(int(pad_id).to_bytes(width, "little").hex()))
    record = F.rpad(F.col("ids"), length * width, pad)
    made = sequences(docs, tokenizer, length, width, end_id, n_tasks, id_col, text_col)
    made = staged(made.withColumn("ids_crc32", F.crc32(record)), "sequences")
    # one number a task: its size is that of the job's plan, not of the data
    counts = sorted((r["task"], r["n"]) for r in made.groupBy("task").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for task, n in counts:
        before.append((task, total))
        total += n
    # about 1,024 shards where that is neither too small nor too large a file
    per_shard = per_shard or min(MOST_SHARD, max(LEAST_SHARD, 1 << (total >> 10).bit_length()))
    n_shards, stride = -(-total // per_shard), length * width + len(END)
    slot = feistel_slots(F.col("before") + F.col("place"), max(1, total), key)
    slotted = made.join(F.broadcast(spark.createDataFrame(before, "task int, before long")), "task").withColumn("slot", slot)
    slotted = slotted.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    n_writers = tasks_for(made)
    for wave in range(waves):
        low, high = n_shards * wave // waves, n_shards * (wave + 1) // waves
        if low == high:
            continue
        tasks = min(high - low, n_writers)
        own = slotted.filter((F.col("shard") >= low) & (F.col("shard") < high)).select("shard", "slot", "ids")
        dealt = own.repartitionById(tasks, F.floor((F.col("shard") - low) * tasks / (high - low)).cast("int")).sortWithinPartitions("shard", "slot")
        with shuffles_dropped(spark):
            dealt.select("shard", record.cast("string").alias("value")).write.partitionBy("shard").mode("append").option("lineSep", END).text(path)
    manifest = [(total, n_shards, per_shard, length, width, stride, end_id, pad_id, key, tokenizer.rsplit("/", 1)[-1])]
    schema = "n_sequences long, n_shards long, per_shard long, length long, width long, stride long, end_id long, pad_id long, key long, tokenizer string"
    spark.createDataFrame(manifest, schema).coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    return slotted.select("doc_id", "part", "n_tokens", "slot", "shard", ((F.col("slot") % per_shard) * stride).alias("byte_offset"), F.lit(stride).alias("stride"), "ids_crc32", F.lit(path).alias("path"))


def read_manifest(spark: SparkSession, path: str) -> dict[str, int | str]:
    return spark.read.json(f"{path}/_manifest").first().asDict()


def read_shard(spark: SparkSession, path: str, shard: int) -> np.ndarray:
    """One shard's sequences in order, as a reader resumes them."""
    made = read_manifest(spark, path)
    data = bytes(spark.read.format("binaryFile").load(f"{path}/shard={shard}").select("content").first()[0])
    grid = np.frombuffer(data, np.uint8).reshape(-1, made["stride"])
    return grid[:, : made["length"] * made["width"]].copy().view(f"<u{made['width']}")
