"""Exact deduplication against immutable snapshots.

A snapshot is a written table of distinct digests in buckets, with one static binary-fuse filter per bucket, made once.
An incoming batch is grouped by itself first. Its distinct digests are then screened by the filters: a negative is surely
new; a positive is looked up in the exact buckets, where all 32 bytes of SHA-256 over the whole normalised text are
compared. Texts are never shuffled, only digests. A whole table runs as batches: the first becomes the snapshot.

Null texts count as empty, and all empty texts are equal. Repeated rows count as rows of their group and share its
verdict: keep_id is the doc_id that stays, so rows with that very doc_id are all marked kept, unless the rows are told
apart by a column of numbers (row_col): then the first of them alone is. A null doc_id loses to any
other at the same length. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, join_counted, kept_only, made_since, mix, numbered, staged

#: Keys that a filter holds at most, about; filters of more than FILTER_BYTES in all aren't broadcast.
BUCKET_KEYS, MIN_BUCKETS, FILTER_BYTES = 262_144, 1024, 64 << 20


# --- binary-fuse filter ------------------------------------------------------------------------------------------


def _slots(keys: np.ndarray, seed: np.ndarray | int, segment: np.ndarray | int, n_segments: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots of each key, in three segments that follow one another, and its fingerprint."""
    with np.errstate(over="ignore"):
        h = mix(keys ^ mix(np.asarray(seed, np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    segment, n_segments = np.asarray(segment, np.int64), np.asarray(n_segments, np.int64)
    first = ((h >> np.uint64(40)).astype(np.int64) * n_segments) >> 24
    inside = [((h >> np.uint64(s)) & np.uint64(0xFFFFF)).astype(np.int64) % segment for s in (0, 10, 20)]
    return np.stack([(first + j) * segment + inside[j] for j in range(3)]), (mix(h) & np.uint64(0xFF)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, first segments, fingerprints) of distinct 64-bit keys: about 9 bits a key, 1 in 256 false."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(2, len(keys))
    segment = min(1 << 18, 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    for seed in range(200):
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)) * (1 + 0.02 * seed)
        n_segments = max(1, math.ceil(n * factor / segment) - 2)
        slots, fingers = _slots(keys, seed, segment, n_segments)
        size = (n_segments + 2) * segment
        count, ids = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for row in slots:
            np.add.at(count, row, 1)
            np.bitwise_xor.at(ids, row, np.arange(len(keys)))
        rounds, left = [], len(keys)
        while left:  # all slots with one key give it up at once
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            key, at = np.unique(ids[single], return_index=True)
            rounds.append((key, single[at]))
            for row in slots[:, key]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(ids, row, key)
            left -= len(key)
        if left:
            continue
        table = np.zeros(size, np.uint8)
        for key, slot in reversed(rounds):
            table[slot] = 0
            table[slot] = fingers[key] ^ table[slots[0, key]] ^ table[slots[1, key]] ^ table[slots[2, key]]
        return seed, segment, n_segments, table.tobytes()
    raise ValueError("no filter found for these keys")


class Filters:
    """Filters of many buckets, looked up at once."""

    def __init__(self, rows: list[tuple[int, int, int, int, bytes]]):
        n = max((r[0] for r in rows), default=-1) + 1
        self.seed, self.segment, self.n_segments, self.offset = (np.full(n, x, np.int64) for x in (0, 1, 0, -1))
        at, parts = 0, []
        for bucket, seed, segment, n_segments, table in rows:
            self.seed[bucket], self.segment[bucket], self.n_segments[bucket], self.offset[bucket] = seed, segment, n_segments, at
            parts.append(table)
            at += len(table)
        self.table = np.frombuffer(b"".join(parts) or b"\0", np.uint8)

    def hits(self, bucket: np.ndarray, keys: np.ndarray) -> np.ndarray:
        bucket = np.asarray(bucket, np.int64)
        known = bucket < len(self.offset)
        known[known] &= self.offset[bucket[known]] >= 0
        out, b = np.zeros(len(keys), bool), bucket[known]
        slots, fingers = _slots(keys[known].astype(np.uint64), self.seed[b].astype(np.uint64), self.segment[b], self.n_segments[b])
        got = [self.table[row + self.offset[b]] for row in slots]
        out[known] = (got[0] ^ got[1] ^ got[2]) == fingers
        return out


# --- snapshots ---------------------------------------------------------------------------------------------------


@dataclass
class Snapshot:
    """Distinct digests with the best row and the count of each, and the filters over them."""

    groups: DataFrame
    filters: DataFrame
    n_buckets: int
    filter_bytes: int


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, the text's length in code points, the digest of its normalised form; row, if the rows have a number."""
    plain = F.coalesce(F.col(text_col), F.lit(""))
    for c in SPACES:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"), F.unhex(F.sha2(plain, 256)).alias("digest"), *([F.col(row_col).alias("row")] if row_col else []))


def _grouped(rows: DataFrame) -> DataFrame:
    """One row per digest; a task sums up what it reads, so a hot digest is a row per task."""
    row = [(-F.col("row")).alias("neg_row")] if "row" in rows.columns else []
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg"), *row)).alias("best")
    return rows.groupBy("digest").agg(best, F.count("*").alias("n"))


def _keyed(groups: DataFrame, n_buckets: int) -> DataFrame:
    return groups.withColumn("key", F.xxhash64("digest")).withColumn("bucket", F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(n_buckets)).cast("int"))


def freeze(groups: DataFrame) -> Snapshot:
    """An immutable snapshot of grouped digests, written to the shared folder with its filters."""
    groups = staged(groups, "snapshot")
    n_buckets = max(MIN_BUCKETS, -(-groups.count() // BUCKET_KEYS))

    def build(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(df["bucket"].iloc[0]), *fuse_build(df["key"].to_numpy().view(np.uint64)))], columns=["bucket", "seed", "segment", "n_segments", "table"])

    filters = staged(_keyed(groups, n_buckets).select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket int, seed int, segment int, n_segments int, table binary"), "filters")
    return Snapshot(groups, filters, n_buckets, filters.agg(F.sum(F.length("table"))).first()[0] or 0)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """groups with hit: false if the digest is surely not in the snapshot."""
    keyed = _keyed(groups, snapshot.n_buckets)
    schema = keyed.withColumn("hit", F.lit(True)).schema
    if snapshot.filter_bytes <= FILTER_BYTES:
        held = groups.sparkSession.sparkContext.broadcast([tuple(r) for r in snapshot.filters.collect()])

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            filters = Filters([(b, s, g, n, bytes(t)) for b, s, g, n, t in held.value])
            for df in batches:
                df["hit"] = filters.hits(df["bucket"].to_numpy(), df["key"].to_numpy().view(np.uint64))
                yield df

        out = keyed.mapInPandas(probe, schema)
    else:

        def meet(df: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
            filters = Filters([(int(b), int(s), int(g), int(n), bytes(t)) for b, s, g, n, t in kept.itertuples(index=False)])
            df["hit"] = filters.hits(df["bucket"].to_numpy(), df["key"].to_numpy().view(np.uint64))
            return df

        out = keyed.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInPandas(meet, schema)
    return out.drop("key", "bucket")


def absorb(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The groups of snapshot and batch together; only what the filters let through meets the exact buckets."""
    screened = staged(screen(_grouped(batch), snapshot), "screened")
    new, maybe = screened.filter(~F.col("hit")).drop("hit"), screened.filter("hit").drop("hit")
    old = snapshot.groups
    both = old.join(maybe.select("digest", F.col("best").alias("b2"), F.col("n").alias("n2")), "digest", "left")
    both = both.select("digest", F.greatest("best", F.coalesce("b2", "best")).alias("best"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"))
    return both.unionByName(new).unionByName(maybe.join(old, "digest", "left_anti"))


def exact_dedup(docs: DataFrame, n_batches: int = 2, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Batches are dealt by a hash of doc_id.

    row_col: distinct numbers of the rows; kept then holds for one row of a group, and row is a column more.
    """
    rows = staged(digests(docs, id_col, text_col, row_col).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int")), "digests")
    groups = _grouped(rows.filter("batch = 0"))
    for k in range(1, n_batches):
        groups = absorb(rows.filter(F.col("batch") == k), freeze(groups))
    first = [(-F.col("best.neg_row")).alias("keep_row")] if row_col else []
    many = staged(groups.filter("n > 1").select("digest", (-F.col("best.neg")).alias("keep"), *first, "n", F.col("n").alias("group_size")), "groups")
    out = join_counted(rows.drop("batch"), many, ["digest"], "n", rows.count(), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    kept = F.col("row") == F.coalesce("keep_row", "row") if row_col else F.col("doc_id").eqNullSafe(keep)
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *(["row"] if row_col else []))


def without_copies(docs: DataFrame, **options: object) -> DataFrame:
    """One row of each group, columns as they came; repeated and null doc_ids are rows like any other."""
    rows, no = numbered(docs)
    mark = len(made_since(0))
    gone = kept_only(exact_dedup(rows, row_col=no, **options).filter(~F.col("kept")).select(F.col("row").alias(no)), "gone", mark)
    return rows.join(gone, no, "left_anti").select(docs.columns)
