"""Packing token pieces into windows by Karmarkar-Karp multiway differencing.

A document's ids, closed by end_id, are cut into full windows and a rest, the rest at half a window once more: smaller
pieces even out better, which leaves about a tenth of the padding. Full windows stand alone. Rests are dealt by a
hash into groups of about group_size; in a group, each rest starts as a partition of its own over all windows, and the two
partitions of the largest imbalance merge, the fullest windows of one onto the emptiest of the other, until one is left.
If a window exceeds the capacity, the number of windows rises and the group is differenced again.

Null texts are empty: a document of end_id alone. Repeated rows are packed each for itself. An empty table gives an empty
result. sequence_id is unique and in order of groups, not gapless.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread, staged
from .tokens import encoder

PIECES = "doc_id long, row long, start long, length long, doc_tokens long, ids_crc32 long"


def difference(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each item, load of each window) of k windows, by largest differencing."""
    n = len(lengths)
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)  # trees of items that share a window
    # a partial partition: what it has in its windows, the fullest first; windows without an item are left out
    heap = [(-int(x), i, np.array([x], np.int64), np.array([i])) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    made, order = n, n
    while len(heap) > 1:
        _, _, a, ra = heapq.heappop(heap)
        _, _, b, rb = heapq.heappop(heap)
        b, rb, alone = b[::-1], rb[::-1], k - len(b)
        shared = max(0, len(a) - alone)
        own = len(a) - shared
        loads = np.concatenate([a[:own], a[own:] + b[:shared], b[shared:]])
        roots = np.concatenate([ra[:own], ra[own:], rb[shared:]])
        if shared:
            new = np.arange(made, made + shared)
            left[new], right[new], roots[own : own + shared] = ra[own:], rb[:shared], new
            made += shared
        by = np.argsort(-loads, kind="stable")
        loads, roots = loads[by], roots[by]
        order += 1
        heapq.heappush(heap, (int((loads[-1] if len(loads) == k else 0) - loads[0]), order, loads, roots))
    _, _, loads, roots = heap[0]
    window = np.full(2 * n, -1)
    window[roots] = np.arange(len(roots))
    for x in range(made - 1, n - 1, -1):
        window[left[x]] = window[right[x]] = window[x]
    return window[:n], loads


def pack_group(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A window for each item, no window above capacity, as few as differencing fits them in."""
    total = int(lengths.sum())
    k = max(1, math.ceil(total / capacity))
    while True:
        window, loads = difference(lengths, k)
        if loads.max() <= capacity:
            return window
        # so many that a window as far above the mean as now would fit
        k = max(k + 1, math.ceil(total / max(1.0, capacity - (loads.max() - total / k))))


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids cut into full windows and a rest of one or two pieces; ids_crc32 over them as little-endian 32-bit numbers.

    row tells repeated rows apart. with_ids adds the ids themselves.
    """
    small_batches(docs.sparkSession, 500)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            flat, ends = encoder(tokenizer).encode(batch.column(1), end_id)
            data, out, begin = flat.astype("<u4").tobytes(), [], 0
            view = memoryview(data)
            for doc, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                row += 1
                rest = end - (end - begin) % capacity
                for at in [*range(begin, rest, capacity), *range(rest, end, half)]:
                    stop = min(end, at + (capacity if at < rest else half))
                    own = view[4 * at : 4 * stop]
                    out.append((doc, row, at - begin, stop - at, end - begin, zlib.crc32(own), *((bytes(own),) if with_ids else ())))
                begin = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names)

    half = max(1, capacity // 2)
    types = [pa.int64()] * 6 + [pa.binary()]
    names = [x.split()[0] for x in PIECES.split(",")] + ["ids"] * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def assign(cut: DataFrame, capacity: int, group_size: int = 512) -> DataFrame:
    """pieces with sequence_id and offset."""
    full = F.col("length") == capacity
    rests = cut.filter(~full)
    n_groups = max(1, -(-rests.count() // group_size))

    def deal(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "doc_id", "start", "row"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        window = pack_group(df["length"].to_numpy(), capacity)
        df = df.iloc[np.argsort(window, kind="stable")].reset_index(drop=True)
        window = np.sort(window)
        ends = df["length"].cumsum().to_numpy() - df["length"].to_numpy()
        first = np.searchsorted(window, window)
        df["offset"] = ends - ends[first]
        df["sequence_id"] = (df["g"].to_numpy().astype(np.int64) << 24) + window
        return df[fields]

    fields = [*cut.columns, "sequence_id", "offset"]
    schema = cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    packed = rests.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.lit(n_groups)).cast("int"))
    packed = spread(packed, n_groups, "g").groupBy("g").applyInPandas(deal, schema)
    # below zero, so that they meet no group's windows
    alone = cut.filter(full).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return alone.unionByName(packed)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, group_size: int = 512, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: also the ids."""
    cut = staged(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return assign(cut, capacity, group_size).drop("row")
