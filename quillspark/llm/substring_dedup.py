"""Removal of passages that an earlier document has, by super-k-mer partitioning.

A window is a number of consecutive words of one document. Consecutive windows that share a minimiser, the least hash of the short runs of
words in them, form a super-k-mer. Equal windows have equal minimisers, so a minimiser is a bucket to compare within; that two
minimisers can have one hash only makes a bucket larger.

First only the names of super-k-mers travel: minimiser, SHA-256 of the words, place. Minimisers of a single document drop
out there. Equal super-k-mers, as copies have them, are summed up before they travel: all but those of the first document go altogether.
What is left to compare are first occurrences of different contents under one minimiser: those travel as packed strings to their
bucket, where their windows are sorted, and equal ones stand side by side, byte for byte. Buckets of more than HOT_BUCKET
strings are split by window instead, under its SHA-256, and summed up before they are shuffled. No decision rests on a shorter hash.

Null and empty texts have no words. Documents shorter than a window lose nothing. A document is never compared with rows
of its own doc_id; rows without doc_id lose nothing and take from none. Rows are told apart by doc_id and text, and
repeated rows are treated alike. Columns besides id and text are ignored, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, join_counted, runs, small_batches, spread, staged, texts_of, windows_hash

#: Words of the runs that minimisers are chosen from, and the strings of a bucket that one task sorts at most.
MINIMISER, HOT_BUCKET = 10, 2000
#: More hot buckets than this are joined by shuffle.
HOT_BROADCAST = 100_000


def super_kmers(words: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first word, windows) of each super-k-mer of a document's word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    short = windows_hash(words, m, seed=2)
    span = k - m + 1
    # sliding minimum: blocks of span, running minima from both sides
    full = -(-len(short) // span) * span
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(short)] = short
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.append(start, n))
    return least[start].view(np.int64), start, count


def named(docs: DataFrame, k: int, m: int) -> DataFrame:
    """Of each row: doc_id, text hash, number of words, SHA-256 of the words, and its super-k-mers as arrays."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sha256 = WordHashes(), hashlib.sha256
        for batch in batches:
            n_words, sha, parts, contents = [], [], [], []
            for t in texts_of(batch.column(2)):
                words = (t or b"").split()
                joined = b" ".join(words)
                n_words.append(len(words))
                sha.append(sha256(joined).hexdigest())
                mini, start, count = super_kmers(hashes.of(words), k, m)
                parts.append((mini, start, count))
                # where each word begins in the joined text, and one past its end
                begin = np.cumsum([0, *(len(w) + 1 for w in words)]) if len(start) else np.zeros(1, np.int64)
                contents += [sha256(joined[a:b]).digest() for a, b in zip(begin[start].tolist(), (begin[start + count + k - 1] - 1).tolist(), strict=True)] if len(start) else []
            offsets = pa.array(np.cumsum([0, *(len(p[0]) for p in parts)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p[i] for p in parts] or [np.empty(0)]).astype(t))) for i, t in enumerate((np.int64, np.int32, np.int32))]
            lists.insert(1, pa.ListArray.from_arrays(offsets, pa.array(contents, pa.binary())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(sha, pa.string()), *lists], names)

    schema = "doc_id long, th long, n_words long, sha string, mini array<long>, content array<binary>, start array<int>, n array<int>"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.mapInArrow(name, schema)


def _sorted_windows(k: int):
    """Of each bucket's strings, the windows that a smaller doc_id has too: doc_id, th, their places."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, 1):
            windows = []
            for doc, th, start, packed in rows:
                ends = [i for i, c in enumerate(packed) if c == 32] + [len(packed)]
                begins = [0, *(e + 1 for e in ends[:-1])]
                windows += [(packed[begins[j] : ends[j + k - 1]], doc, th, start + j) for j in range(len(ends) - k + 1)]
            windows.sort()
            out, last, least = [], None, None
            for window, doc, th, at in windows:
                if window != last:
                    last, least = window, doc
                elif doc > least:
                    out.append((doc, th, at))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "th", "at"])

    return sort


def _split_windows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each window of the strings under its own SHA-256."""
    for batch in batches:
        out = []
        for doc, th, start, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = packed.split()
            out += [(hashlib.sha256(b" ".join(words[j : j + k])).digest(), doc, th, start + j) for j in range(len(words) - k + 1)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["w", "doc_id", "th", "at"])


def substring_dedup(docs: DataFrame, k: int = 50, m: int = MINIMISER, hot_bucket: int = HOT_BUCKET, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256; with_text: also the words that stay."""
    m = min(m, k)
    small_batches(docs.sparkSession, 500)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    rows = staged(named(texts, k, m), "super-kmers")
    row = ["doc_id", "th"]
    kmers = rows.filter("doc_id is not null").select(*row, F.explode(F.arrays_zip("mini", "content", "start", "n")).alias("s")).select(*row, "s.*")
    total = rows.agg(F.sum(F.size("mini"))).first()[0] or 0
    shared = kmers.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("content") != F.max("content")).alias("several"), F.count("*").alias("c")).filter("lo < hi").select("mini", "several", "c")
    met = staged(join_counted(kmers, shared, ["mini"], "c", total), "shared")
    n_met = met.count()
    first = met.groupBy("mini", "content").agg(F.min("doc_id").alias("first"), F.count("*").alias("c"))
    judged = join_counted(met, first, ["mini", "content"], "c", n_met).withColumn("gone", F.col("doc_id") > F.col("first")).filter("gone or several")
    judged = staged(judged.select(*row, "mini", "start", "n", "gone"), "judged")

    # whole texts of the rows concerned, once, beside what is known of them
    todo = judged.groupBy(*row).agg(F.collect_list(F.struct("mini", "start", "n", "gone")).alias("todo"))
    own = staged(texts.join(todo, row).select(*row, "t", "todo"), "concerned")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, th, t, todo in zip(*(c.to_pylist() for c in batch.columns[:2]), texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = t.split()
                out += [(s["mini"], doc, th, s["start"], b" ".join(words[s["start"] : s["start"] + s["n"] + k - 1])) for s in todo if not s["gone"]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["mini", *row, "start", "packed"])

    strings = staged(own.mapInArrow(packed, "mini long, doc_id long, th long, start int, packed binary"), "packed")
    per = strings.groupBy("mini").agg(F.count("*").alias("c")).filter("c > 1")
    n_strings = strings.count()
    hot = staged(per.filter(F.col("c") > hot_bucket).select("mini"), "hot")
    if hot.count() <= HOT_BROADCAST:
        hot = F.broadcast(hot)
    cold = spread(strings.join(hot, "mini", "left_anti"), max(1, n_strings // 100), "mini").sortWithinPartitions("mini")
    found = cold.mapInArrow(_sorted_windows(k), "doc_id long, th long, at int")
    windows = staged(strings.join(hot, "mini", "left_semi").select(*row, "start", "packed").mapInArrow(lambda b: _split_windows(b, k), "w binary, doc_id long, th long, at int"), "hot-windows")
    least = windows.groupBy("w").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).filter("c > 1")
    again = join_counted(windows, least, ["w"], "c", windows.count()).filter("doc_id > least").select(*row, "at")
    places = found.unionByName(again).groupBy(*row).agg(F.collect_list("at").alias("at"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, th, t, todo, at in zip(*(c.to_pylist() for c in batch.columns[:2]), texts_of(batch.column(2)), *(c.to_pylist() for c in batch.columns[3:]), strict=True):
                words = t.split()
                edge = np.zeros(len(words) + 1, np.int64)
                for begin, end in [(s["start"], s["start"] + s["n"] + k - 1) for s in todo if s["gone"]] + [(i, i + k) for i in at or ()]:
                    edge[begin] += 1
                    edge[end] -= 1
                stays = np.cumsum(edge)[:-1] == 0
                kept = b" ".join([words[i] for i in np.flatnonzero(stays).tolist()])
                out.append((doc, th, int(len(words) - stays.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=False)], [*row, "gone", "kept_sha", "kept_text"][: 4 + with_text])

    schema = "doc_id long, th long, gone long, kept_sha string" + ", kept_text string" * with_text
    done = own.join(places, row, "left").select(*row, "t", "todo", "at").mapInArrow(removed, schema).dropDuplicates(row)
    out = rows.select(*row, "n_words", "sha").join(done, row, "left")
    out_cols = ["doc_id", "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256")]
    if with_text:
        plain = texts.select(*row, F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), "[\\x20\\x09-\\x0D]+", " ")).alias("plain")).dropDuplicates(row)
        out = out.alias("o").join(plain.alias("p"), F.col("o.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("o.th") == F.col("p.th"))).select("o.*", "plain")
        out_cols.append(F.coalesce("kept_text", "plain").alias("kept_text"))
    return out.select(*out_cols)
