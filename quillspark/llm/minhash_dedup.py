"""Near-duplicate classes from bottom-k sketches of one hash function.

A document's set is its distinct word shingles; its sketch, the K smallest of their hashes. Documents of one and the same
word sequence are one class from the start. The retained values make inverted lists. Two sets at the least similarity
share at least overlap(percent) values (with sets no larger than K this is certain, else but for odds of ODDS at most), so
they share one of the rarest K - overlap + 1 that each has, and only those are listed; texts without a relative drop out here. Each list
goes to its most central member, whose values are the most frequent: the lists of one centre make one group. In a group,
sketches of unions estimate similarity; what passes is read again, and full sets of 64-bit hashes decide exactly. A group links its members
by a spanning set of exact links, found by comparing all that are not yet joined: no pair of different classes is left
unchecked, and pairs aren't written. A large group is dealt in blocks, and its centre joins each: a block links what it
holds, most of it with the centre, so what is linked with the centre in different blocks needs no comparison. Only the members that
stay apart from it are then dealt in blocks once more, and each of those meets every block of the group. So a group of m near copies
is m rows of work, and one with u members apart 2 * u * m / BLOCK_ROWS more.

Null and empty texts have no shingles and are linked with nothing, not even each other. A text shorter than a shingle is one shingle as it is. Rows that
repeat a doc_id take part as they are and share its component. Null doc_ids form no class with others. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, components, join_counted, kept_only, made_since, numbered, runs, small_batches, spread, staged, texts_of, windows_hash

#: Retained values; the odds at most that a pair at the threshold shares too few of them: 3e-10 at 85 percent, 2e-10 at 80.
K, ODDS = 48, 1e-9
#: Members and shingles of a block; a block of those apart and one of all meet in a task.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1_000_000
#: Places in cells, some 40 bytes each, up to which the documents to read again are named by broadcast.
FEW_PLACES = 400_000


def overlap(percent: int) -> int:
    """The least that the sketches of similar large sets share, but for ODDS: P(Binomial(K, percent / 100) < overlap)."""
    p, tail = percent / 100, 0.0
    for n in range(K + 1):
        tail += math.comb(K, n) * p**n * (1 - p) ** (K - n)
        if tail > ODDS:
            break
    if n < 1:
        raise ValueError(f"sketches of {K} values can't find pairs of {percent} percent but for odds of {ODDS}")
    return n


#: At the 85 percent of the registered query.
OVERLAP = overlap(85)


def least_overlap(n: int, percent: int) -> int:
    """Values that the sketch of a set of n shares at least with that of any set of percent similarity."""
    if n > K:
        return overlap(percent)
    most = n * 100 // percent
    return min([overlap(percent) if m > K and n > K * percent // 100 else math.ceil(percent * m / 100) - max(0, m - K) for m in range(n, max(n, most) + 1)])


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(windows_hash(hashes.of(words), width))


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (shingles), class key of the word sequence, sketch."""
    small_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, keys, kept = [], [], []
            for t in texts_of(batch.column(1)):
                words = (t or b"").lower().split()
                own = shingle_set(words, width, hashes)
                n.append(len(own))
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                kept.append(own[:K].view(np.int64))
            offsets = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            values = np.concatenate(kept) if kept else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "n", "key", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(sketch, "doc_id long, n long, key binary, sketch array<long>")


def union_estimate(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets by the K smallest values of their union."""
    both = np.union1d(a, b)[:K]
    return np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].mean() if len(both) else 0.0


def spanning_links(sets: list[np.ndarray], similar, label: np.ndarray | None = None) -> np.ndarray:
    """The component of each member in the graph of all similar pairs, and of what is known (label). similar(i, others, shared): which of others.

    A member is compared with all others at once, the most central first. What has joined the component of that first one
    needs no comparison of its own: every pair with a member outside is seen from there.
    """
    m = len(sets)
    label = np.arange(m) if label is None else np.unique(label, return_inverse=True)[1]
    if m == 2:
        shared = np.array([len(np.intersect1d(sets[0], sets[1], assume_unique=True))])
        return np.zeros(2, np.int64) if label[0] == label[1] or similar(0, np.array([1]), shared)[0] else np.arange(2)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, code = np.unique(flat, return_inverse=True)
    by = np.argsort(code, kind="stable")
    count = np.bincount(code)
    first = np.cumsum(count) - count
    posted = owner[by]
    ends = np.cumsum([len(s) for s in sets])
    central = np.bincount(owner, count[code], m)
    order = np.argsort(-central, kind="stable")
    # the first is of the largest part that is known to be one
    known = np.bincount(label)
    start = int(order[known[label[order]] == known.max()][0])
    for i in [start, *order[order != start].tolist()]:
        if i != start and label[i] == label[start]:
            continue
        own = code[ends[i] - len(sets[i]) : ends[i]]
        n = count[own]
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(posted[at], minlength=m)
        others = np.flatnonzero((shared > 0) & (label != label[i]))
        if len(others):
            for j in others[similar(i, others, shared[others])].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
    return label


def _cells(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of sorted batches, a document once in each; cells of one document are left out."""
    for key, rows in runs(batches, n_keys):
        rows = list({r[0]: r for r in rows}.values())
        if len(rows) > 1:
            yield key, rows


def _screened(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of each cell, the members that some other member's sketch resembles, with the part of the cell they are in."""
    for (centre, i, j), rows in _cells(batches, 3):
        sets = [np.sort(np.array(r[2], np.int64).view(np.uint64)) for r in rows]
        sizes = np.array([len(x) for x in sets])

        def similar(a: int, others: np.ndarray, shared: np.ndarray, sets: list[np.ndarray] = sets, sizes: np.ndarray = sizes) -> np.ndarray:
            # the estimate is at most the share of all shared values
            may = K * shared >= least * np.minimum(K, sizes[a] + sizes[others] - shared)
            may[may] = [union_estimate(sets[a], sets[b]) >= least / K for b in others[may].tolist()]
            return may

        known = np.array([r[1] for r in rows])
        part = spanning_links(sets, similar, known)
        # what is one part only because it was known to be is none to look at
        _, kinds = np.unique(np.unique(np.column_stack([part, known]), axis=0)[:, 0], return_counts=True)
        several = kinds[np.unique(part, return_inverse=True)[1]] > 1
        found = [(centre, i, j, int(p), r[0], r[1]) for p, r, more in zip(part, rows, several, strict=True) if more]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["centre", "i", "j", "part", "doc_id", "known"])


def _linked(cells: DataFrame, n_cells: int, docs: DataFrame, classes: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """centre, a, b: each member's link with one of its component in its cell, the centre if it is in it.

    cells: centre, i, j, doc_id, known; members with one value of known are linked already.
    """
    spark, least, key = docs.sparkSession, overlap(percent), ["centre", "i", "j"]
    small_batches(spark)
    with_sketch = spread(cells.join(classes.select("doc_id", "sketch"), "doc_id").select(*key, "doc_id", "known", "sketch"), n_cells, *key).sortWithinPartitions(*key, "doc_id")
    passed = staged(with_sketch.mapInArrow(lambda batches: _screened(batches, least), "centre long, i int, j int, part int, doc_id long, known long"), "passed")
    small_batches(spark, 500)
    key = [*key, "part"]
    wanted = passed.groupBy("doc_id").agg(F.collect_list(F.struct(*key, "known")).alias("places"))
    n_places = passed.count()
    wanted = F.broadcast(wanted) if n_places <= FEW_PLACES else wanted.hint("merge")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).join(wanted, "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for doc, t, places in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                own = shingle_set((t or b"").lower().split(), width, hashes).tobytes()
                for at in range(0, len(places), 1000):
                    out = [(p["centre"], p["i"], p["j"], p["part"], doc, p["known"], own) for p in places[at : at + 1000]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], [*key, "doc_id", "known", "own"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (centre, *_), rows in _cells(batches, 4):
            sets = [np.frombuffer(r[2], np.uint64) for r in rows]
            sizes = np.array([len(s) for s in sets])

            def similar(a: int, others: np.ndarray, shared: np.ndarray, sizes: np.ndarray = sizes) -> np.ndarray:
                return 100 * shared >= percent * (sizes[a] + sizes[others] - shared)

            label = spanning_links(sets, similar, np.array([r[1] for r in rows]))
            head: dict[int, int] = {}
            for x, r in zip(label.tolist(), rows, strict=True):
                head[x] = centre if r[0] == centre else head.get(x, r[0])
            links = [(centre, head[x], r[0]) for x, r in zip(label.tolist(), rows, strict=True) if r[0] != head[x]]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["centre", "a", "b"])

    sets = texts.select("doc_id", "t", "places").mapInArrow(read, "centre long, i int, j int, part int, doc_id long, known long, own binary")
    sets = spread(sets, max(1, n_places // 2), *key).sortWithinPartitions(*key, "doc_id")
    return staged(sets.mapInArrow(decide, "centre long, a long, b long"), "links")


def near_links(docs: DataFrame, classes: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links a, b between classes (doc_id of the first of each) that span all components of similar ones."""
    least = overlap(percent)
    total = classes.agg(F.sum(F.size("sketch"))).first()[0] or 0
    values = classes.select("doc_id", F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1").withColumn("freq", F.col("n"))
    shared = join_counted(values, often, ["value"], "n", total).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("freq", "value"))).alias("shared"), F.sum("freq").alias("fame"))
    reach = F.array(*[F.lit(n - least_overlap(n, percent) + 1 if n <= K else K - least + 1) for n in range(1, K + 2)])
    sized = shared.join(classes.select("doc_id", "n", F.size("sketch").alias("kept")), "doc_id")
    # values of no other document come first in the order; what they leave of the prefix is listed
    listed = F.element_at(reach, F.least(F.col("n"), F.lit(K + 1)).cast("int")) - (F.col("kept") - F.size("shared"))
    lists = sized.filter(listed > 0).select("doc_id", "n", "fame", F.explode(F.slice("shared", F.lit(1), F.least(listed, F.size("shared")))).alias("s"))
    lists = staged(lists.select("doc_id", F.col("n").alias("size"), "fame", "s.value"), "lists")
    centres = lists.groupBy("value").agg((-F.max(F.struct("fame", (-F.col("doc_id")).alias("neg")))["neg"]).alias("centre"), F.count("*").alias("n")).filter("n > 1")
    groups = join_counted(lists, centres, ["value"], "n", lists.count()).groupBy("centre", "doc_id").agg(F.first("size").alias("size"))
    groups = staged(groups, "groups")
    shape = groups.groupBy("centre").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")).filter("n > 1")
    placed = join_counted(groups, shape, ["centre"], "n", groups.count()).withColumn("b", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    placed = staged(placed, "placed")
    n_cells = shape.agg(F.sum("blocks")).first()[0] or 1
    blocks = placed.select("centre", F.col("b").alias("i"), F.col("b").alias("j"), "doc_id", F.col("doc_id").alias("known"))
    heads = placed.filter("doc_id = centre and blocks > 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("o <> b")
    heads = heads.select("centre", F.col("o").alias("i"), F.col("o").alias("j"), "doc_id", F.col("doc_id").alias("known"))
    links = _linked(blocks.unionByName(heads), n_cells, docs, classes, percent, width, id_col, text_col)

    # members of large groups, with the centre's name if they are linked with it
    joined = links.filter("a = centre").select("centre", F.col("b").alias("doc_id"), F.lit(True).alias("joined")).distinct()
    large = staged(placed.filter("blocks > 1").join(joined, ["centre", "doc_id"], "left").withColumn("joined", F.col("joined").isNotNull() | (F.col("doc_id") == F.col("centre"))), "large")
    n_apart = F.count_if(~F.col("joined"))
    apart = staged(large.groupBy("centre").agg(F.count("*").alias("n"), F.greatest(F.ceil(n_apart / BLOCK_ROWS), F.ceil(F.sum(F.when(~F.col("joined"), F.col("size"))) / BLOCK_SHINGLES)).cast("int").alias("parts"), F.max("blocks").alias("of")).filter("parts > 0"), "apart")
    n_cells = apart.agg(F.sum(F.col("parts").cast("long") * F.col("of"))).first()[0] or 0
    if n_cells:
        members = join_counted(large, apart.drop("of"), ["centre"], "n", large.count())
        known = F.when(F.col("joined"), F.col("centre")).otherwise(F.col("doc_id")).alias("known")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = members.filter(~F.col("joined")).select("centre", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts")).cast("int").alias("i"), every("blocks").alias("j"), "doc_id", known)
        against = members.select("centre", every("parts").alias("i"), F.col("b").alias("j"), "doc_id", known)
        links = links.unionByName(_linked(own.unionByName(against), n_cells, docs, classes, percent, width, id_col, text_col))
    return links.select("a", "b")


def minhash_dedup(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id (the smallest doc_id reachable), kept."""
    rows = staged(sketches(docs, width, id_col, text_col), "sketches")
    full = rows.filter("n > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "n", "sketch")).alias("first")
    classes = staged(full.groupBy("key").agg(first, F.count("*").alias("copies")).select("key", "first.*", "copies"), "classes")
    labels = components(near_links(docs, classes, percent, width, id_col, text_col))
    named = classes.join(labels, classes["doc_id"] == labels["node"], "left").select("key", F.col("doc_id").alias("class_id"), F.coalesce("label", "doc_id").alias("component_id"), "copies")
    out = join_counted(rows.select("doc_id", "n", "key"), named, ["key"], "copies", rows.count(), "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    own = lambda c: F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(c)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own("class_id"), own("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, columns as they came: the first by doc_id, those without one last.

    Rows are told apart by numbers, so repeated and null doc_ids are rows like any other.
    """
    rows, no = numbered(docs)
    mark = len(made_since(0))
    found = minhash_dedup(rows, percent, width, no, text_col).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    found = staged(found.join(rows.select(F.col(no).alias("row"), F.col(id_col).alias("id")), "row"), "components")
    best = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row")).alias("best")
    many = found.groupBy("component").agg(best, F.count("*").alias("n")).filter("n > 1").select("component", F.col("best.row").alias("keep"), "n")
    gone = join_counted(found, many, ["component"], "n", found.count()).filter("row <> keep").select(F.col("row").alias(no))
    gone = kept_only(gone, "gone", mark)
    return rows.join(gone, no, "left_anti").select(docs.columns)
