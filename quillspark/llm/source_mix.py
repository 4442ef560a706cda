"""Mixing sources to target weights by the cube method.

A document's expected number of copies is its source's target over its source's size, so at most max_repeat. The whole
part is taken for certain; the fraction is an inclusion probability. Documents of one source move through the
null-space of two constraints, tokens and documents: the largest undecided one moves, all others of its block make up for it, and
at each step at least one is decided. A step goes either way with the odds that keep every document's expectation, so inclusion
probabilities hold. Blocks of a source fly apart from each other; the few that each leaves undecided, its smallest, meet in
further rounds, until a landing problem of two or three units a source is left. There the documents' total is given up first:
words are evened out between two, and the last is drawn by its probability, or, if it is more than DRAWN of its source's target,
rounded, so that a source's words come near its target whatever its documents.

Null texts have size 0; null is a source of its own, the last. A source without words has target 0. Repeated rows and rows
without doc_id are units of their own. Columns besides id, text and source are ignored, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, join_counted, key_of, numbered, staged

#: Sources whose targets are worked out on the driver; more are ranked and filled on the cluster.
DRIVER_SOURCES = 100_000
#: The share of its source's target up to which a last undecided unit is drawn rather than rounded.
DRAWN = 0.001
EPS = 1e-9


def level_targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of sum(sizes) by weight; none above cap times its size, the excess reshared by weight."""
    cap, total, full = float(cap), float(sum(sizes)), [False] * len(sizes)
    while True:
        rest = total - sum(cap * s for s, f in zip(sizes, full, strict=True) if f)
        open_weight = sum(w for w, f in zip(weights, full, strict=True) if not f)
        out = [cap * s if f else rest * w / open_weight for s, w, f in zip(sizes, weights, full, strict=True)]
        over = [not f and t > cap * s for t, s, f in zip(out, sizes, full, strict=True)]
        if not any(over):
            return out
        full = [a or b for a, b in zip(full, over, strict=True)]


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """sizes: k, source, source_size, n_rows, a row for each source. Adds target."""
    spark = sizes.sparkSession
    if sizes.count() <= DRIVER_SOURCES:
        rows = sorted(sizes.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
        targets = level_targets([r["source_size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], cap)
        return spark.createDataFrame([(r["k"], r["source_size"], r["n_rows"], t) for r, t in zip(rows, targets, strict=True)], "k string, source_size long, n_rows long, target double")
    ranked = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (x[0]["k"], x[0]["source_size"], x[0]["n_rows"], float(weights[x[1] % len(weights)])))
    ranked = staged(spark.createDataFrame(ranked, "k string, source_size long, n_rows long, w double"), "mix-sources")
    total, level = float(ranked.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:  # the level rises as sources fill up, and no source becomes free again
        full = F.col("source_size") * cap <= F.col("w") * level
        held, free = ranked.agg(F.sum(F.when(full, F.col("source_size") * cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        new = (total - held) / free if free else level
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(F.col("source_size") * F.lit(float(cap)), F.col("w") * level)).drop("w")


def _direction(p: np.ndarray, size: np.ndarray) -> np.ndarray | None:
    """A move of the first unit by one that the others make up for, most those of most slack: both totals stay. None if they can't."""
    weight = p[1:] * (1 - p[1:])
    mean = weight @ size[1:] / weight.sum()
    off = size[1:] - mean
    spread = weight @ (off * off)
    if spread <= 1e-9 * weight.sum():  # all others have one size
        if abs(size[0] - mean) > 1e-6:
            return None
        return np.concatenate([[1.0], -weight / weight.sum()])
    return np.concatenate([[1.0], -weight * (1 / weight.sum() + (size[0] - mean) / spread * off)])


def _moved(p: np.ndarray, move: np.ndarray, draw: float) -> np.ndarray:
    """p as far along move, or against it, as probabilities stay; which way, the draw decides so that p is the mean."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(move > 0, (1 - p) / move, np.where(move < 0, -p / move, np.inf))
        down = np.where(move > 0, p / move, np.where(move < 0, (p - 1) / move, np.inf))
    # what all but stands still decides nothing
    still = np.abs(move) < 1e-13
    up[still], down[still] = np.inf, np.inf
    a, b = up.min(), down.min()
    step, at = (a, int(up.argmin())) if draw * (a + b) < b else (-b, int(down.argmin()))
    out = np.clip(p + step * move, 0.0, 1.0)
    out[at] = np.round(out[at])
    return out


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool, target: float = 0.0) -> np.ndarray:
    """The cube method's flight over units of descending size, with sum(p) and sum(p * size) held; land decides what is left."""
    p, size = p.astype(float), size.astype(float)
    live, left = np.flatnonzero((p > EPS) & (p < 1 - EPS)), []
    while len(live) > 1:
        move = _direction(p[live], size[live])
        if move is None:  # the largest has nobody to move with
            left.append(int(live[0]))
            live = live[1:]
            continue
        p[live] = _moved(p[live], move, rng.random())
        live = live[(p[live] > EPS) & (p[live] < 1 - EPS)]
    left = sorted([*left, *live.tolist()], key=lambda i: (-size[i], i))
    while land and left:
        if len(left) > 1 and size[left[1]] > 0:
            two = left[:2]
            p[two] = _moved(p[two], np.array([1.0, -size[two[0]] / size[two[1]]]), rng.random())
        else:
            i = left[0]
            p[i] = float(rng.random() < p[i]) if size[i] <= DRAWN * target else np.round(p[i])
        left = [i for i in left if EPS < p[i] < 1 - EPS]
    return np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))


def _flight(units: DataFrame, block: int, seed: int, level: int) -> tuple[DataFrame, bool]:
    """One round: blocks of about block units of a source, or the whole source where it is no larger; says if it was the last."""
    total = units.count()
    counts = units.groupBy("k").agg(F.count("*").alias("n"))
    last = (counts.agg(F.max("n")).first()[0] or 0) <= block
    per = counts.select("k", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = join_counted(units, per, ["k"], "n", total).withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed), F.lit(level)), F.col("blocks")).cast("int"))

    def decide(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
        at = [seed, level, int(df["block"].iloc[0]), *df["k"].iloc[0].encode()]
        df["p"] = fly(df["p"].to_numpy(), df["size"].to_numpy(), np.random.default_rng(at), last, float(df["target"].iloc[0]))
        return df[columns]

    columns = units.columns
    return staged(dealt.groupBy("k", "block").applyInPandas(decide, units.schema), f"mix-{level}"), last


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3, block: int = 1024, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken. Reruns agree: all draws are seeded.

    row_col: numbers of the rows, which come back as row.
    """
    row = [F.col(row_col).alias("row")] if row_col else []
    rows = docs.select(F.col(id_col).alias("doc_id"), *row, key_of(source_col).alias("k"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = staged(rows, "mix-rows")
    sizes = rows.groupBy("k").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = source_targets(sizes, tuple(weights), max_repeat)
    total = rows.count()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = join_counted(rows.drop("source"), targets.withColumn("n", F.col("n_rows")).drop("n_rows"), ["k"], "n", total)
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.col("whole")).drop("rate")
    parts, level, last = [], 0, False
    sure = (F.col("p") < EPS) | (F.col("p") > 1 - EPS)
    parts.append(rows.filter(sure))
    open_units = rows.filter(~sure)
    while not last:
        flown, last = _flight(open_units, block, seed, level)
        parts.append(flown.filter(sure))
        open_units, level = flown.filter(~sure), level + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.withColumn("copies", F.col("whole") + F.round("p").cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if row_col else []))


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The rows themselves, each as often as the mix takes it; columns as they came. Repeated and null doc_ids are rows like any other."""
    rows, no = numbered(docs)
    copies = f"{no}_copies"
    while copies in docs.columns:
        copies += "_"
    taken = mix_sources(rows, row_col=no, **options).filter("copies > 0").select(F.col("row").alias(no), F.col("copies").cast("int").alias(copies))
    return rows.join(taken, no).select("*", F.explode(F.sequence(F.lit(1), F.col(copies))).alias(f"{copies}_at")).select(docs.columns)
