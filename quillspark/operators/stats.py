"""Statistics with their definitions in columns: ranks with ties, U, effect sizes, correction, bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def average_rank(by: list[str], value: str) -> Column:
    """Rank within by, ties at their mean."""
    part = Window.partitionBy(*by)
    return F.rank().over(part.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def spearman(rows: DataFrame, by: str, x: str, y: str, least: int = 3) -> DataFrame:
    """by, n, rho of groups of at least least points."""
    r = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("rx", average_rank([by], x)).withColumn("ry", average_rank([by], y))
    return r.groupBy(by).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho")).filter(F.col("n") >= least)


#: Values of the smaller sample, and of both multiplied, up to which p is exact where no values tie.
EXACT, EXACT_CELLS = 8, 20_000


def exact_p(u: float, n1: int, n2: int) -> float:
    """The two-sided p of U without ties: how many of all orders of the two samples give a U as far out."""
    n, m = sorted((int(n1), int(n2)))
    # ways[k][s]: choices of k of the ranks so far whose sum exceeds the least by s
    ways = [[0] * (n * m + 1) for _ in range(n + 1)]
    ways[0][0] = 1
    for rank in range(n + m):
        for k in range(min(rank, n - 1), -1, -1):
            step = rank - k  # the k+1st least rank is k
            if step > m:
                continue
            low, high = ways[k], ways[k + 1]
            for s in range(n * m - step + 1):
                if low[s]:
                    high[s + step] += low[s]
    far = max(u, n1 * n2 - u)
    return min(1.0, 2 * sum(ways[n][math.ceil(far) :]) / math.comb(n + m, n))


def mean_rho(groups: DataFrame) -> DataFrame:
    """n_groups and the mean rho of spearman()'s groups, those without one left out."""
    return groups.filter(F.col("rho").isNotNull() & ~F.isnan("rho")).agg(F.count("*").alias("n_groups"), F.round(F.avg("rho"), 6).alias("mean_rho"))


def mann_whitney(rows: DataFrame, by: str, side: str, value: str) -> DataFrame:
    """by, n1, n2, u, z, p, rank_biserial for side 'a' against 'b': p exact for small samples without ties, else by the normal approximation
    with ties and continuity; null where a side has fewer than two values or all are equal."""
    r = rows.filter(F.col(value).isNotNull()).withColumn("r", average_rank([by], value))
    ties = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("t")).groupBy(by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    g = r.groupBy(by).agg(F.count_if(F.col(side) == "a").alias("n1"), F.count_if(F.col(side) == "b").alias("n2"), F.sum(F.when(F.col(side) == "a", F.col("r")).otherwise(0.0)).alias("ra")).join(ties, by)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    g = g.withColumn("u", F.col("ra") - n1 * (n1 + 1) / 2)
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    z = F.when(var > 0, (F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0))) / F.sqrt(var)).otherwise(0.0)

    @F.pandas_udf("double")
    def two_sided(z: pd.Series, u: pd.Series, a: pd.Series, b: pd.Series, ties: pd.Series, flat: pd.Series) -> pd.Series:
        def one(z: float, u: float, a: int, b: int, ties: int, flat: bool) -> float | None:
            if flat or min(a, b) < 2:
                return None
            return exact_p(u, a, b) if not ties and min(a, b) <= EXACT and a * b <= EXACT_CELLS else math.erfc(z / math.sqrt(2))

        return pd.Series([one(*x) for x in zip(z, u, a, b, ties, flat, strict=True)], dtype="float64")

    return g.withColumn("z", z).withColumn("p", two_sided("z", "u", "n1", "n2", "ties", F.coalesce(var <= 0, F.lit(True)))).withColumn("rank_biserial", 1 - 2 * F.col("u") / (n1 * n2)).drop("ra", "ties")


def cliffs_delta(rows: DataFrame, by: str, side: str, value: str) -> DataFrame:
    """by, delta, magnitude of 'a' against 'b', from ranks: no pairs are made."""
    u = mann_whitney(rows, by, side, value)
    d = 2 * F.col("u") / (F.col("n1") * F.col("n2")) - 1
    out = u.select(by, "n1", "n2", F.round(d, 9).alias("delta"))
    a = F.abs(F.col("delta"))
    return out.withColumn("magnitude", F.when(a < 0.147, "negligible").when(a < 0.33, "small").when(a < 0.474, "medium").otherwise("large"))


def holm(tests: DataFrame, family: str, key: str, p: str) -> DataFrame:
    """tests with adjusted: step-down Holm within each family; a null p stays null and doesn't count."""
    known = tests.filter(F.col(p).isNotNull())
    w = Window.partitionBy(family).orderBy(p, key)
    raw = known.withColumn("m", F.count("*").over(Window.partitionBy(family))).withColumn("r", F.row_number().over(w)).withColumn("raw", F.least(F.lit(1.0), F.col(p) * (F.col("m") - F.col("r") + 1)))
    adj = raw.withColumn("adjusted", F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(family, key, "adjusted")
    return tests.join(adj, [family, key], "left")


def mean_std(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, std (of the sample; null for one run)."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"))


def bootstrap_median_diff(samples: DataFrame, by: str, draws: int = 5000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """by, low, high of the difference of medians of arrays a and b: the samples are runs of an experiment, so short."""

    def ci(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, a, b in df[[by, "a", "b"]].itertuples(index=False):
            rng, a, b = np.random.default_rng(seed), np.asarray(a, float), np.asarray(b, float)
            d = np.median(rng.choice(a, (draws, len(a))), 1) - np.median(rng.choice(b, (draws, len(b))), 1)
            out.append((key, *np.percentile(d, [50 * (1 - level), 50 * (1 + level)])))
        return pd.DataFrame(out, columns=[by, "low", "high"])

    return samples.mapInPandas(lambda frames: (ci(f) for f in frames), samples.select(by).schema.add("low", T.DoubleType()).add("high", T.DoubleType()))
