"""Queries that evaluate: group statistics, raters, calibration, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, stats
from ..functions.text import clamp
from .views import table

_labels = lambda s, d: table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").withColumn("confidence", clamp(F.col("n_chars") / 5000, 0.0, 1.0))
_L = "l AS (SELECT l.*, lang, n_chars, greatest(0.0, least(1.0, n_chars / 5000)) AS c FROM labels l JOIN documents USING (doc_id))"


def raters(s, d):
    f = _labels(s, d).select(F.col("lang").alias("rater"), F.when(F.col("quality") == 1, "genuine").otherwise("spurious").alias("label"), (F.col("n_chars") % 5).alias("lcs"), (F.col("n_chars") % 4).alias("as_score"), F.when(F.col("toxic") == 1, "REJECT").otherwise("PASS").alias("system_verdict"), F.when(F.col("n_chars") % 2 == 0, "yes").otherwise("no").alias("reject_justified"))
    return evaluate.rater_metrics(f)


def two_sides(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("side"), F.round(F.col("o_totalprice") / 1000).alias("v"))


# rank sums and counts below, so that no pairs are made
_SIDES = """x AS (SELECT o_orderpriority AS k, o_orderstatus = 'F' AS a, round(o_totalprice / 1000) AS v FROM orders),
 r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY v) + (count(*) OVER (PARTITION BY k, v) - 1) / 2.0 AS r FROM x),
 g AS (SELECT k, count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE NOT a) AS n2, sum(r) FILTER (WHERE a) AS s FROM r GROUP BY k),
 w AS (SELECT k AS o_orderpriority, n1, n2, CAST(s - n1 * (n1 + 1) / 2 AS DOUBLE) AS u FROM g)"""


def holm(s, d):
    t = table(s, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_size") / 1000).alias("p"))
    return stats.holm(t, "p_brand", "p_partkey", "p").select("p_partkey", F.round("adjusted", 6).alias("adjusted"))


QUERIES = {
    "breakdown": (
        lambda s, d: evaluate.breakdown(table(s, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / 1e6).alias("c"), F.when(F.col("o_orderstatus") == "F", "FLAG").when(F.col("o_orderstatus") == "O", "PASS").otherwise("REJECT").alias("v")), "o_orderpriority", "c", "v"),
        "SELECT o_orderpriority AS key, count(*) AS n, round(avg(o_totalprice / 1e6), 6) AS mean_confidence, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_pass, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_flag, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS n_reject FROM orders GROUP BY 1",
    ),
    "crosstab": (lambda s, d: evaluate.crosstab(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]), "SELECT o_orderpriority AS key, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1"),
    "ear_fdr": (
        raters,
        f"WITH {_L} SELECT lang AS rater, count(*) AS n, round(100.0 * avg(quality), 6) AS ear, round(100 - 100.0 * avg(quality), 6) AS fdr, round(avg(n_chars % 5), 6) AS mean_lcs, round(avg(n_chars % 4), 6) AS mean_as, round(100.0 * count(*) FILTER (WHERE toxic = 1 AND n_chars % 2 = 0) / nullif(count(*) FILTER (WHERE toxic = 1), 0), 6) AS rep FROM l GROUP BY 1",
    ),
    "kappa": (
        lambda s, d: evaluate.kappa(_labels(s, d), "quality", "toxic"),
        f"WITH {_L}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS s, sum(quality) AS q, sum(toxic) AS x FROM l), p AS (SELECT n, s / n AS po, (q * x + (n - q) * (n - x)) / (n * n) AS pe FROM t) SELECT n, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM p",
    ),
    "calibration_bins": (lambda s, d: evaluate.calibration(_labels(s, d), "confidence", "quality"), f"WITH {_L}, g AS (SELECT CAST(least(floor(c * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(c), 6) AS m, round(avg(quality), 6) AS a FROM l GROUP BY 1) SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n, m AS mean_confidence, a AS accuracy FROM range(10) t(b) LEFT JOIN g ON g.bin = b"),
    "calibration_errors": (
        lambda s, d: evaluate.calibration_errors(_labels(s, d), "confidence", "quality"),
        f"WITH {_L}, g AS (SELECT least(floor(c * 10), 9) AS bin, count(*) AS n, sum(c) AS sc, sum(quality) AS sy, sum((c - quality) ** 2) AS sq FROM l GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(sq) / sum(n), 6) AS brier, round(sum(abs(sc - sy)) / sum(n), 6) AS ece, round(max(abs(sc - sy) / n), 6) AS mce, round(sum(sy) / sum(n), 6) AS base_rate FROM g",
    ),
    "wilson": (
        lambda s, d: evaluate.precision_by(_labels(s, d).withColumn("label", F.when(F.col("quality") == 1, "correct").when(F.col("toxic") == 1, "partial").otherwise("wrong")), "lang", "label"),
        f"WITH {_L}, g AS (SELECT lang AS key, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS k, count(*) FILTER (WHERE quality = 1 OR toxic = 1) AS m FROM l GROUP BY 1), p AS (SELECT *, k / n AS p, 1.96 AS z FROM g) SELECT key, n, round(p, 6) AS strict, round(m / n, 6) AS lenient, round(greatest(0.0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1.0, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM p",
    ),
    "prf": (lambda s, d: _labels(s, d).groupBy("lang").agg(F.sum("toxic").alias("tp"), F.sum("quality").alias("q"), F.count("*").alias("g")).select("lang", *evaluate.prf(F.col("tp"), F.col("q"), F.col("g"))), f"WITH {_L}, t AS (SELECT lang, sum(toxic) / sum(quality) AS p, sum(toxic) / count(*) AS r FROM l GROUP BY 1) SELECT lang, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM t"),
    "spearman_by_group": (
        lambda s, d: stats.spearman(table(s, d, "part"), "p_brand", "p_size", "p_retailprice").withColumn("rho", F.round("rho", 6)),
        "WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS x, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS y FROM part) SELECT p_brand, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1 HAVING count(*) >= 3",
    ),
    "cliffs_delta": (
        lambda s, d: stats.cliffs_delta(two_sides(s, d), "o_orderpriority", "side", "v").withColumn("delta", F.round("delta", 6)),
        f"WITH {_SIDES}, d AS (SELECT *, 2 * u / (n1 * n2) - 1 AS d FROM w) SELECT o_orderpriority, n1, n2, round(d, 6) AS delta, CASE WHEN abs(d) < 0.147 THEN 'negligible' WHEN abs(d) < 0.33 THEN 'small' WHEN abs(d) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM d",
    ),
    "mwu_u": (
        lambda s, d: stats.mann_whitney(two_sides(s, d), "o_orderpriority", "side", "v").select("o_orderpriority", F.round("u", 6).alias("u"), F.round("rank_biserial", 6).alias("rank_biserial")),
        f"WITH {_SIDES} SELECT o_orderpriority, round(u, 6) AS u, round(1 - 2 * u / (n1 * n2), 6) AS rank_biserial FROM w",
    ),
    "holm": (holm, "WITH k AS (SELECT p_brand, p_partkey, p_size / 1000 AS p FROM part WHERE p_partkey % 10 <> 0), r AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) + 1)) AS raw FROM k), a AS (SELECT p_partkey, max(raw) OVER (PARTITION BY p_brand ORDER BY p, p_partkey ROWS UNBOUNDED PRECEDING) AS adj FROM r) SELECT part.p_partkey, round(adj, 6) AS adjusted FROM part LEFT JOIN a ON a.p_partkey = part.p_partkey"),
    "mean_std": (lambda s, d: stats.mean_std(table(s, d, "events"), ["event_type"], "value"), "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1"),
    "bootstrap_median": (lambda s, d: stats.bootstrap_median_diff(table(s, d, "supplier").groupBy((F.col("s_nationkey") % 3).alias("k")).agg(F.sort_array(F.collect_list(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("s_suppkey") % 2 == 1, F.col("s_acctbal")))).alias("b")), "k", 500), None),
}
