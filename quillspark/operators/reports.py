"""Aggregates of experiment reports: topics, verdict rates, ablation tables, themes, runs and their comparison.

An indicator is topic, indicator_type, verdict, confidence and, where rules ran, adjusted_confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import mann_whitney

TYPES, VERDICTS = ("FRAGMENTATION", "INCONSISTENCY", "INCOMPLETENESS"), ("PASS", "FLAG", "REJECT")


def _first_in(text: Column, of: tuple[str, ...]) -> Column:
    """The first of these names that a text holds, whatever its case; null if none."""
    return F.coalesce(*[F.when(F.upper(text).contains(x), F.lit(x)) for x in of])


def _rate(k: Column, n: Column) -> Column:
    return F.when(n > 0, F.round(k / n * 100, 1)).otherwise(0.0)


def topic_results(indicators: DataFrame) -> DataFrame:
    """topic, total_indicators, counts by type and by verdict (none: no known verdict), mean, greatest and least confidence."""
    kind, verdict = _first_in(F.col("indicator_type"), TYPES), _first_in(F.coalesce("verdict", F.lit("")), VERDICTS)
    counts = [F.count_if(F.coalesce(kind == t, F.lit(False))).alias(f"n_{t.lower()}") for t in TYPES]
    counts += [F.count_if(F.coalesce(verdict == v, F.lit(False))).alias(f"n_{v.lower()}") for v in VERDICTS] + [F.count_if(verdict.isNull()).alias("n_none")]
    c = F.coalesce("confidence", F.lit(0.0))
    return indicators.groupBy("topic").agg(F.count("*").alias("total_indicators"), *counts, F.round(F.avg(c), 3).alias("avg_confidence"), F.round(F.max(c), 3).alias("max_confidence"), F.round(F.min(c), 3).alias("min_confidence"))


def verdict_rates(topics: DataFrame) -> DataFrame:
    """One row of topic_results summed up: totals, and rates in percent of what was evaluated."""
    t = topics.agg(*[F.coalesce(F.sum(f"n_{v.lower()}"), F.lit(0)).alias(f"n_{v.lower()}") for v in VERDICTS]).withColumn("total_evaluated", F.col("n_pass") + F.col("n_flag") + F.col("n_reject"))
    return t.select("total_evaluated", "n_pass", "n_flag", "n_reject", *[_rate(F.col(f"n_{v.lower()}"), F.col("total_evaluated")).alias(f"{v.lower()}_rate") for v in VERDICTS])


def overall_metrics(indicators: DataFrame) -> DataFrame:
    """One row: indicators, topics, mean confidences, rates; rerr is the share that rules flagged or rejected."""
    rates = verdict_rates(topic_results(indicators))
    c = F.coalesce("confidence", F.lit(0.0))
    mean = lambda x: F.coalesce(F.round(F.avg(x), 3), F.lit(0.0))
    total = indicators.agg(F.count("*").alias("total_indicators"), F.countDistinct("topic").alias("topics_analyzed"), mean(c).alias("avg_confidence"), mean(F.coalesce("adjusted_confidence", c)).alias("avg_adjusted_confidence"))
    # one row each
    return total.crossJoin(rates.select("pass_rate", "flag_rate", "reject_rate", F.round(F.col("flag_rate") + F.col("reject_rate"), 1).alias("rerr")))


def adversarial_accuracy(expected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: total_cases, correct, accuracy in percent, from (claim_id, expected) and (claim_id, verdict); a claim without a verdict is wrong."""
    m = expected.join(verdicts.select("claim_id", "verdict"), "claim_id", "left")
    return m.agg(F.count("*").alias("total_cases"), F.count_if(F.col("verdict").eqNullSafe(F.col("expected"))).alias("correct")).withColumn("accuracy", _rate(F.col("correct"), F.col("total_cases")))


def counts_by_type(indicators: DataFrame) -> DataFrame:
    """kind, key, n: indicators by type, and by verdict of the rules."""
    by = lambda kind, c: indicators.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("key")).agg(F.count("*").alias("n"))
    return by("type", "indicator_type").unionByName(by("verdict", "verdict").filter("key is not null"))


def run_means(runs: DataFrame) -> DataFrame:
    """Runs (confidences, avg_confidence) with mean_confidence: of the run's confidences, or as recorded; null without either."""
    own = F.col("confidences")
    mean = F.aggregate(own, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(own)
    return runs.withColumn("mean_confidence", F.coalesce(F.when(F.size(own) > 0, mean), F.col("avg_confidence").cast("double")))


def run_figures(runs: DataFrame, by: list[str], value: str, flagged: str, total: str) -> DataFrame:
    """by, n_runs, mean and sample deviation of value, rerr: the mean share of flagged in total, in percent."""
    share = F.when(F.col(total) > 0, F.col(flagged) / F.col(total) * 100)
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.round(F.avg(share), 6).alias("rerr"))


def collected_runs(files: DataFrame) -> DataFrame:
    """mode, model, run, n_indicators, confidences, from (path, value) of report files; confidences of all topics in order, no row for other files."""
    kind = "struct<phase3_gap_detection:struct<topics:array<struct<confidence_scores:array<double>,error:string>>>>"
    name = "experiment_(.+)_([^_]+)_latest\\.run(\\d+)\\.json$"
    part = lambda i: F.regexp_extract("path", name, i)
    topics = F.filter(F.from_json("value", kind)["phase3_gap_detection"]["topics"], lambda t: t["error"].isNull())
    scores = F.flatten(F.transform(topics, lambda t: F.coalesce(t["confidence_scores"], F.array().cast("array<double>"))))
    out = files.filter(F.col("path").rlike(name)).select(part(1).alias("mode"), part(2).alias("model"), part(3).cast("int").alias("run"), F.coalesce(scores, F.array().cast("array<double>")).alias("confidences"))
    return out.withColumn("n_indicators", F.size("confidences"))


def ablation(runs: DataFrame, rows: list[str], columns: list[str], row: str, column: str, value: str) -> DataFrame:
    """row and one column per wanted column with the mean of value, 6 places; a missing combination is null, and a missing row is there too."""
    wanted = runs.sparkSession.createDataFrame([(r, i) for i, r in enumerate(rows)], f"{row} string, place int")
    means = runs.groupBy(row).agg(*[F.round(F.avg(F.when(F.col(column) == c, F.col(value))), 6).alias(c) for c in columns])
    return wanted.join(means, row, "left").select(row, "place", *columns)


def comparisons(runs: DataFrame, pairs: list[tuple[str, str, str]], variables: list[str], mode: str = "mode") -> DataFrame:
    """hypothesis, comparison, variable, n1, n2, u, p, rank_biserial for each planned pair of modes; correct p by holm() over the table."""
    plan = runs.sparkSession.createDataFrame([(h, a, b, side, m) for h, a, b in pairs for side, m in (("a", a), ("b", b))], "hypothesis string, mode_a string, mode_b string, side string, m string")
    long = runs.select(F.col(mode).alias("m"), F.explode(F.map_from_arrays(F.array(*[F.lit(v) for v in variables]), F.array(*[F.col(v).cast("double") for v in variables]))).alias("variable", "v"))
    rows = long.join(F.broadcast(plan), "m").withColumn("key", F.struct("hypothesis", "mode_a", "mode_b", "variable"))
    out = mann_whitney(rows, "key", "side", "v").filter("n1 >= 2 and n2 >= 2")
    return out.select("key.hypothesis", F.concat_ws(" vs ", "key.mode_a", "key.mode_b").alias("comparison"), "key.variable", "n1", "n2", "u", "p", "rank_biserial")


def themes(papers: DataFrame, by: str, keywords: str = "keywords", seq: str = "seq", most: int = 5) -> DataFrame:
    """by, rank, theme, n: the most frequent keywords, the one met first before others as frequent."""
    words = papers.select(F.col(by), F.col(seq).alias("s"), F.posexplode(keywords).alias("i", "theme"))
    counted = words.groupBy(by, "theme").agg(F.count("*").alias("n"), F.min(F.struct("s", "i")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first", "theme"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= most).select(by, "rank", "theme", "n")


def methodologies(papers: DataFrame, by: str, terms: tuple[str, ...], content: str = "content", most: int = 5) -> DataFrame:
    """by, methods: the terms that some content holds, in the order given, the first few."""
    held = papers.groupBy(by).agg(*[F.bool_or(F.lower(F.coalesce(content, F.lit(""))).contains(t)).alias(f"t{i}") for i, t in enumerate(terms)])
    all_terms = F.array(*[F.when(F.col(f"t{i}"), F.lit(t)) for i, t in enumerate(terms)])
    return held.select(by, F.slice(F.filter(all_terms, lambda t: t.isNotNull()), 1, most).alias("methods"))


def job_evaluation(jobs: DataFrame) -> DataFrame:
    """jobs (n_gaps, n_recs, n_topics, n_facts, n_entities, full_mode, has_report) with coverage, completeness, density and a score of stages."""
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    has = lambda c: F.when(c, 0.2).otherwise(0.0)
    score = F.when(F.col("full_mode"), 0.2).otherwise(0.1) + has(F.col("n_facts") > 0) + has(F.col("n_gaps") > 0) + has(F.col("has_report")) + has(F.col("n_recs") > 0)
    return jobs.select("*", F.round(F.least(over("n_gaps", "n_topics"), F.lit(1.0)), 3).alias("topic_coverage"), F.round(F.least(over("n_recs", "n_gaps"), F.lit(1.0)), 3).alias("recommendation_completeness"), F.round(over("n_facts", "n_entities"), 3).alias("kg_density"), F.round(score, 3).alias("pipeline_score"))


def by_description(indicators: DataFrame, labels: DataFrame, value: str, default: str | None = None, seq: str = "seq", width: int = 80) -> DataFrame:
    """indicators with value from labels (description, value, seq) by the first characters of the description; of labels alike the last counts."""
    key = lambda: F.substring(F.coalesce("description", F.lit("")), 1, width)
    last = labels.filter(key() != "").groupBy(key().alias("k")).agg(F.max_by(value, seq).alias(value))
    out = indicators.withColumn("k", key()).join(last, "k", "left").drop("k")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def means(rows: DataFrame, by: list[str], values: list[str], places: int) -> DataFrame:
    """Means that skip nulls, rounded: over raters to 2 places, over queries to 4."""
    own = [F.round(F.avg(v), places).alias(v) for v in values]
    return rows.groupBy(*by).agg(*own) if by else rows.agg(*own)


def file_digests(files: DataFrame) -> DataFrame:
    """path, sha256, n_bytes of binary files: what a run was made from."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("n_bytes"))


def groups_by_basis(papers: DataFrame, by: str, seq: str = "seq") -> DataFrame:
    """by, basis, titles in order, n: the papers of one analysis by their basis, Lainnya where there is none."""
    basis = F.coalesce(F.trim("basis"), F.lit("Lainnya"))
    groups = papers.groupBy(by, basis.alias("basis")).agg(F.sort_array(F.collect_list(F.struct(seq, "title"))).alias("l"))
    return groups.select(by, "basis", F.transform("l", lambda x: x["title"]).alias("titles"), F.size("l").alias("n"))


def primary(rows: DataFrame, by: str, gap: str = "confidence", seq: str = "seq") -> DataFrame:
    """by, and the first row of the highest gap score: the gap that a proposal answers."""
    best = rows.groupBy(by).agg(F.min(F.struct((-F.coalesce(gap, F.lit(0.0))).alias("minus"), *[c for c in (seq, *(x for x in rows.columns if x not in (by, seq)))])).alias("b"))
    return best.select(by, *[F.col(f"b.{c}") for c in rows.columns if c != by])


def primary_recommendation(rows: DataFrame, by: str, seq: str = "seq") -> DataFrame:
    """by, and the first recommendation of high priority, else the first."""
    best = rows.groupBy(by).agg(F.min(F.struct(F.when(F.col("priority") == "high", 0).otherwise(1).alias("late"), *[c for c in (seq, *(x for x in rows.columns if x not in (by, seq)))])).alias("b"))
    return best.select(by, *[F.col(f"b.{c}") for c in rows.columns if c != by])
