"""Quality by hierarchical empirical Bayes.

A logistic model over counts of the text and over its words, hashed into buckets, gives each document's evidence. Summed by host and
by path below it, the evidence gives a posterior for each site: sparse sites shrink to what stands above them, path to host and host to the global
rate, by a prior strength that the method of moments takes from the spread between sites. A document's odds are its own
evidence moved by how far its path's posterior, without the document itself, stands from the global rate: a site's only
document is moved by what stands above the site.

Null and empty texts have neutral counts and are judged like any other. Null hosts and paths are sites of their own. Labels
that are null, or of no document, are ignored; of a document's labels the best counts; without labels every document scores the
prior and is kept. Repeated rows are scored one by one, and a score at the threshold is kept. Other columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, kept_only, key_of, made_since, numbered, small_batches, staged

#: Labelled rows that the model is fitted on at most, about; which, a hash of doc_id decides.
FIT_ROWS = 20_000
#: Buckets of words, and how much stronger than the counts' the ridge on their weights is.
BUCKETS, WORD_RIDGE = 128, 20.0
SYMBOLS = "#*$%&<>"
FEATURES = ("log_words", "word_length", "symbols", "bars", "shouts", "no_lower", "same_lines", "variety")


def _share(text: Column, of: str, n: Column) -> Column:
    rest = text
    for c in of:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(rest)) / n


def text_features(text: Column) -> list[Column]:
    """What the classifier sees: rates, so that long and short texts compare."""
    text = F.coalesce(text, F.lit(""))
    words = F.split(text, "[\\x20\\x09-\\x0D]+")
    n_words, n_chars = F.size(words).cast("double"), F.greatest(F.length(text), F.lit(1)).cast("double")
    lines = F.split(text, "\n")
    return [
        F.log1p(n_words),
        n_chars / n_words / 10,
        F.least(F.lit(1.0), _share(text, SYMBOLS, n_words)),
        F.least(F.lit(1.0), _share(text, "|", n_words)),
        F.least(F.lit(1.0), _share(text, "!", n_words)),
        F.size(F.filter(lines, lambda x: (F.length(x) >= 8) & ~x.rlike("\\p{Ll}"))) / F.size(lines),
        1 - F.size(F.array_distinct(lines)) / F.size(lines),
        F.log1p(F.size(F.array_distinct(words)).cast("double")) / F.log1p(n_words),
    ]


def buckets(text: Column) -> Column:
    """The bucket of each word of a text, from 1; words differ by case no more than letters do."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(BUCKETS)) + 1).cast("int"))


@dataclass
class Logistic:
    """A fitted model; also the share of good labels."""

    weights: list[float]
    bias: float
    rate: float

    def logit(self, features: Column, words: Column | None = None) -> Column:
        """Of counts, and of the buckets of words, which count by their share."""
        out = sum((features[i] * w for i, w in enumerate(self.weights[: len(FEATURES)])), F.lit(self.bias))
        own = self.weights[len(FEATURES) :]
        if words is None or not any(own):
            return out
        table = F.array(*[F.lit(w) for w in own])
        return out + F.aggregate(words, F.lit(0.0), lambda a, b: a + F.get(table, b - 1)) / F.greatest(F.size(words), F.lit(1))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
    """Ridge logistic regression by Newton's method; columns past the counts are shares of words."""
    if not len(y):
        return Logistic([0.0] * len(FEATURES), 0.0, 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), np.where(scale > 1e-6, (x - mean) / scale, 0)])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 1e-3
    penalty[1 + len(FEATURES) :] = ridge * WORD_RIDGE
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slopes = np.where(scale > 1e-6, w[1:] / scale, 0)
    return Logistic([float(v) for v in slopes], float(w[0] - slopes @ mean), float(y.mean()))


def _sampled(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(counts and shares of words, labels) of a bounded sample of rows with x, b, y; words are counted before they come here."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))
            table = np.bincount(row * BUCKETS + words.flatten().to_numpy() - 1, minlength=batch.num_rows * BUCKETS).reshape(-1, BUCKETS)
            shares = (table / np.maximum(1, table.sum(1, keepdims=True))).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in shares], pa.binary()), batch.column(2)], ["x", "shares", "y"])

    rows = sample.select("x", "b", "y").mapInArrow(count, "x array<double>, shares binary, y double").collect()
    counts = np.array([r["x"] for r in rows], np.float64).reshape(-1, len(FEATURES))
    shares = np.frombuffer(b"".join(bytes(r["shares"]) for r in rows), "<f4").reshape(-1, BUCKETS)
    return np.column_stack([counts, shares.astype(np.float64)]), np.array([r["y"] for r in rows])


def _strength(sites: DataFrame, mean: float) -> float:
    """The prior's weight in documents, from the spread of site means beyond what their sizes explain."""
    r = sites.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("between"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    within = mean * (1 - mean)
    if not r["n"] or r["k"] < 2 or within <= 0:
        return 10.0
    spread = (r["between"] - (r["k"] - 1) * within) / max(1.0, r["n"] - r["n2"] / r["n"])
    return float(np.clip(within / max(spread, 1e-9) - 1, 5.0, 1000.0))


def site_quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, doc_score, host_score, path_score, quality_score, kept.

    host, path: columns of docs; source and lang unless given. row_col: numbers of the rows, which come back as row.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    row = [F.col(row_col).alias("row")] if row_col else []
    text = F.col(text_col)
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    n_known = known.count()
    chosen = staged(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_rows / max(1, n_known)))), "labelled")
    sample = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).join(F.broadcast(chosen), "doc_id")
    sample = sample.select(F.array(*text_features(F.col("t"))).alias("x"), buckets(F.col("t")).alias("b"), "y")
    model = fit(*_sampled(sample))

    rows = docs.select(F.col(id_col).alias("doc_id"), *row, host.cast("string").alias("h"), path.cast("string").alias("p"), model.logit(F.array(*text_features(text)), buckets(text)).alias("logit"))
    row = ["row"] if row_col else []
    rows = staged(rows.select("doc_id", *row, key_of("h").alias("host"), F.concat_ws("\u0000", key_of("h"), key_of("p")).alias("path"), "logit", (1 / (1 + F.exp(-F.col("logit")))).alias("score")), "evidence")
    paths = staged(rows.groupBy("host", "path").agg(F.sum("score").alias("s"), F.count("*").alias("n")), "paths")
    hosts = staged(paths.groupBy("host").agg(F.sum("s").alias("host_s"), F.sum("n").alias("host_n"), F.count("*").alias("n_paths")), "hosts")
    total = hosts.agg(F.sum("host_s").alias("s"), F.sum("host_n").alias("n"), F.sum("n_paths").alias("k")).first()
    mean = (total["s"] or 0.0) / (total["n"] or 1)
    a, b = _strength(hosts.select(F.col("host_s").alias("s"), F.col("host_n").alias("n")), mean), _strength(paths, mean)
    paths = join_counted(paths, hosts, ["host"], "n_paths", int(total["k"] or 0))
    paths = paths.select("path", F.col("s").alias("path_s"), F.col("n").alias("path_n"), "host_s", "host_n", "n")
    out = join_counted(rows.drop("host"), paths, ["path"], "n", int(total["n"] or 0))

    def posteriors(score: Column | float, one: int) -> tuple[Column, Column]:
        """Of host and path, with a document of this score left out if one is 1."""
        above = (F.col("host_s") - score + a * mean) / (F.col("host_n") - one + a)
        return above, (F.col("path_s") - score + b * above) / (F.col("path_n") - one + b)

    host_score, path_score = posteriors(F.lit(0.0), 0)
    odds = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    out = out.withColumn("others", posteriors(F.col("score"), 1)[1])
    out = out.withColumn("quality_score", 1 / (1 + F.exp(-(F.col("logit") + odds(F.col("others")) - odds(F.lit(mean))))))
    return out.select("doc_id", F.col("score").alias("doc_score"), host_score.alias("host_score"), path_score.alias("path_score"), "quality_score", (F.col("quality_score") >= threshold).alias("kept"), *row)


def good_documents(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """The rows that are not rejected, columns as they came; repeated and null doc_ids are rows like any other."""
    rows, no = numbered(docs)
    mark = len(made_since(0))
    gone = kept_only(site_quality(rows, labels, row_col=no, **options).filter(~F.col("kept")).select(F.col("row").alias(no)), "gone", mark)
    return rows.join(gone, no, "left_anti").select(docs.columns)
