"""Relation classification in layers: similarity, markers in relevant sentences, optional NLI score, support in the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import CLASSIFY_CAUSAL, CLASSIFY_CONTRADICTION, CLASSIFY_EXTENSION
from ..functions.text import sentences, strip


def relevant_sentences(text: Column, a: Column, b: Column, most: int = 5) -> Column:
    """Sentences that name both; else the first that names either, with its neighbours."""
    s = sentences(text, 0)
    has = lambda x, n: F.lower(x).contains(F.lower(n))
    both = F.filter(s, lambda x: has(x, a) & has(x, b))
    hit = F.array_position(F.transform(s, lambda x: has(x, a) | has(x, b)), True)
    near = F.when(hit > 0, F.slice(s, F.greatest(F.lit(1), hit - 1).cast("int"), F.when(hit > 1, 3).otherwise(2))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.when(F.size(both) > 0, both).otherwise(near), 1, most)


def classify(pairs: DataFrame, facts: DataFrame, causal: tuple[str, ...] = CLASSIFY_CAUSAL, contradiction: tuple[str, ...] = CLASSIFY_CONTRADICTION, extension: tuple[str, ...] = CLASSIFY_EXTENSION, threshold: float = 0.3, nli_threshold: float = 0.5) -> DataFrame:
    """pairs (pair_id, entity_a, entity_b, text_context, similarity, nli_score) with relation, confidence, markers, evidence, valid."""
    df = pairs.withColumn("similarity", F.coalesce("similarity", F.lit(0.5))).withColumn("ev", F.substring(F.array_join(relevant_sentences(F.col("text_context"), F.col("entity_a"), F.col("entity_b")), " "), 1, 500))
    hits = lambda ms: F.filter(F.array(*[F.lit(m) for m in ms]), lambda m: F.lower(F.col("ev")).contains(m))
    df = df.select("*", hits(contradiction).alias("m1"), hits(causal).alias("m2"), hits(extension).alias("m3"))
    some = lambda c: F.size(c) > 0
    df = df.withColumn("relation", F.when(some("m1"), "CONTRADICTION").when(some("m2"), "CAUSAL").when(some("m3"), "EXTENSION").otherwise("CO_OCCURRENCE"))
    df = df.withColumn("markers", F.when(some("m1"), F.col("m1")).when(some("m2"), F.col("m2")).when(some("m3"), F.col("m3")).otherwise(F.array().cast("array<string>")))
    nli = F.coalesce(F.col("nli_score") >= nli_threshold, F.lit(False))
    df = df.withColumn("markers", F.when(nli, F.concat("markers", F.array(F.lit("nli_model")))).otherwise(F.col("markers"))).withColumn("relation", F.when(nli, "CONTRADICTION").otherwise(F.col("relation")))
    known = facts.select(F.least("subject_id", "object_id").alias("lo"), F.greatest("subject_id", "object_id").alias("hi")).distinct().withColumn("linked", F.lit(True))
    df = df.join(known, (F.least("entity_a", "entity_b") == F.col("lo")) & (F.greatest("entity_a", "entity_b") == F.col("hi")), "left")
    df = df.withColumn("valid", (F.col("relation") != "CAUSAL") | F.coalesce("linked", F.lit(False)))
    sure = F.least(F.lit(1.0), F.col("similarity") * 0.3 + F.least(F.size("markers") * 0.1, F.lit(0.4)) + F.when(F.col("valid"), 0.3).otherwise(0.0))
    low = F.col("similarity") < threshold
    conf = F.when(low, F.col("similarity")).when(F.col("relation") == "CO_OCCURRENCE", F.least(F.col("similarity") * 0.5, F.lit(0.5))).otherwise(sure)
    return df.select("pair_id", "entity_a", "entity_b", F.when(low, "UNKNOWN").otherwise(F.col("relation")).alias("relation"), conf.alias("confidence"), "markers", F.col("ev").alias("evidence"), "valid")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def nli_contradiction(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of logits both ways (contradiction first), the larger contradiction score: pair_id, score, contradicts, direction."""
    f, b = F.get(softmax(F.col("forward")), F.lit(0)), F.get(softmax(F.col("backward")), F.lit(0))
    return scores.select("pair_id", F.greatest(f, b).alias("score"), (F.greatest(f, b) >= threshold).alias("contradicts"), F.when(f >= b, "forward").otherwise("backward").alias("direction"))


def claim_pairs(papers: DataFrame, topic: str = "topic", seq: str = "seq", most: int = 6, width: int = 300) -> DataFrame:
    """topic, pair_id, paper_a, paper_b, claim_a, claim_b: each two of a topic's first most papers (paper_id, title, content), once.

    A claim is the title and the beginning of the content. At most most * (most - 1) / 2 pairs a topic.
    """
    text = strip(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.substring(F.coalesce("content", F.lit("")), 1, width)))
    first = papers.select(F.col(topic).alias("topic"), F.col("paper_id").cast("string").alias("id"), F.row_number().over(Window.partitionBy(topic).orderBy(seq, "paper_id")).alias("r"), text.alias("claim")).filter(F.col("r") <= most)
    lists = first.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("r", "id", "claim"))).alias("l"))
    pairs = F.flatten(F.transform("l", lambda a, i: F.transform(F.slice("l", i + 2, F.lit(most)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    out = lists.select("topic", F.explode(pairs).alias("p"))
    key = lambda p: F.concat_ws("|", F.least(p["a"]["id"], p["b"]["id"]), F.greatest(p["a"]["id"], p["b"]["id"]))
    once = out.withColumn("pair_id", key(F.col("p"))).withColumn("k", F.row_number().over(Window.partitionBy("topic", "pair_id").orderBy("p.a.r", "p.b.r"))).filter("k = 1")
    return once.select("topic", "pair_id", F.col("p.a.id").alias("paper_a"), F.col("p.b.id").alias("paper_b"), F.col("p.a.claim").alias("claim_a"), F.col("p.b.claim").alias("claim_b"))


def contradiction_indicators(pairs: DataFrame, scores: DataFrame, answers: DataFrame | None = None, width: int = 160) -> DataFrame:
    """topic, detection_method, confidence, related_papers, evidence of pairs that scores (pair_id, score, contradicts) says contradict.

    For a topic without one, answers (topic, answer) of a language model counts with 0.4 unless it says there is no contradiction.
    """
    told = pairs.join(scores.filter("contradicts").select("pair_id", "score").dropDuplicates(["pair_id"]), "pair_id")
    evidence = F.array(F.concat(F.lit("Paper A: "), F.substring("claim_a", 1, width)), F.concat(F.lit("Paper B: "), F.substring("claim_b", 1, width)))
    found = told.select("topic", F.lit("nli_cross_encoder").alias("detection_method"), F.round("score", 3).alias("confidence"), F.array("paper_a", "paper_b").alias("related_papers"), evidence.alias("evidence"))
    if answers is None:
        return found
    silent = answers.filter(F.coalesce("answer", F.lit("")) != "").filter(~F.lower("answer").contains("no contradiction")).join(found.select("topic").distinct(), "topic", "left_anti")
    said = silent.select("topic", F.lit("llm_nli").alias("detection_method"), F.lit(0.4).alias("confidence"), F.array().cast("array<string>").alias("related_papers"), F.array(F.substring("answer", 1, 500)).alias("evidence"))
    return found.unionByName(said)
