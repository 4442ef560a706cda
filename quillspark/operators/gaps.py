"""Gap indicators: fragmentation, inconsistency, incompleteness, monoculture."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import APPROACH_TERMS, ASPECT_TERMS
from ..session import checkpointed
from .rules import claim_verdicts, rule_results
from .tools import isolation

#: Papers of one topic that greedy clustering takes: it is sequential by definition.
MOST_PAPERS = 50_000


def terms_in(text: Column, terms: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.lower(text).contains(t))


def approaches(papers: DataFrame, terms: tuple[str, ...] = APPROACH_TERMS) -> DataFrame:
    """papers with approaches: keywords and the terms their content holds, lower case, each once."""
    own = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.lower(k))
    return papers.withColumn("approaches", F.array_distinct(F.concat(own, terms_in(F.coalesce("content", F.lit("")), terms))))


def jaccard_pairs(sets: DataFrame, id_col: str, set_col: str, above: float = 0.3) -> DataFrame:
    """a, b, jaccard of id pairs a < b above a similarity: an inverted index, so only pairs that share a member meet."""
    rows = sets.select(F.col(id_col).alias("id"), F.array_distinct(set_col).alias("s")).withColumn("n", F.size("s"))
    items = rows.select("id", "n", F.explode("s").alias("x"))
    shared = items.alias("p").join(items.alias("q"), (F.col("p.x") == F.col("q.x")) & (F.col("p.id") < F.col("q.id"))).groupBy(F.col("p.id").alias("a"), F.col("q.id").alias("b")).agg(F.count("*").alias("both"), F.first("p.n").alias("na"), F.first("q.n").alias("nb"))
    j = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return shared.select("a", "b", j.alias("jaccard")).filter(F.col("jaccard") > above)


def greedy_clusters(papers: DataFrame, topic: str, id_col: str, set_col: str, seq: str, above: float = 0.3, most: int | None = None) -> DataFrame:
    """topic, id, cluster_id: in order, a paper opens a cluster and takes the free ones similar to it (not to its members).

    most: clusters a topic; what is left then goes round the clusters. Topics are spread over tasks; one topic is one task,
    whose size is checked.
    """
    rows = papers.select(F.col(topic).alias("topic"), F.col(id_col).cast("string").alias("id"), F.col(set_col).alias("s"), F.col(seq).alias("seq"))

    def cluster(df: pd.DataFrame) -> pd.DataFrame:
        if len(df) > MOST_PAPERS:
            raise ValueError(f"a topic of {len(df)} papers; greedy clustering takes {MOST_PAPERS}")
        df = df.sort_values(["seq", "id"], kind="stable", ignore_index=True)
        sets, label, n = [set(x) for x in df["s"]], [-1] * len(df), 0
        for i, a in enumerate(sets):
            if label[i] >= 0 or (most is not None and n >= most):
                continue
            label[i] = n
            for j in range(i + 1, len(sets)):
                if label[j] < 0 and a | sets[j] and len(a & sets[j]) / len(a | sets[j]) > above:
                    label[j] = n
            n += 1
        rest = 0
        for i, x in enumerate(label):
            if x < 0:
                label[i], rest = rest % max(1, n), rest + 1
        return pd.DataFrame({"topic": df["topic"], "id": df["id"], "cluster_id": label})

    return rows.groupBy("topic").applyInPandas(cluster, rows.select("topic").schema.add("id", T.StringType()).add("cluster_id", T.IntegerType()))


def fragmentation(clustered: DataFrame) -> DataFrame:
    """topic, n_clusters, separation, confidence, from topic, id, cluster_id, approaches; topics of two clusters or more. Isolation is an indicator of its own.

    Separation is the mean Jaccard distance of cluster sets, 0.5 without a pair to compare.
    """
    per = clustered.groupBy("topic", "cluster_id").agg(F.array_distinct(F.flatten(F.collect_list("approaches"))).alias("s"), F.count("*").alias("papers"))
    a, b = per.alias("a"), per.alias("b")
    both, either = F.size(F.array_intersect("a.s", "b.s")), F.size(F.array_union("a.s", "b.s"))
    pairs = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (F.col("a.cluster_id") < F.col("b.cluster_id"))).filter(either > 0)
    sep = pairs.groupBy(F.col("a.topic").alias("topic")).agg(F.avg(1 - both / either).alias("separation"))
    g = per.groupBy("topic").agg(F.count("*").alias("n_clusters"), F.sum("papers").alias("papers")).filter("n_clusters >= 2").join(sep, "topic", "left").withColumn("separation", F.coalesce("separation", F.lit(0.5)))
    breadth = F.least(F.lit(1.0), F.col("n_clusters") / F.greatest(F.col("papers"), F.lit(1)))
    return g.withColumn("confidence", F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.9), 0.35 + 0.4 * F.col("separation") + 0.15 * breadth)), 3))


def incompleteness(papers: DataFrame, expected: DataFrame, topic: str = "topic", terms: tuple[str, ...] = ASPECT_TERMS) -> DataFrame:
    """topic, missing (sorted), n_expected, n_grounded, confidence: expected aspects that no paper covers, and how many of those the corpus mentions at all."""
    rows = papers.select(F.col(topic).alias("topic"), F.lower(F.coalesce("content", F.lit(""))).alias("c"), F.coalesce("keywords", F.array().cast("array<string>")).alias("k"))
    covered = rows.select("topic", F.explode(F.concat(F.transform("k", lambda x: F.lower(x)), terms_in(F.col("c"), terms))).alias("aspect")).distinct()
    asked = expected.select("topic", F.lower("aspect").alias("aspect")).distinct()
    open_aspects = asked.join(covered, ["topic", "aspect"], "left_anti")
    words = open_aspects.select("topic", "aspect", F.explode(F.filter(F.regexp_extract_all("aspect", F.lit("([a-z]+)")), lambda w: F.length(w) > 3)).alias("w"))
    said = rows.join(words, "topic").filter(F.col("c").contains(F.col("w"))).select("topic", "aspect").distinct().withColumn("grounded", F.lit(1))
    g = open_aspects.join(said, ["topic", "aspect"], "left").groupBy("topic").agg(F.array_join(F.sort_array(F.collect_list("aspect")), ",").alias("missing"), F.count("*").alias("n_missing"), F.sum(F.coalesce("grounded", F.lit(0))).alias("n_grounded"))
    out = g.join(asked.groupBy("topic").agg(F.count("*").alias("n_expected")), "topic")
    gap, ground = F.col("n_missing") / F.col("n_expected"), F.col("n_grounded") / F.col("n_missing")
    return out.withColumn("confidence", F.least(F.lit(0.85), F.round((0.3 + 0.6 * gap) * (0.6 + 0.4 * ground), 3)))


def monoculture(papers: DataFrame, terms: tuple[str, ...], topic: str = "topic") -> DataFrame:
    """topic, papers, methods, confidence of topics of three papers or more that share at most one method term."""
    rows = papers.select(F.col(topic).alias("topic"), terms_in(F.coalesce("content", F.lit("")), terms).alias("m"))
    methods = rows.select("topic", F.explode("m").alias("x")).groupBy("topic").agg(F.countDistinct("x").alias("methods"))
    g = rows.groupBy("topic").agg(F.count("*").alias("papers")).join(methods, "topic", "left").withColumn("methods", F.coalesce("methods", F.lit(0)))
    return g.filter("papers >= 3 and methods <= 1").withColumn("confidence", F.round(0.4 + 0.4 * F.least(F.lit(1.0), F.col("papers") / 5), 6))


def inconsistency(facts: DataFrame, entities: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """fact_id, description, confidence (0.5 at most) of contradictions between findings named in three words or more; with relations
    (pair_id = fact_id), only those that the classifier agrees with."""
    f = facts.filter("predicate = 'CONTRADICTS'").select("fact_id", "subject_id", "object_id", "confidence")
    e = entities.filter("entity_type = 'FINDING'").filter(F.size(F.split(F.trim("name"), "\\s+")) >= 3)
    a, b = e.select(F.col("entity_id").alias("subject_id"), F.col("name").alias("na")), e.select(F.col("entity_id").alias("object_id"), F.col("name").alias("nb"))
    out = f.join(a, "subject_id").join(b, "object_id")
    if relations is not None:
        out = out.join(relations.filter("relation = 'CONTRADICTION'").select(F.col("pair_id").alias("fact_id")), "fact_id", "left_semi")
    return out.select("fact_id", F.concat(F.col("na"), F.lit(" vs "), F.col("nb")).alias("description"), F.least(F.lit(0.5), F.col("confidence")).alias("confidence"))


def link_entities(indicators: DataFrame, entities: DataFrame) -> DataFrame:
    """indicator_id, method, domain (the first of their papers), findings (all), from indicator_id, papers."""
    e = indicators.select("indicator_id", F.explode("papers").alias("source_paper")).join(entities, "source_paper")
    first = lambda t: F.min(F.when(F.col("entity_type") == t, F.struct("seq", "entity_id")))["entity_id"]
    return e.groupBy("indicator_id").agg(first("METHOD").alias("method"), first("DOMAIN").alias("domain"), F.transform(F.sort_array(F.collect_set(F.when(F.col("entity_type") == "FINDING", F.struct("seq", "entity_id")))), lambda x: x["entity_id"]).alias("findings"))


def ranked(indicators: DataFrame) -> DataFrame:
    """Indicators that weren't rejected, by confidence within the topic: adds rank and indicator_id topic-NN by seq."""
    out = indicators.filter("verdict <> 'REJECT'")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("confidence"), "seq"))).withColumn("indicator_id", F.format_string("%s-%02d", "topic", F.row_number().over(Window.partitionBy("topic").orderBy("seq"))))


def fuzzy_contains(texts: DataFrame, needle: str, text: str, least: float = 0.82) -> DataFrame:
    """texts with fuzzy: the best ratio of needle against windows of text at steps of half its length, 1 where it is contained."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def best(n: pd.Series, t: pd.Series) -> pd.Series:
        def one(a: str | None, b: str | None) -> float:
            a, b = (a or "").lower().strip(), (b or "").lower()
            top = 0.0
            for at in range(0, max(1, len(b) - len(a) + 1), max(1, len(a) // 2)) if a else ():
                top = max(top, SequenceMatcher(None, a, b[at : at + len(a)]).ratio())
                if top >= 0.97:
                    break
            return top

        return pd.Series([one(a, b) for a, b in zip(n, t, strict=True)])

    there = F.lower(F.col(text)).contains(F.lower(F.trim(F.col(needle))))
    return texts.withColumn("fuzzy", F.when(there, 1.0).otherwise(best(F.col(needle), F.col(text)))).withColumn("explicit", F.col("fuzzy") >= least)


def with_rules(indicators: DataFrame, facts: DataFrame, entities: DataFrame, **options: object) -> DataFrame:
    """Indicators (indicator_id, description, confidence, papers) judged by the rules: adds verdict and adjusted_confidence, which becomes the confidence."""
    linked = indicators.join(link_entities(indicators, entities), "indicator_id", "left")
    claims = linked.select(F.col("indicator_id").alias("claim_id"), "description", "method", "domain", "findings", "confidence")
    found = claim_verdicts(claims, rule_results(claims, facts, entities, **options))
    return indicators.join(found.select(F.col("claim_id").alias("indicator_id"), "verdict", F.col("confidence").alias("adjusted_confidence")), "indicator_id").withColumn("raw_confidence", F.col("confidence")).withColumn("confidence", F.col("adjusted_confidence"))


def analyze_gaps(papers: DataFrame, expected: DataFrame, facts: DataFrame, entities: DataFrame, edges: DataFrame | None = None, depth: str = "standard", terms: tuple[str, ...] = APPROACH_TERMS, aspects: tuple[str, ...] = ASPECT_TERMS, rules: bool = True, **options: object) -> DataFrame:
    """All indicators of all topics: fragmentation, isolation (with edges), inconsistency (not if depth is quick) and incompleteness.

    papers: topic, paper_id, content, keywords, seq; facts and entities know their source_paper. One row per indicator, in no
    order but rank's: topic, indicator_id, indicator_type, detection_method, description, evidence, directions, papers, confidence,
    verdict, adjusted_confidence, rank within the topic. What the rules reject is left out; without rules the verdict is null.
    """
    text, none = F.col("topic").cast("string"), F.array().cast("array<string>")
    own = papers.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col("paper_id").cast("string").alias("p")))), lambda x: x["p"]).alias("papers"))

    def rows(df: DataFrame, kind: str, method: str, description: Column, evidence: Column, direction: str) -> DataFrame:
        return df.select("topic", F.lit(kind).alias("indicator_type"), F.lit(method).alias("detection_method"), description.alias("description"), evidence.alias("evidence"), F.array(F.lit(direction)).alias("directions"), "papers", F.col("confidence").cast("double").alias("confidence"))

    known = approaches(papers, terms)
    clusters = greedy_clusters(known, "topic", "paper_id", "approaches", "seq")
    split = fragmentation(clusters.join(known.select(F.col("paper_id").cast("string").alias("id"), "approaches"), "id")).drop("papers").join(own, "topic")
    parts = [rows(split, "FRAGMENTATION", "clustering", F.concat(F.lit("Work on "), text, F.format_string(" falls into %d approaches", "n_clusters")), F.array(F.format_string("separation %.2f", "separation")), "Compare the approaches on common ground")]
    if edges is not None:
        apart = isolation(edges, papers, "topic", "paper_id", "seq").filter("isolation > 0.6").select(F.col("by").alias("topic"), F.col("isolation").alias("confidence")).join(own, "topic")
        parts.append(rows(apart, "FRAGMENTATION", "citation_isolation", F.concat(F.lit("Papers on "), text, F.lit(" hardly refer to each other")), F.array(F.format_string("isolation %.2f", "confidence")), "Look for links between the streams"))
    if depth != "quick":
        where = facts.select("fact_id", F.col("source_paper").alias("paper_id")).join(papers.select("topic", F.col("paper_id").cast("string").alias("paper_id")), "paper_id")
        against = inconsistency(facts, entities).join(where, "fact_id").withColumn("papers", F.array("paper_id"))
        parts.append(rows(against, "INCONSISTENCY", "fact_contradiction", F.concat(F.lit("Findings disagree: "), F.col("description")), F.array("fact_id"), "Repeat both under the same conditions"))
    lack = incompleteness(papers, expected, terms=aspects).join(own, "topic")
    parts.append(rows(lack, "INCOMPLETENESS", "coverage", F.concat(F.lit("Not covered in "), text, F.lit(": "), F.col("missing")), F.array(F.format_string("%d of %d expected aspects", "n_missing", "n_expected")), "Study the aspects that are missing"))
    out = union_of(parts).withColumn("indicator_id", F.concat_ws("-", text, F.substring(F.sha2(F.concat_ws("|", "indicator_type", "detection_method", "description", F.array_join("evidence", ",")), 256), 1, 12)))
    if rules:
        out = with_rules(checkpointed(out), facts, entities, **options).filter("verdict <> 'REJECT'")
    else:
        out = out.withColumn("verdict", F.lit(None).cast("string")).withColumn("adjusted_confidence", F.col("confidence"))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("confidence"), "indicator_id"))
    return out.withColumn("rank", rank).select("topic", "indicator_id", "indicator_type", "detection_method", "description", "evidence", "directions", F.coalesce("papers", none).alias("papers"), "confidence", "verdict", "adjusted_confidence", "rank")


def union_of(parts: Iterable[DataFrame]) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out
