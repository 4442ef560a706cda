"""Facts (subject, predicate, object) and entities as two tables.

entities: entity_id, entity_type, name, source_paper, seq. facts: fact_id, subject_id, predicate, object_id, source_paper,
confidence, is_inferred, seq. seq gives the order that "first" goes by; counts come from live rows only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import EXTRACT_CAUSAL, EXTRACT_CONTRADICTION, EXTRACT_EXTENSION, PREDICATES
from ..functions.text import sentences, strip
from .tools import named_in

#: Patterns of pattern-based extraction, each with the type it finds and what is put before the name.
ENTITY_PATTERNS = (
    ("METHOD", "(?i)\\b(CNN|RNN|LSTM|GRU|BERT|GPT|Transformer|ResNet|VGG|GAN)\\b"),
    ("METHOD", "(?i)\\b([A-Z][a-z]*(?:Net|Model|Network))\\b"),
    ("METHOD", "(?i)\\b(random forest|decision tree|support vector machine|neural network)\\b"),
    ("DATASET", "(?i)\\b(ImageNet|CIFAR-\\d+|MNIST|COCO|BraTS|GLUE|SQuAD|WikiText)\\b"),
    ("METRIC", "(?i)\\b(accuracy|precision|recall|F1[- ]score|AUC|ROC|Dice|IoU|BLEU|ROUGE)\\b"),
    ("FINDING", "(?i)(?:achiev|obtain|reach|report)(?:es|ed|ing)?\\s+(?:an?\\s+)?(\\d+\\.?\\d*\\s*%)", "Result: "),
)


def _all(conditions: list[Column | None]) -> Column:
    return reduce(Column.__and__, [c for c in conditions if c is not None], F.lit(True))


def find_entities(entities: DataFrame, entity_type: str | None = None, name: str | None = None, paper: str | None = None) -> DataFrame:
    return entities.filter(_all([F.col("entity_type") == entity_type if entity_type else None, F.lower("name").contains(name.lower()) if name else None, F.col("source_paper") == paper if paper else None]))


def query_facts(facts: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None, paper: str | None = None, min_confidence: float = 0.0, include_inferred: bool = True) -> DataFrame:
    """The facts of a pattern; what is None, and a predicate that isn't known, sets no condition."""
    if predicate not in PREDICATES:
        predicate = None
    conditions = [F.col(c) == v if v is not None else None for c, v in (("subject_id", subject), ("predicate", predicate), ("object_id", obj), ("source_paper", paper))]
    conditions.append(F.col("confidence") >= min_confidence if min_confidence else None)
    conditions.append(None if include_inferred else ~F.col("is_inferred"))
    return facts.filter(_all(conditions))


def triples(facts: DataFrame) -> DataFrame:
    return facts.select("subject_id", "predicate", "object_id")


def labelled(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """facts with names and types of both ends; the id and CONCEPT stand in for unknown ones."""
    out = facts
    for side in ("subject", "object"):
        e = entities.select(F.col("entity_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("entity_type").alias(f"{side}_type"))
        out = out.join(e, f"{side}_id", "left").withColumn(f"{side}_name", F.coalesce(f"{side}_name", f"{side}_id")).withColumn(f"{side}_type", F.coalesce(f"{side}_type", F.lit("CONCEPT")))
    return out


def contradictions(facts: DataFrame) -> DataFrame:
    """Per CONTRADICTS fact, the first fact of its subject and the first of its object; both must exist."""
    c = facts.filter("predicate = 'CONTRADICTS'").select("fact_id", "subject_id", "object_id")
    ends = c.select(F.col("subject_id").alias("s")).union(c.select("object_id")).distinct()
    first = facts.join(ends, facts["subject_id"] == ends["s"], "left_semi").groupBy(F.col("subject_id").alias("s")).agg(F.min(F.struct("seq", "fact_id"))["fact_id"].alias("f"))
    a, b = first.select(F.col("s").alias("subject_id"), F.col("f").alias("fact_a")), first.select(F.col("s").alias("object_id"), F.col("f").alias("fact_b"))
    return c.join(a, "subject_id").join(b, "object_id").select("fact_id", "fact_a", "fact_b")


def statistics(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """kind, key, n: totals, entities by type, facts by predicate, inferred facts, papers."""
    f = facts.agg(F.count("*").alias("facts"), F.count_if("is_inferred").alias("inferred_facts"), F.countDistinct("source_paper").alias("papers"))
    total = f.select(F.explode(F.array(*[F.struct(F.lit("total").alias("kind"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in f.columns])).alias("s")).select("s.*")
    n = entities.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("entities").alias("key"), "n")
    return total.union(n).union(entities.groupBy("entity_type").count().select(F.lit("entity_type"), "entity_type", "count")).union(facts.groupBy("predicate").count().select(F.lit("predicate"), "predicate", "count"))


def dedup_entities(entities: DataFrame) -> DataFrame:
    """entities with survivor_id: the first of the same lower-case name and type."""
    w = Window.partitionBy(F.lower("name"), "entity_type").orderBy("seq", "entity_id")
    return entities.withColumn("survivor_id", F.first("entity_id").over(w))


def resolve_names(names: DataFrame, entities: DataFrame, name: str = "mention") -> DataFrame:
    """names with entity_id: the first of the same lower-case name, else the first where one name holds the other.

    Both are equi-joins of any size: names that hold one another are joined by their first characters, then compared.
    """
    asked = names.select(name).distinct()
    first = entities.groupBy(F.lower("name").alias("low")).agg(F.min(F.struct("seq", "entity_id"))["entity_id"].alias("entity_id"))
    exact = asked.join(first, F.lower(name) == F.col("low"), "left").select(name, "entity_id")
    open_names = exact.filter("entity_id is null").select(name)
    e = entities.select(F.col("entity_id").alias("key"), "name", "seq")
    asks, answers = open_names.select(F.col(name).alias("id"), F.col(name).alias("text")), e.select("key", "name")
    inside = named_in(asks, answers).select(F.col("id").alias(name), F.col("key").alias("found"))
    around = named_in(e.select(F.col("key").alias("id"), F.col("name").alias("text")), open_names.select(F.col(name).alias("key"), F.col(name).alias("name"))).select(F.col("key").alias(name), F.col("id").alias("found"))
    near = inside.union(around).join(e.select(F.col("key").alias("found"), "seq"), "found").groupBy(name).agg(F.min(F.struct("seq", "found"))["found"].alias("near"))
    return names.join(exact.join(near, name, "left").select(name, F.coalesce("entity_id", "near").alias("entity_id")), name, "left")


def entities_in(text: Column, patterns: tuple[tuple[str, ...], ...] = ENTITY_PATTERNS) -> Column:
    """All matches as an array of (entity_type, name), pattern by pattern; methods of one or two characters are left out."""

    def hits(kind: str, pattern: str, before: str = "") -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("entity_type"), F.concat(F.lit(before), strip(x)).alias("name")))

    return F.filter(F.concat(*[hits(*p) for p in patterns]), lambda x: (F.length(x["name"]) > 2) | (x["entity_type"] != "METHOD"))


def pattern_entities(docs: DataFrame, patterns: tuple[tuple[str, ...], ...] = ENTITY_PATTERNS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, entity_type, name (first spelling), each once per document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(entities_in(F.col(text_col), patterns)).alias("at", "e"))
    return rows.groupBy("doc_id", F.col("e.entity_type").alias("entity_type"), F.lower("e.name").alias("low")).agg(F.min(F.struct("at", "e.name"))["name"].alias("name")).drop("low")


def mentions(texts: DataFrame, entities: DataFrame, text_col: str = "sentence", most: int = 2_000) -> DataFrame:
    """texts with found, an array of the entities named in them, in entity order.

    Up to most entities are broadcast and looked for in each text; more are joined with distinct texts by their names' first characters.
    """
    e = entities.select("seq", "entity_id", "entity_type", F.lower("name").alias("low"))
    if e.limit(most + 1).count() <= most:
        dim = e.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("dim"))
        found = F.filter("dim", lambda x: F.lower(text_col).contains(x["low"]))
        return texts.crossJoin(F.broadcast(dim)).withColumn("found", found).drop("dim")  # one row
    rows = texts.withColumn("text_key", F.sha2(F.lower(text_col), 256))
    hits = named_in(rows.select(F.col("text_key").alias("id"), F.col(text_col).alias("text")).dropDuplicates(["id"]), e.select(F.col("entity_id").alias("key"), F.col("low").alias("name")))
    own = hits.join(e.withColumnRenamed("entity_id", "key"), "key").groupBy(F.col("id").alias("text_key")).agg(F.sort_array(F.collect_list(F.struct("seq", F.col("key").alias("entity_id"), "entity_type", "low"))).alias("found"))
    out = rows.join(own, "text_key", "left").drop("text_key")
    return out.withColumn("found", F.coalesce("found", F.array().cast(own.schema["found"].dataType)))


def _first_marker(text: Column, markers: tuple[str, ...]) -> Column:
    return F.get(F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.lower(text).contains(m)), F.lit(0))


def pattern_relations(docs: DataFrame, entities: DataFrame, causal: tuple[str, ...] = EXTRACT_CAUSAL, contradiction: tuple[str, ...] = EXTRACT_CONTRADICTION, extension: tuple[str, ...] = EXTRACT_EXTENSION, improving: tuple[str, ...] = ("improves", "enhances", "increases"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Facts from sentences with a marker and two entities: doc_id, sentence_no, subject_id, predicate, object_id, confidence, marker, evidence.

    The first marker of a list wins. Causal and extending sentences relate the first two entities, contradicting ones the first two findings.
    """
    s = marked_sentences(docs.select(F.col(id_col).alias("doc_id"), F.posexplode(sentences(F.col(text_col))).alias("sentence_no", "sentence")), causal, contradiction, extension)
    return sentence_facts(mentions(s, entities), improving).select("doc_id", "sentence_no", "f.*", "evidence")


def marked_sentences(rows: DataFrame, causal: tuple[str, ...], contradiction: tuple[str, ...], extension: tuple[str, ...]) -> DataFrame:
    """rows whose sentence has a marker, with the first one of each list."""
    lists = (("causal", causal), ("contra", contradiction), ("ext", extension))
    return rows.select("*", *[_first_marker(F.col("sentence"), m).alias(n) for n, m in lists]).filter("causal is not null or contra is not null or ext is not null")


def sentence_facts(rows: DataFrame, improving: tuple[str, ...]) -> DataFrame:
    """A row per fact f of rows (sentence, its markers and found, its entities in order), with the sentence's beginning as evidence."""
    s = rows.withColumn("findings", F.filter("found", lambda e: e["entity_type"] == "FINDING"))

    def fact(marker: str, of: str, predicate: Column, confidence: float) -> Column:
        made = F.struct(F.get(of, F.lit(0))["entity_id"].alias("subject_id"), predicate.alias("predicate"), F.get(of, F.lit(1))["entity_id"].alias("object_id"), F.lit(confidence).alias("confidence"), F.col(marker).alias("marker"))
        return F.when(F.col(marker).isNotNull() & (F.size(of) >= 2), made)

    better = F.when(F.col("causal").isin(*improving), "IMPROVES").otherwise("APPLIES_TO")
    facts = F.array(fact("causal", "found", better, 0.6), fact("contra", "findings", F.lit("CONTRADICTS"), 0.5), fact("ext", "found", F.lit("EXTENDS"), 0.6))
    return s.select("*", F.explode(F.array_compact(facts)).alias("f"), F.substring("sentence", 1, 100).alias("evidence"))


def cooccurrence(members: DataFrame, group: str, item: str, order: str, most: int = 20) -> DataFrame:
    """group, a, b: pairs of the first most distinct items of each group, in order. Never more than most * (most - 1) / 2 a group."""
    first = members.groupBy(group, item).agg(F.min(order).alias("o"))
    few = first.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("o", item))).filter(F.col("r") <= most)
    lists = few.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", item))), lambda x: x[item]).alias("l"))
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.lit(most)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return lists.select(group, F.explode(pairs).alias("p")).select(group, "p.a", "p.b")


def upsert(facts: DataFrame, new: DataFrame, key: str = "fact_id") -> DataFrame:
    """facts with new ones added, those of the same key replaced."""
    return facts.join(new.select(key), key, "left_anti").unionByName(new)


def remove(facts: DataFrame, ids: DataFrame, key: str = "fact_id") -> DataFrame:
    return facts.join(ids.select(key), key, "left_anti")
