"""Papers to entities and facts, from end to end.

A model's answers are columns of JSON: no call is made here. Where a paper has no usable answer, patterns find its
entities; relations that sentences mark are added always. Everything of a paper is worked out in its row, so the only
shuffle is that of its distinct entities.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import EXTRACT_CAUSAL, EXTRACT_CONTRADICTION, EXTRACT_EXTENSION, PREDICATES
from ..functions.text import json_rows, sentences, strip
from ..session import checkpointed
from .facts import ENTITY_PATTERNS, cooccurrence, entities_in, labelled, marked_sentences, sentence_facts

#: The types of entities.
KINDS = ("METHOD", "CONCEPT", "DOMAIN", "FINDING", "DATASET", "METRIC", "PAPER", "CONSTRAINT")
#: Causal markers that say something is better.
IMPROVING = ("improves", "enhances", "increases")

_ENTITY = "struct<name:string,type:string>"
_RELATION = "struct<subject:string,predicate:string,object:string,evidence:string,confidence:string>"


class Extraction(NamedTuple):
    """entities: entity_id, entity_type, name, source_paper, seq, place. facts: fact_id, subject_id, predicate, object_id,
    source_paper, confidence, is_inferred, evidence, extraction_method, seq, place. counts: a row per paper."""

    entities: DataFrame
    facts: DataFrame
    counts: DataFrame


def entity_id(kind: Column, name: Column) -> Column:
    """One id per type and name, whatever the case: the same in every run and on every executor."""
    return F.concat(F.lower(kind), F.lit("_"), F.substring(F.md5(F.lower(name)), 1, 16))


def _named(entities: Column) -> Column:
    """Entities (entity_type, name) with ids, each once, in the order met."""
    made = F.transform(entities, lambda e: F.struct(entity_id(e["entity_type"], e["name"]).alias("entity_id"), e["entity_type"].alias("entity_type"), e["name"].alias("name")))
    ids = F.transform(made, lambda e: e["entity_id"])
    return F.filter(made, lambda e, i: F.array_position(ids, e["entity_id"]) == i + 1)


def _resolved(name: Column, entities: Column) -> Column:
    """The id of the entity of this name, else of the first whose name holds it or is in it; null for no name."""
    low = F.lower(strip(name))
    same = F.get(F.filter(entities, lambda e: F.lower(e["name"]) == low), F.lit(0))
    near = F.get(F.filter(entities, lambda e: F.contains(F.lower(e["name"]), low) | F.contains(low, F.lower(e["name"]))), F.lit(0))
    return F.when(F.coalesce(name, F.lit("")) != "", F.coalesce(same["entity_id"], near["entity_id"]))


def _answered(items: Column, lenient: bool) -> Column:
    """Entities of an answer; one of an unknown type is a concept if lenient, and left out otherwise."""
    kind = lambda x: F.coalesce(x["type"], F.lit("CONCEPT"))
    good = items if lenient else F.filter(items, lambda x: kind(x).isin(*KINDS))
    return F.transform(good, lambda x: F.struct(F.when(kind(x).isin(*KINDS), kind(x)).otherwise("CONCEPT").alias("entity_type"), F.coalesce(x["name"], F.lit("unknown")).alias("name")))


def _stated(relations: Column, entities: Column, method: Column) -> Column:
    """Facts of an answer's relations between known entities; unknown predicates and confidences that are no numbers leave one out."""

    def fact(r: Column) -> Column:
        predicate = F.coalesce(r["predicate"], F.lit("DISCUSSES"))
        sure = F.when(r["confidence"].isNull(), F.lit(0.7)).otherwise(r["confidence"].try_cast("double"))
        made = F.struct(
            _resolved(r["subject"], entities).alias("subject_id"), predicate.alias("predicate"), _resolved(r["object"], entities).alias("object_id"),
            sure.alias("confidence"), F.coalesce(r["evidence"], F.lit("")).alias("evidence"), method.alias("extraction_method"),
        )
        return F.when(predicate.isin(*PREDICATES), made)

    return F.filter(F.transform(relations, fact), lambda f: f["subject_id"].isNotNull() & f["object_id"].isNotNull() & f["confidence"].isNotNull())


def extract(
    papers: DataFrame, combined: str | None = None, entity_answer: str | None = None, relation_answer: str | None = None, width: int | None = 3000,
    patterns: tuple[tuple[str, ...], ...] = ENTITY_PATTERNS, causal: tuple[str, ...] = EXTRACT_CAUSAL, contradiction: tuple[str, ...] = EXTRACT_CONTRADICTION,
    extension: tuple[str, ...] = EXTRACT_EXTENSION, improving: tuple[str, ...] = IMPROVING,
) -> Extraction:
    """Entities and facts of papers (paper_id, seq, title, content).

    combined names a column with an object of entities and relations; where it has no entities, entity_answer and
    relation_answer name columns with an array each; where that has none, patterns are used. width cuts what patterns
    read, as it cuts what a model is asked; None reads all. Papers without content are left out; each other one is an
    entity of its title (Unknown if it has none). An entity belongs to the first paper, by seq, that names it.
    """
    none = lambda kind: F.array().cast(f"array<{kind}>")
    given = lambda c: F.col(c) if c else F.lit(None).cast("string")
    rows = papers.filter(F.coalesce("content", F.lit("")) != "")
    text = F.col("content") if width is None else F.substring("content", 1, width)
    whole = F.from_json(F.when(~F.trim(given(combined)).startswith("["), F.regexp_extract(given(combined), "(?s)(\\{.*\\})", 1)), f"struct<entities:array<{_ENTITY}>,relations:array<{_RELATION}>>")
    solid = lambda a, kind: F.filter(F.coalesce(a, none(kind)), lambda x: x.isNotNull())
    df = rows.select("paper_id", "seq", F.coalesce("title", F.lit("Unknown")).alias("title"), text.alias("text"), whole.alias("w"), json_rows(given(entity_answer), _ENTITY).alias("ea"), json_rows(given(relation_answer), _RELATION).alias("ra"))
    df = df.withColumn("we", solid(F.col("w.entities"), _ENTITY)).withColumn("ea", solid(F.col("ea"), _ENTITY))
    at_once, in_two = F.size("we") > 0, F.size("ea") > 0
    df = df.withColumn("found", F.when(at_once, _answered(F.col("we"), True)).when(in_two, _answered(F.col("ea"), False)).otherwise(entities_in(F.col("text"), patterns)))
    df = df.withColumn("ents", _named(F.col("found")))
    relations = solid(F.when(at_once, F.col("w.relations")).otherwise(F.col("ra")), _RELATION)
    df = df.withColumn("stated", _stated(relations, F.col("ents"), F.when(at_once, F.lit("llm_combined")).otherwise("llm")))
    made = checkpointed(df.select("paper_id", "seq", "title", "text", F.size("found").alias("n_found"), "ents", "stated"))

    named = made.select("paper_id", "seq", F.posexplode(F.concat(F.array(F.struct(entity_id(F.lit("PAPER"), F.col("title")).alias("entity_id"), F.lit("PAPER").alias("entity_type"), F.col("title").alias("name"))), "ents")).alias("place", "e"))
    first = named.groupBy("e.entity_id").agg(F.min(F.struct("seq", F.col("paper_id").alias("source_paper"), "place", F.col("e.entity_type").alias("entity_type"), F.col("e.name").alias("name"))).alias("m"))
    entities = first.select("entity_id", "m.entity_type", "m.name", "m.source_paper", "m.seq", "m.place")

    s = made.filter(F.size("ents") >= 2).select("paper_id", "seq", "ents", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence"))
    s = marked_sentences(s, causal, contradiction, extension)
    s = s.withColumn("found", F.filter("ents", lambda e: F.lower("sentence").contains(F.lower(e["name"])))).drop("ents")
    marked = sentence_facts(s, improving).select("paper_id", "seq", (F.col("sentence_no") * 10).alias("place"), "f.subject_id", "f.predicate", "f.object_id", "f.confidence", "evidence", F.lit("pattern").alias("extraction_method"), "f.marker")
    told = made.select("paper_id", "seq", F.posexplode("stated").alias("i", "f")).select("paper_id", "seq", (F.col("i") - 1_000_000_000).alias("place"), "f.*", F.lit(None).cast("string").alias("marker"))
    facts = told.unionByName(marked)
    key = F.substring(F.md5(F.concat_ws("|", F.col("paper_id").cast("string"), "place", "subject_id", "predicate", "object_id", F.coalesce("marker", F.lit("")))), 1, 16)
    facts = checkpointed(facts.select(key.alias("fact_id"), "subject_id", "predicate", "object_id", F.col("paper_id").alias("source_paper"), "confidence", F.lit(False).alias("is_inferred"), "evidence", "extraction_method", "seq", "place"))

    n = facts.groupBy(F.col("source_paper").alias("paper_id")).agg(F.count("*").alias("total_facts"), F.count_if(F.col("extraction_method") == "pattern").alias("pattern_facts"))
    counts = made.select("paper_id", F.col("n_found").cast("long").alias("entities")).join(n, "paper_id", "left")
    counts = counts.select("paper_id", "entities", (F.coalesce("total_facts", F.lit(0)) - F.coalesce("pattern_facts", F.lit(0))).alias("llm_facts"), F.coalesce("pattern_facts", F.lit(0)).alias("pattern_facts"), F.coalesce("total_facts", F.lit(0)).alias("total_facts"))
    return Extraction(entities, facts, counts)


def totals(counts: DataFrame) -> DataFrame:
    """papers_processed, total_entities, total_facts over the counts of all papers."""
    return counts.agg(F.count("*").alias("papers_processed"), F.coalesce(F.sum("entities"), F.lit(0)).alias("total_entities"), F.coalesce(F.sum("total_facts"), F.lit(0)).alias("total_facts"))


def source_texts(chunks: DataFrame, source: str = "source", at: str = "chunk_index", content: str = "content", width: int = 8000) -> DataFrame:
    """paper_id, content: the first width characters of a source's chunks, in order, with blanks between.

    Each chunk takes a character at least, so the first width chunks of a source are enough: Spark keeps those per task
    before the shuffle, and a source of very many chunks is never gathered.
    """
    order = Window.partitionBy("paper_id").orderBy("at", "c")
    rows = chunks.select(F.col(source).alias("paper_id"), F.col(at).alias("at"), F.substring(F.coalesce(content, F.lit("")), 1, width).alias("c"))
    few = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= width)
    before = F.coalesce(F.sum(F.length("c") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = few.withColumn("before", before).filter(F.col("before") < width)
    lists = kept.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("r", "c"))).alias("l"))
    return lists.select("paper_id", F.substring(F.array_join(F.transform("l", lambda x: x["c"]), " "), 1, width).alias("content"))


def graph_seed(chunks: DataFrame, source: str = "source", at: str = "chunk_index", content: str = "content", width: int = 8000, most: int = 20, **options: tuple) -> DataFrame:
    """Facts, with names and types of both ends, of a corpus without a model: marked relations and, of each source, links between
    the first most entities that no earlier source names."""
    texts = source_texts(chunks, source, at, content, width).withColumn("title", F.lit("Unknown")).withColumn("seq", F.col("paper_id"))
    got = extract(texts, width=None, **options)
    made = got.entities.filter("entity_type <> 'PAPER'")
    own = made.groupBy("source_paper", F.lower("name").alias("low")).agg(F.min(F.struct("place", "entity_id")).alias("m")).select("source_paper", "m.place", "m.entity_id")
    pairs = cooccurrence(own, "source_paper", "entity_id", "place", most)
    linked = pairs.select(F.substring(F.md5(F.concat_ws("|", F.lit("with"), "source_paper", "a", "b")), 1, 16).alias("fact_id"), F.col("a").alias("subject_id"), F.lit("DISCUSSES").alias("predicate"), F.col("b").alias("object_id"), "source_paper", F.lit(0.5).alias("confidence"), F.lit("co-occurrence (same paper)").alias("evidence"), F.lit("cooccurrence").alias("extraction_method"))
    facts = got.facts.select(linked.columns).unionByName(linked)
    named = labelled(facts, got.entities.select("entity_id", "name", "entity_type"))
    return named.select("fact_id", F.col("subject_name").alias("subject"), "subject_type", "predicate", F.col("object_name").alias("object"), "object_type", "confidence", "source_paper", F.substring("evidence", 1, 200).alias("evidence"), "extraction_method")
