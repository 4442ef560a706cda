"""Queries over extraction, retrieval with reranking, pairs of claims and plain answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers
from ..operators import extract, graph, recommend, relations, reports, retrieval
from .corpus import _SP, _STRIP
from .views import PAPERS, papers, table

#: Patterns that the driver's invented texts hold, in the place of names that don't occur there.
PATTERNS = (("METHOD", "([A-Z][a-z]+tion)"), ("METHOD", "([A-Z][a-z]?[a-z]ing)"), ("DATASET", "([A-Z][a-z]+ea)"), ("FINDING", "[Tt]he ([a-z]+and)", "Result: "))
CAUSAL, CONTRA, EXT, BETTER = ("and", "und"), ("of", "les"), ("with",), ("und",)


def extracted(s, d):
    """What patterns find in all documents; three documents share a title."""
    docs = table(s, d, "documents")
    p = docs.select(F.col("doc_id").alias("paper_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("Paper "), F.floor(F.col("doc_id") / 3).cast("string")).alias("title"), F.col("text").alias("content"))
    return extract.extract(p, width=None, patterns=PATTERNS, causal=CAUSAL, contradiction=CONTRA, extension=EXT, improving=BETTER)


def _found(kind, pattern, before=""):
    return f"list_transform(regexp_extract_all(text, '{pattern}', 1), lambda x: {{'t': '{kind}', 'n': '{before}' || x}})"


_LISTS = "list_concat(" * (len(PATTERNS) - 1) + _found(*PATTERNS[0]) + "".join(f", {_found(*p)})" for p in PATTERNS[1:])
_ENTS = f"""docs AS (SELECT doc_id, text, list_filter({_LISTS}, lambda x: x.t <> 'METHOD' OR length(x.n) > 2) AS l FROM documents WHERE text <> ''),
 one AS (SELECT doc_id, i, l[i].t AS t, l[i].n AS n FROM docs, LATERAL (SELECT unnest(generate_series(1, len(l))) AS i)),
 ent AS (SELECT doc_id, lower(t) || '_' || md5(lower(n))[1:16] AS id, t, min(i) AS i, arg_min(n, i) AS n FROM one GROUP BY doc_id, t, lower(n))"""
_TITLE = "'Paper ' || (doc_id // 3)"
_ENTITIES = f"""WITH {_ENTS}, a AS (SELECT doc_id, id, t, i, n FROM ent UNION ALL SELECT doc_id, 'paper_' || md5(lower({_TITLE}))[1:16], 'PAPER', 0, {_TITLE} FROM docs)
SELECT id AS entity_id, min(t) AS entity_type, arg_min(n, doc_id) AS name, min(doc_id) AS source_paper FROM a GROUP BY id"""

_first = lambda words: "CASE " + " ".join(f"WHEN contains(lower(s), '{w}') THEN '{w}'" for w in words) + " END"
_TOLD = f"""{_ENTS}, sen AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_SP}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {_STRIP})), lambda x: length(x) > 20) AS ss FROM docs),
 st AS (SELECT doc_id, k - 1 AS k, ss[k] AS s FROM sen, LATERAL (SELECT unnest(generate_series(1, len(ss))) AS k)),
 mk AS (SELECT *, {_first(CAUSAL)} AS causal, {_first(CONTRA)} AS contra, {_first(EXT)} AS ext FROM st),
 hit AS (SELECT mk.*, e.id, e.t, e.i FROM mk JOIN ent e ON e.doc_id = mk.doc_id AND contains(lower(s), lower(e.n)) WHERE causal IS NOT NULL OR contra IS NOT NULL OR ext IS NOT NULL),
 two AS (SELECT doc_id, k, any_value(causal) AS causal, any_value(contra) AS contra, any_value(ext) AS ext, list(id ORDER BY i) AS ids, list(id ORDER BY i) FILTER (WHERE t = 'FINDING') AS fs FROM hit GROUP BY doc_id, k),
 f AS (SELECT doc_id, k, ids[1] AS a, CASE WHEN causal = 'und' THEN 'IMPROVES' ELSE 'APPLIES_TO' END AS p, ids[2] AS b, 0.6 AS c FROM two WHERE causal IS NOT NULL AND len(ids) >= 2
  UNION ALL SELECT doc_id, k, fs[1], 'CONTRADICTS', fs[2], 0.5 FROM two WHERE contra IS NOT NULL AND len(fs) >= 2
  UNION ALL SELECT doc_id, k, ids[1], 'EXTENDS', ids[2], 0.6 FROM two WHERE ext IS NOT NULL AND len(ids) >= 2)"""
_FACTS = f"WITH {_TOLD} SELECT doc_id AS source_paper, CAST(k * 10 AS INTEGER) AS place, a AS subject_id, p AS predicate, b AS object_id, CAST(c AS DOUBLE) AS confidence FROM f"
_COUNTS = f"""WITH {_TOLD}, n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id)
SELECT doc_id AS paper_id, CAST(len(l) AS BIGINT) AS entities, CAST(0 AS BIGINT) AS llm_facts, coalesce(n, 0) AS pattern_facts, coalesce(n, 0) AS total_facts FROM docs LEFT JOIN n USING (doc_id)"""

#: The first characters of a source's chunks are the operator's own limit: what a seed of the graph is made from.
_WIDTH = 8000


def source_texts(s, d):
    docs = table(s, d, "documents")
    return extract.source_texts(docs, "source", "doc_id", "text", _WIDTH).select(F.col("paper_id").alias("source"), F.length("content").alias("n"), F.md5("content").alias("content_md5"))


_SOURCES = f"""WITH t AS (SELECT source, left(string_agg(coalesce(text, ''), ' ' ORDER BY doc_id), {_WIDTH}) AS c FROM documents GROUP BY source)
SELECT source, CAST(length(c) AS INTEGER) AS n, md5(c) AS content_md5 FROM t"""


def store(s, d):
    """Vectors as chunks: a label is a document, and the text of the same number a chunk's content."""
    e, docs = table(s, d, "embeddings"), table(s, d, "documents")
    return e.join(docs.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), F.col("source").alias("title")), "vec_id").select("vec_id", F.col("label").alias("doc_id"), F.col("vec_id").alias("chunk_index"), "content", "title", "embedding")


QUERY = "the and of that"


def retrieved(s, d):
    v = [float(x) for x in table(s, d, "embeddings").filter("vec_id = 0").first()["embedding"]]
    got = retrieval.retrieve(store(s, d), QUERY, v, 10, min_score=0.1, width=40, id_col="vec_id", title="title")
    return got.select("id", F.round("score", 6).alias("score"), F.round("base_score", 6).alias("base_score"), "rank", F.md5("context").alias("context_md5"))


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_TERMS = "[" + ", ".join(f"'{t}'" for t in sorted(QUERY.split())) + "]"
_RETRIEVED = f"""WITH st AS (SELECT vec_id, label, embedding, text, source FROM embeddings JOIN documents ON doc_id = vec_id),
 s AS (SELECT e.vec_id AS id, label, text, source, {_COS} AS sc FROM st e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
 r AS (SELECT *, row_number() OVER (ORDER BY sc DESC, id) AS rk FROM s), top AS (SELECT * FROM r WHERE rk <= 20 AND sc >= 0.1),
 b AS (SELECT *, least(1.0, sc + 0.2 * len(list_intersect(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '\\s+')), {_TERMS})) / 4 + CASE WHEN coalesce(source, '') <> '' THEN 0.05 ELSE 0 END) AS ns FROM top),
 f AS (SELECT *, row_number() OVER (ORDER BY ns DESC, rk) AS nr FROM b),
 c AS (SELECT f.id, string_agg(o.text, chr(10) || '...' || chr(10) ORDER BY o.vec_id) AS c FROM f JOIN st o ON o.label = f.label AND o.vec_id <> f.id AND abs(o.vec_id - f.id) <= 40 GROUP BY f.id)
SELECT f.id, round(ns, 6) AS score, round(sc, 6) AS base_score, CAST(nr AS INTEGER) AS rank, md5(coalesce(c, '')) AS context_md5 FROM f LEFT JOIN c ON c.id = f.id WHERE nr <= 10"""

_PAIRS = f"""WITH {PAPERS}, r AS (SELECT topic, paper_id, trim(title || '. ' || left(content, 300), ' ') AS claim, row_number() OVER (PARTITION BY topic ORDER BY seq, paper_id) AS r FROM papers)
SELECT a.topic, least(a.paper_id, b.paper_id) || '|' || greatest(a.paper_id, b.paper_id) AS pair_id, a.paper_id AS paper_a, b.paper_id AS paper_b, a.claim AS claim_a, b.claim AS claim_b FROM r a JOIN r b ON a.topic = b.topic AND a.r < b.r WHERE b.r <= 6"""


def listed(s, d):
    """Each turn of a conversation as a list of its words after and, in the place of a model's answer."""
    c = table(s, d, "conversations")
    raw = F.regexp_replace("text", " and ", "\n2. ")
    rows = c.select("conv_id", "turn", F.posexplode(answers.listed(raw)).alias("place", "x"))
    return rows.select("conv_id", "turn", "place", "x.title", "x.description")


_LISTED = f"""WITH p AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(replace(text, ' and ', chr(10) || '2. '), '\\n\\s*(?:\\d+[.)]\\s*|-\\s+)'), lambda x: trim(x, {_STRIP})), lambda x: length(x) >= 10) AS l FROM conversations),
 i AS (SELECT conv_id, turn, k - 1 AS place, l[k] AS x FROM p, LATERAL (SELECT unnest(generate_series(1, len(l))) AS k)),
 t AS (SELECT *, rtrim(trim(string_split(x, chr(10))[1], {_STRIP}), ':') AS title, trim(substr(x, length(string_split(x, chr(10))[1]) + 1), {_STRIP}) AS rest FROM i)
SELECT conv_id, turn, CAST(place AS INTEGER) AS place, left(title, 200) AS title, CASE WHEN rest <> '' THEN rest ELSE title END AS description FROM t"""



def agent_rows(s, d):
    """A topic's papers as its candidates, and each paper's title as what a gap of its topic says."""
    p = papers(s, d)
    score = (F.col("seq") % 100) / 100
    cand = p.select("topic", F.col("paper_id").alias("id"), "title", F.col("content").alias("abstract"), (F.col("year") + 10).alias("year"), "keywords", score.alias("score"), F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(score), "seq")).alias("rank"))
    gaps = p.select("topic", F.col("title").alias("description"))
    return recommend.agent_list(cand, gaps, 10, "topic", free=1).select("topic", "id", F.round("score", 6).alias("score"), "reason", "rank")


_AGENT = f"""WITH {PAPERS}, w AS (SELECT topic, list(DISTINCT x) AS ws FROM (SELECT topic, unnest(regexp_split_to_array(lower(title), '\\s+')) AS x FROM papers) WHERE length(x) > 4 GROUP BY topic),
 c AS (SELECT p.topic, paper_id AS id, title, year + 10 AS year, seq % 100 / 100 AS s, row_number() OVER (PARTITION BY p.topic ORDER BY seq % 100 DESC, seq) AS r, len(list_filter(coalesce(ws, []), lambda x: contains(lower(title), x))) AS n, ws IS NOT NULL AS has, list_distinct(regexp_split_to_array(lower(title), '\\s+')) AS own FROM papers p LEFT JOIN w ON w.topic = p.topic),
 b AS (SELECT *, CASE WHEN n > 0 THEN least(1, s + n * 0.1) ELSE s END AS bs, concat_ws('; ', CASE WHEN s > 0.8 THEN 'Highly relevant to your query' WHEN s > 0.6 THEN 'Relevant to your research area' END, CASE WHEN year >= 2020 THEN 'Recent publication (' || year || ')' END, 'Matches key research themes', CASE WHEN has THEN 'Addresses identified research gaps' END) || CASE WHEN n > 0 THEN ' | Addresses ' || n || ' identified gap(s)' ELSE '' END AS reason FROM c),
 o AS (SELECT topic, id, r, unnest(own) AS x FROM b), f AS (SELECT topic, x, min(r) AS f FROM o GROUP BY ALL), k AS (SELECT topic, id, count(*) FILTER (WHERE f < r) AS k FROM o JOIN f USING (topic, x) GROUP BY ALL),
 z AS (SELECT b.topic, b.id, reason, r, CASE WHEN k > 1 THEN greatest(0, bs - k * 0.3 * 0.1) ELSE bs END AS sc FROM b JOIN k ON k.topic = b.topic AND k.id = b.id),
 t AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(sc, 12) DESC, r) AS rank FROM z) SELECT topic, id, CAST(round(sc, 6) AS DOUBLE) AS score, reason, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 10"""


def viewed(s, d):
    """Nations and suppliers as nodes, one nation selected, a number searched."""
    nodes = table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_name").alias("label"), F.lit(None).cast("long").alias("weight"))
    nodes = nodes.unionByName(table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_name").alias("label"), (F.col("s_suppkey") % 50 + 1).cast("long").alias("weight")))
    links = table(s, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("u"), F.concat(F.lit("s"), "s_suppkey").alias("v"))
    return graph.node_view(nodes, links, " 1 ", "n3").select("node", F.round("radius", 6).alias("radius"), "dimmed")


_VIEWED = """WITH n AS (SELECT 'n' || n_nationkey AS node, n_name AS label, 1 AS w FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, s_suppkey % 50 + 1 FROM supplier)
SELECT node, round(3 + 9 * sqrt(w / (SELECT max(w) FROM n)), 6) AS radius, NOT contains(label, '1') OR NOT (node = 'n3' OR node IN (SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey = 3)) AS dimmed FROM n"""

_gaps = lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 97 / 100).alias("confidence"), F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low").alias("priority"))

QUERIES = {
    "extracted_entities": (lambda s, d: extracted(s, d).entities.select("entity_id", "entity_type", "name", "source_paper"), _ENTITIES),
    "extracted_facts": (lambda s, d: extracted(s, d).facts.select("source_paper", "place", "subject_id", "predicate", "object_id", "confidence"), _FACTS),
    "extraction_counts": (lambda s, d: extracted(s, d).counts, _COUNTS),
    "source_texts": (source_texts, _SOURCES),
    "retrieve": (retrieved, _RETRIEVED),
    "claim_pairs": (lambda s, d: relations.claim_pairs(papers(s, d)), _PAIRS),
    "answer_items": (listed, _LISTED),
    "agent_recommend": (agent_rows, _AGENT),
    "node_view": (viewed, _VIEWED),
    "basis_groups": (
        lambda s, d: reports.groups_by_basis(papers(s, d).select("topic", "title", "seq", F.when(F.col("seq") % 3 > 0, F.concat(F.lit(" b"), F.col("seq") % 3)).alias("basis")), "topic").select("topic", "basis", "n", F.md5(F.array_join("titles", "|")).alias("titles_md5")),
        f"WITH {PAPERS} SELECT topic, CASE WHEN seq % 3 > 0 THEN 'b' || (seq % 3) ELSE 'Lainnya' END AS basis, CAST(count(*) AS INTEGER) AS n, md5(string_agg(title, '|' ORDER BY seq)) AS titles_md5 FROM papers GROUP BY ALL",
    ),
    "primary_gap": (lambda s, d: reports.primary(_gaps(s, d), "job").select("job", "seq"), "SELECT o_custkey AS job, min_by(o_orderkey, (-(o_orderkey % 97), o_orderkey)) AS seq FROM orders GROUP BY 1"),
    "primary_recommendation": (lambda s, d: reports.primary_recommendation(_gaps(s, d), "job").select("job", "seq"), "SELECT o_custkey AS job, min_by(o_orderkey, (CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderkey)) AS seq FROM orders GROUP BY 1"),
}
