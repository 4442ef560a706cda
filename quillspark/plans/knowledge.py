"""Queries over facts, entities, claims, graphs, gaps, recommendations and papers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import facts as ft
from ..operators import gaps, graph, papers, recommend, relations, rules
from ..session import stored
from .corpus import _SP, _STRIP
from .views import ENTITIES, FACTS, PAPERS, entities, table
from .views import facts as fact_view
from .views import papers as paper_view

NAMES = ("ring", "widget", "red", "small")
CAUSAL, CONTRA, EXT = ("the", "and"), ("of", "is"), ("with",)


def small_entities(s):
    """Entities whose names occur in the driver's texts."""
    return s.createDataFrame([(f"e{i}", t, n, i) for i, (t, n) in enumerate((("METHOD", "that"), ("FINDING", "thand"), ("FINDING", "onst"), ("DOMAIN", "ering"), ("FINDING", "tion")))], "entity_id string, entity_type string, name string, seq int")


_SMALL = "e AS (SELECT * FROM (VALUES ('e0','METHOD','that',0),('e1','FINDING','thand',1),('e2','FINDING','onst',2),('e3','DOMAIN','ering',3),('e4','FINDING','tion',4)) t(entity_id, entity_type, name, seq))"
_SENT = "s AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_no, ss[i] AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) > 20) AS ss FROM documents), LATERAL (SELECT unnest(generate_series(1, len(ss))) AS i))"


def pattern_relations(s, d):
    r = ft.pattern_relations(table(s, d, "documents"), small_entities(s), CAUSAL, CONTRA, EXT, improving=("and",))
    return r.select("doc_id", "sentence_no", "subject_id", "predicate", "object_id", "confidence", "marker")


_m = lambda ms: "[" + ", ".join(f"'{x}'" for x in ms) + "]"
_REL = f"""WITH {_SMALL}, {_SENT}, f AS (SELECT doc_id, sentence_no, lower(sentence) AS t, (SELECT list(entity_id ORDER BY seq) FROM e WHERE contains(lower(sentence), name)) AS al, (SELECT list(entity_id ORDER BY seq) FROM e WHERE entity_type = 'FINDING' AND contains(lower(sentence), name)) AS fi FROM s),
 k AS (SELECT *, list_filter({_m(CAUSAL)}, lambda x: contains(t, x))[1] AS m1, list_filter({_m(CONTRA)}, lambda x: contains(t, x))[1] AS m2, list_filter({_m(EXT)}, lambda x: contains(t, x))[1] AS m3 FROM f)
SELECT doc_id, sentence_no, al[1] AS subject_id, CASE WHEN m1 = 'and' THEN 'IMPROVES' ELSE 'APPLIES_TO' END AS predicate, al[2] AS object_id, CAST(0.6 AS DOUBLE) AS confidence, m1 AS marker FROM k WHERE m1 IS NOT NULL AND len(al) >= 2
UNION ALL SELECT doc_id, sentence_no, fi[1], 'CONTRADICTS', fi[2], 0.5, m2 FROM k WHERE m2 IS NOT NULL AND len(fi) >= 2 UNION ALL SELECT doc_id, sentence_no, al[1], 'EXTENDS', al[2], 0.6, m3 FROM k WHERE m3 IS NOT NULL AND len(al) >= 2"""


def kg_stats(s, d):
    return ft.statistics(fact_view(s, d), entities(s, d))


_STATS = f"""WITH {FACTS}, {ENTITIES} SELECT 'total' AS kind, 'facts' AS key, count(*) AS n FROM facts UNION ALL SELECT 'total', 'inferred_facts', count(*) FROM facts WHERE is_inferred UNION ALL SELECT 'total', 'papers', count(DISTINCT source_paper) FROM facts
 UNION ALL SELECT 'total', 'entities', count(*) FROM entities UNION ALL SELECT 'entity_type', entity_type, count(*) FROM entities GROUP BY 2 UNION ALL SELECT 'predicate', predicate, count(*) FROM facts GROUP BY 2"""


def contradictions(s, d):
    f = fact_view(s, d)
    # facts point from suppliers to parts; turned round, parts have facts of their own
    both = f.unionByName(f.select(F.concat(F.lit("r"), "fact_id").alias("fact_id"), F.col("object_id").alias("subject_id"), F.lit("ACHIEVES").alias("predicate"), F.col("subject_id").alias("object_id"), "source_paper", "confidence", "is_inferred", "seq"))
    return ft.contradictions(both)


_CONTRA = f"""WITH {FACTS}, b AS (SELECT fact_id, subject_id, predicate, object_id, seq FROM facts UNION ALL SELECT 'r' || fact_id, object_id, 'ACHIEVES', subject_id, seq FROM facts), o AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY seq, fact_id) AS r FROM b),
 f AS (SELECT subject_id AS s, fact_id AS f FROM o WHERE r = 1) SELECT b.fact_id, x.f AS fact_a, y.f AS fact_b FROM b JOIN f x ON x.s = b.subject_id JOIN f y ON y.s = b.object_id WHERE predicate = 'CONTRADICTS'"""


def order_parts(s, d):
    """l_orderkey, its parts in order, m: its first supplier. Claims and links are both made of it."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    g = li.repartition("l_orderkey").distinct().groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    return stored(g.select("l_orderkey", F.col("x.l_partkey").alias("parts"), F.col("x")[0]["l_suppkey"].alias("m")))


def claims(s, d, parts=None):
    """An order's claim: its first supplier as method, that one's nation as domain, its parts as findings."""
    g, o, sup = parts or order_parts(s, d), table(s, d, "orders"), table(s, d, "supplier")
    g = g.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey").join(sup.select(F.col("s_suppkey").alias("m"), "s_nationkey"), "m")
    return g.select(F.col("l_orderkey").cast("string").alias("claim_id"), F.col("o_orderpriority").alias("description"), F.concat(F.lit("s"), "m").alias("method"), F.concat(F.lit("n"), "s_nationkey").alias("domain"), F.transform("parts", lambda x: F.concat(F.lit("p"), x)).alias("findings"), F.lit(0.9).alias("confidence"))


RULE_WORDS = {"high_resource": ("p1",), "low_constraint": ("p2",), "much_data": ("p3",), "scarce_data": ("p4",), "single": ("p5",), "scale": ("urgent", "high")}


def claim_facts(s, d, parts=None):
    """Facts with part-to-part links along each order, and constraints of nations, so that every rule has something to find."""
    g = parts or order_parts(s, d)
    n = F.greatest(F.size("parts") - 1, F.lit(0))
    pairs = g.select(F.explode(F.arrays_zip(F.slice("parts", F.lit(1), n).alias("a"), F.slice("parts", F.lit(2), n).alias("b"))).alias("x")).filter("x.b is not null").select("x.a", "x.b")
    links = pairs.select(F.concat(F.lit("p"), "a").alias("subject_id"), F.when(F.col("a") % 3 == 0, "CONTRADICTS").otherwise("IMPROVES").alias("predicate"), F.concat(F.lit("p"), "b").alias("object_id"))
    sup = table(s, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("subject_id"), F.lit("HAS_CONSTRAINT").alias("predicate"), F.concat(F.lit("p"), F.col("s_suppkey") % 10).alias("object_id"))
    req = fact_view(s, d).filter("predicate in ('REQUIRES_RESOURCE', 'EXTENDS')").select("subject_id", F.when(F.col("predicate") == "EXTENDS", "REQUIRES_DATA").otherwise(F.col("predicate")).alias("predicate"), "object_id")
    return links.union(sup).union(req)


_CF = f"""{FACTS}, {ENTITIES}, li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), nx AS (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o FROM li),
 cf AS (SELECT 'p' || l_partkey AS s, CASE WHEN l_partkey % 3 = 0 THEN 'CONTRADICTS' ELSE 'IMPROVES' END AS p, 'p' || o AS o FROM nx WHERE o IS NOT NULL UNION ALL SELECT 'n' || s_nationkey, 'HAS_CONSTRAINT', 'p' || (s_suppkey % 10) FROM supplier UNION ALL SELECT subject_id, CASE predicate WHEN 'EXTENDS' THEN 'REQUIRES_DATA' ELSE predicate END, object_id FROM facts WHERE predicate IN ('REQUIRES_RESOURCE', 'EXTENDS')),
 g AS (SELECT l_orderkey, list('p' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS fs, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey)[1] AS m FROM li GROUP BY l_orderkey),
 c AS (SELECT CAST(l_orderkey AS VARCHAR) AS claim_id, o_orderpriority AS descr, 's' || m AS method, 'n' || s_nationkey AS domain, fs FROM g JOIN supplier ON s_suppkey = m JOIN orders ON o_orderkey = l_orderkey),
 kn AS (SELECT s AS id FROM cf UNION SELECT o FROM cf UNION SELECT entity_id FROM entities),
 fr AS (SELECT claim_id, i, fs[i] AS id FROM c, LATERAL (SELECT unnest(generate_series(1, len(fs))) AS i)), lack AS (SELECT DISTINCT claim_id FROM fr WHERE id NOT IN (SELECT id FROM kn)),
 inn AS (SELECT a.claim_id, a.i, b.i AS j, p FROM cf JOIN fr a ON a.id = cf.s JOIN fr b ON b.id = cf.o AND b.claim_id = a.claim_id WHERE a.i <> b.i AND p IN ('IMPROVES', 'CONTRADICTS')),
 k1 AS (SELECT DISTINCT claim_id FROM inn WHERE p = 'CONTRADICTS'), c1 AS (SELECT DISTINCT claim_id FROM (SELECT claim_id, i, j FROM inn WHERE p = 'IMPROVES' AND i < j GROUP BY ALL HAVING count(*) = 1)),
 r AS (SELECT claim_id, len(fs) AS n, EXISTS (SELECT 1 FROM cf WHERE s = method AND p = 'REQUIRES_RESOURCE' AND contains(o, 'p1')) AS mh, EXISTS (SELECT 1 FROM cf WHERE s = domain AND p = 'HAS_CONSTRAINT' AND contains(o, 'p2')) AS dl,
  EXISTS (SELECT 1 FROM cf WHERE s = method AND p = 'REQUIRES_DATA' AND contains(o, 'p3')) AS md, EXISTS (SELECT 1 FROM cf WHERE s = domain AND p = 'HAS_CONSTRAINT' AND contains(o, 'p4')) AS ds, EXISTS (SELECT 1 FROM cf WHERE s = method AND p = 'REQUIRES_RESOURCE' AND contains(o, 'p5')) AS ms,
  EXISTS (SELECT 1 FROM cf WHERE s = method) AS mf, regexp_matches(lower(descr), 'urgent|high') AS sc, claim_id IN (SELECT claim_id FROM lack) AS la, claim_id IN (SELECT claim_id FROM k1) AS k1, claim_id IN (SELECT claim_id FROM c1) AS c1 FROM c)"""


def dated(s, d):
    """Entities, every twentieth part with a place in time."""
    k = F.substring("entity_id", 2, 20).cast("long")
    return entities(s, d).withColumn("temporal_order", F.when((F.col("entity_type") == "FINDING") & (k % 20 == 0), k.cast("double")))


def rule_rows(s, d):
    parts = order_parts(s, d)
    return rules.rule_results(stored(claims(s, d, parts)), claim_facts(s, d, parts), dated(s, d), words=RULE_WORDS).select("claim_id", "rule_id", "verdict", "adj")


def verdicts(s, d):
    parts = order_parts(s, d)
    c = stored(claims(s, d, parts))
    return rules.claim_verdicts(c, rules.rule_results(c, claim_facts(s, d, parts), dated(s, d), words=RULE_WORDS))


_PATHS = """e AS (SELECT DISTINCT s AS u, o AS v FROM cf WHERE s <> o), pr AS (SELECT DISTINCT fs[1] AS a, fs[-1] AS b FROM c WHERE len(fs) >= 2 AND fs[1] <> fs[-1]),
 o1 AS (SELECT a, b, v AS x FROM pr JOIN e ON u = a), i1 AS (SELECT a, b, u AS z FROM pr JOIN e ON v = b WHERE u <> a), o2 AS (SELECT a, b, x, v AS y FROM o1 JOIN e ON u = x WHERE x <> b AND v <> a),
 i2 AS (SELECT a, b, u AS y, z FROM i1 JOIN e ON v = z WHERE u <> a AND u <> b), n2 AS (SELECT a, b, y, count(*) AS k FROM i2 GROUP BY ALL),
 ph AS (SELECT a, b, count(*) AS k FROM o1 WHERE x = b GROUP BY ALL UNION ALL SELECT a, b, count(*) FROM o2 WHERE y = b GROUP BY ALL UNION ALL SELECT o2.a, o2.b, count(*) FROM o2 JOIN i1 ON i1.a = o2.a AND i1.b = o2.b AND z = y WHERE y <> o2.b GROUP BY ALL
  UNION ALL SELECT o2.a, o2.b, sum(k) FROM o2 JOIN n2 ON n2.a = o2.a AND n2.b = o2.b AND n2.y = o2.y GROUP BY ALL UNION ALL SELECT o2.a, o2.b, -count(*) FROM o2 JOIN i2 ON i2.a = o2.a AND i2.b = o2.b AND i2.y = o2.y AND z = x GROUP BY ALL),
 c3 AS (SELECT claim_id FROM c JOIN (SELECT a, b FROM ph GROUP BY ALL HAVING sum(k) > 1) ON a = fs[1] AND b = fs[-1] WHERE len(fs) >= 2),
 imp AS (SELECT DISTINCT claim_id, i, j FROM inn WHERE p = 'IMPROVES'), bk AS (SELECT DISTINCT s FROM cf WHERE p = 'IMPROVES' AND s[1] = 'p' AND o[1] = 'p' AND CAST(s[2:] AS BIGINT) % 20 = 0 AND CAST(o[2:] AS BIGINT) % 20 = 0 AND CAST(s[2:] AS BIGINT) > CAST(o[2:] AS BIGINT) AND o <> 'p0'),
 c2 AS (SELECT DISTINCT claim_id FROM fr JOIN bk ON id = s), k3 AS (SELECT DISTINCT a.claim_id FROM imp a JOIN imp b ON b.claim_id = a.claim_id AND b.i = a.j JOIN inn t ON t.claim_id = a.claim_id AND t.i = a.i AND t.j = b.j AND t.p = 'CONTRADICTS')"""

_ADJ = f"""{_CF}, {_PATHS}, v AS (SELECT claim_id, [CASE WHEN mh AND dl THEN -0.5 ELSE 0 END, CASE WHEN md AND ds THEN -0.2 ELSE 0 END, CASE WHEN ms AND sc THEN -0.5 ELSE 0 END, CASE WHEN n < 2 THEN 0 WHEN la THEN -0.05 WHEN c1 THEN -0.15 ELSE 0 END, CASE WHEN la THEN -0.05 WHEN claim_id IN (SELECT claim_id FROM c2) THEN -0.5 ELSE 0 END,
  CASE WHEN claim_id IN (SELECT claim_id FROM c3) THEN -0.1 ELSE 0 END, CASE WHEN la THEN -0.05 WHEN k1 THEN -0.2 ELSE 0 END, CASE WHEN mf THEN -0.1 ELSE -0.15 END, CASE WHEN n < 3 THEN 0 WHEN la THEN -0.05 WHEN claim_id IN (SELECT claim_id FROM k3) THEN -0.15 ELSE 0 END] AS adj FROM r)"""

_RULES = f"""WITH {_ADJ} SELECT claim_id, ['F1', 'F2', 'F3', 'C1', 'C2', 'C3', 'K1', 'K2', 'K3'][i] AS rule_id, CASE WHEN adj[i] = 0 THEN 'PASS' WHEN adj[i] = -0.5 THEN 'REJECT' ELSE 'FLAG' END AS verdict, CAST(adj[i] AS DOUBLE) AS adj FROM v, range(1, 10) t(i)"""

_VERDICTS = f"""WITH {_ADJ},
 w AS (SELECT claim_id, len(list_filter(adj, lambda x: x = 0)) AS n_pass, len(list_filter(adj, lambda x: x < 0 AND x > -0.5)) AS n_flag, len(list_filter(adj, lambda x: x = -0.5)) AS n_reject, round(greatest(0, least(1, 0.9 + list_sum(adj))), 6) AS confidence FROM v)
SELECT claim_id, CASE WHEN n_reject > 0 THEN 'REJECT' WHEN n_flag > 0 THEN 'FLAG' ELSE 'PASS' END AS verdict, CAST(confidence AS DOUBLE) AS confidence, n_pass, n_flag, n_reject, concat_ws(' ', CASE WHEN n_reject > 0 THEN 'REJECT' WHEN n_flag > 0 THEN 'FLAG' ELSE 'PASS' END, 'pass', n_pass, 'flag', n_flag, 'reject', n_reject) AS summary FROM w"""


def edges(s, d):
    return table(s, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("u"), F.concat(F.lit("n"), "n_nationkey").alias("v")).union(table(s, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey")))


_EDGES = "e AS (SELECT 'r' || n_regionkey AS u, 'n' || n_nationkey AS v FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"
_PAGERANK = f"""WITH RECURSIVE {_EDGES}, nd AS (SELECT u AS node FROM e UNION SELECT v FROM e), n AS (SELECT count(*) AS n FROM nd), od AS (SELECT u, count(*) AS k FROM e GROUP BY u), sh AS (SELECT e.u, v, 1.0 / k AS w FROM e JOIN od USING (u)),
 pr AS (SELECT 0 AS it, node, 1.0::DOUBLE / n AS r FROM nd, n UNION ALL SELECT it, node, r FROM (WITH p AS (SELECT * FROM pr), d AS (SELECT coalesce(sum(r), 0) AS l FROM p WHERE node NOT IN (SELECT u FROM e)), g AS (SELECT v, sum(w * r) AS x FROM sh JOIN p ON p.node = sh.u GROUP BY v)
 SELECT (SELECT max(it) FROM p) + 1 AS it, nd.node, 0.15 / n.n + 0.85 * d.l / n.n + 0.85 * coalesce(x, 0) AS r FROM nd LEFT JOIN g ON g.v = nd.node, n, d WHERE (SELECT max(it) FROM p) < 5)) SELECT node, round(r, 6) AS rank FROM pr WHERE it = 5"""


def network_links(s, d):
    return graph.network(fact_view(s, d), 3, 5000)[1].withColumn("confidence", F.round("confidence", 6))


_NET = f"""WITH {FACTS}, l AS (SELECT least(subject_id, object_id) AS u, greatest(subject_id, object_id) AS v, count(*) AS weight, list_aggregate(list_sort(list_distinct(list(predicate))), 'string_agg', ',') AS predicates, min({{'s': seq, 'c': confidence}}).c AS confidence FROM facts GROUP BY 1, 2),
 nd AS (SELECT node FROM (SELECT node, count(*) AS g FROM (SELECT u AS node FROM l UNION ALL SELECT v FROM l) GROUP BY node) WHERE g >= 3 ORDER BY g DESC, node LIMIT 5000) SELECT u, v, weight, predicates, round(confidence, 6) AS confidence FROM l WHERE u IN (SELECT node FROM nd) AND v IN (SELECT node FROM nd)"""


def relation_rows(s, d):
    docs = table(s, d, "documents")
    pairs = docs.select(F.col("doc_id").cast("string").alias("pair_id"), F.lit("that").alias("entity_a"), F.lit("onst").alias("entity_b"), F.col("text").alias("text_context"), (F.col("doc_id") % 11 / 10.0).alias("similarity"), F.when(F.col("doc_id") % 7 == 0, 0.8).alias("nli_score"))
    facts = s.createDataFrame([("onst", "that")], "subject_id string, object_id string")
    return relations.classify(pairs, facts, CAUSAL, ("zzz",), EXT).select("pair_id", "relation", F.round("confidence", 6).alias("confidence"), "valid")


_CLASSIFIED = f"""WITH d AS (SELECT doc_id, doc_id % 11 / 10.0 AS sim, doc_id % 7 = 0 AS nli, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_SP}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {_STRIP})), lambda x: length(x) > 0) AS s FROM documents),
 h AS (SELECT *, list_filter(s, lambda x: contains(lower(x), 'that') AND contains(lower(x), 'onst')) AS joint, coalesce(list_position(list_transform(s, lambda x: contains(lower(x), 'that') OR contains(lower(x), 'onst')), TRUE), 0) AS hit FROM d),
 e AS (SELECT *, left(array_to_string(list_slice(CASE WHEN len(joint) > 0 THEN joint WHEN hit > 0 THEN list_slice(s, greatest(1, hit - 1), hit + 1) ELSE [] END, 1, 5), ' '), 500) AS ev FROM h),
 m AS (SELECT *, list_filter(['the', 'and'], lambda w: contains(lower(ev), w)) AS causal, contains(lower(ev), 'with') AS ext FROM e),
 k AS (SELECT *, CASE WHEN nli THEN 'CONTRADICTION' WHEN len(causal) > 0 THEN 'CAUSAL' WHEN ext THEN 'EXTENSION' ELSE 'CO_OCCURRENCE' END AS rel, CASE WHEN len(causal) > 0 THEN len(causal) WHEN ext THEN 1 ELSE 0 END + CASE WHEN nli THEN 1 ELSE 0 END AS n FROM m)
SELECT CAST(doc_id AS VARCHAR) AS pair_id, CASE WHEN sim < 0.3 THEN 'UNKNOWN' ELSE rel END AS relation, CAST(round(CASE WHEN sim < 0.3 THEN sim WHEN rel = 'CO_OCCURRENCE' THEN least(sim * 0.5, 0.5) ELSE least(1, sim * 0.3 + least(n * 0.1, 0.4) + 0.3) END, 6) AS DOUBLE) AS confidence, TRUE AS valid FROM k"""

_GRAPH = f"""WITH RECURSIVE {_EDGES}, nd AS (SELECT u AS node FROM e UNION SELECT v FROM e), w AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e),
 r AS (SELECT node AS a, node AS b FROM nd UNION SELECT r.a, w.b FROM r JOIN w ON w.a = r.b), c AS (SELECT count(DISTINCT m) AS c FROM (SELECT a, min(b) AS m FROM r GROUP BY a)), n AS (SELECT count(*) AS n FROM nd), k AS (SELECT count(*) AS k FROM (SELECT DISTINCT u, v FROM e))
SELECT n AS nodes, k AS edges, k / n AS edges_per_node, k / (n * (n - 1)) AS density, c AS components, c = 1 AS connected FROM c, n, k"""

_DIVERSE = f"""WITH {PAPERS}, r AS (SELECT topic, paper_id, row_number() OVER (PARTITION BY topic ORDER BY seq) AS r, list_distinct(regexp_split_to_array(lower(title), '\\s+')) AS ws FROM papers),
 w AS (SELECT topic, paper_id, r, unnest(ws) AS w FROM r), f AS (SELECT topic, w, min(r) AS f FROM w GROUP BY ALL), n AS (SELECT paper_id, count(*) FILTER (WHERE f < r) AS n FROM w JOIN f USING (topic, w) GROUP BY paper_id)
SELECT paper_id, CAST(round(CASE WHEN n > 1 THEN greatest(0, 0.9 - n * 0.3 * 0.1) ELSE 0.9 END, 6) AS DOUBLE) AS score FROM n"""

QUERIES = {
    "kg_stats": (kg_stats, _STATS),
    "spo_query": (lambda s, d: ft.query_facts(fact_view(s, d), predicate="IMPROVES", min_confidence=0.95, include_inferred=False).select("fact_id", "subject_id", "object_id"), f"WITH {FACTS} SELECT fact_id, subject_id, object_id FROM facts WHERE predicate = 'IMPROVES' AND confidence >= 0.95 AND NOT is_inferred"),
    "fact_labels": (lambda s, d: ft.labelled(fact_view(s, d), entities(s, d)).groupBy("subject_type", "predicate", "object_name").count().withColumnRenamed("count", "n"), f"WITH {FACTS}, {ENTITIES} SELECT coalesce(a.entity_type, 'CONCEPT') AS subject_type, predicate, coalesce(b.name, object_id) AS object_name, count(*) AS n FROM facts LEFT JOIN entities a ON a.entity_id = subject_id LEFT JOIN entities b ON b.entity_id = object_id GROUP BY ALL"),
    "entities_by_name": (lambda s, d: ft.find_entities(entities(s, d), "FINDING", "RING").select("entity_id", "name"), f"WITH {ENTITIES} SELECT entity_id, name FROM entities WHERE entity_type = 'FINDING' AND contains(lower(name), 'ring')"),
    "entity_dedup": (lambda s, d: ft.dedup_entities(entities(s, d)).select("entity_id", "survivor_id"), f"WITH {ENTITIES} SELECT entity_id, first_value(entity_id) OVER (PARTITION BY lower(name), entity_type ORDER BY seq, entity_id) AS survivor_id FROM entities"),
    "entity_resolve": (
        lambda s, d: ft.resolve_names(s.createDataFrame([(x,) for x in ("Small RING", "widget", "nation_1", "nothing")], "mention string"), entities(s, d)),
        f"WITH {ENTITIES}, m AS (SELECT unnest(['Small RING', 'widget', 'nation_1', 'nothing']) AS mention) SELECT mention, coalesce((SELECT arg_min(entity_id, seq) FROM entities WHERE lower(name) = lower(mention)), (SELECT arg_min(entity_id, seq) FROM entities WHERE contains(lower(name), lower(mention)) OR contains(lower(mention), lower(name)))) AS entity_id FROM m",
    ),
    "contradiction_pairs": (contradictions, _CONTRA),
    "marker_relations": (pattern_relations, _REL),
    "cooccurrence_edges": (
        lambda s, d: ft.cooccurrence(table(s, d, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber"),
        "WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS o FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY o, l_partkey) AS r FROM f) SELECT a.l_orderkey, a.l_partkey AS a, b.l_partkey AS b FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.r < b.r WHERE b.r <= 20",
    ),
    "relation_classify": (relation_rows, _CLASSIFIED),
    "rule_results": (rule_rows, _RULES),
    "claim_verdicts": (verdicts, _VERDICTS),
    "degree": (lambda s, d: graph.degrees(edges(s, d)), f"WITH {_EDGES} SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT u AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT v, 1, 0 FROM e) GROUP BY node"),
    "network_links": (network_links, _NET),
    "graph_edges": (lambda s, d: graph.last_edges(fact_view(s, d)).withColumn("confidence", F.round("confidence", 6)), f"WITH {FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY subject_id, object_id ORDER BY seq DESC, fact_id DESC) AS k FROM facts) SELECT subject_id AS u, object_id AS v, predicate, round(confidence, 6) AS confidence FROM r WHERE k = 1"),
    "khop": (lambda s, d: graph.distances(edges(s, d), "n1", 2, both_ways=True), f"WITH RECURSIVE {_EDGES}, b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), h AS (SELECT 'n1' AS node, 0 AS depth UNION SELECT b.v, depth + 1 FROM h JOIN b ON b.u = h.node WHERE depth < 2) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM h GROUP BY node"),
    "neighbourhood": (lambda s, d: graph.neighbourhood(edges(s, d), "n1", 1).select("u", "v"), f"WITH {_EDGES} SELECT u, v FROM e WHERE u = 'n1' UNION ALL SELECT u, v FROM e WHERE v = 'n1'"),
    "simple_paths": (lambda s, d: graph.simple_paths(edges(s, d), "r0", "s1", 4, None).select(F.array_join("path", ">").alias("path"), "length"), f"WITH RECURSIVE {_EDGES}, p AS (SELECT ['r0', v] AS path, v FROM e WHERE u = 'r0' UNION ALL SELECT list_append(path, e.v), e.v FROM p JOIN e ON e.u = p.v WHERE p.v <> 's1' AND NOT list_contains(path, e.v) AND len(path) <= 4) SELECT list_aggregate(path, 'string_agg', '>') AS path, CAST(len(path) - 1 AS INTEGER) AS length FROM p WHERE v = 's1'"),
    "pagerank": (lambda s, d: graph.pagerank(edges(s, d), rounds=5, tol=0.0).withColumn("rank", F.round("rank", 6)), _PAGERANK),
    "components": (lambda s, d: graph.connected_components(edges(s, d)).withColumnRenamed("label", "component"), f"WITH RECURSIVE {_EDGES}, b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), h AS (SELECT u AS node, u AS r FROM b UNION SELECT b.v, r FROM h JOIN b ON b.u = h.node) SELECT node, min(r) AS component FROM h GROUP BY node"),
    "label_propagation": (lambda s, d: graph.label_propagation(edges(s, d), 5), None),
    "modularity": (lambda s, d: graph.modularity_communities(edges(s, d).withColumn("weight", F.lit(1.0))), None),
    "graph_stats": (lambda s, d: graph.statistics(edges(s, d)), _GRAPH),
    "jaccard_pairs": (
        lambda s, d: gaps.jaccard_pairs(paper_view(s, d).groupBy("topic").agg(F.collect_set("title").alias("t")), "topic", "t").withColumn("jaccard", F.round("jaccard", 6)),
        f"WITH {PAPERS}, t AS (SELECT topic, list_distinct(list(title)) AS t FROM papers GROUP BY topic), j AS (SELECT a.topic AS a, b.topic AS b, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS jac FROM t a JOIN t b ON a.topic < b.topic) SELECT a, b, round(jac, 6) AS jaccard FROM j WHERE jac > 0.3",
    ),
    "approach_clusters": (lambda s, d: gaps.greedy_clusters(gaps.approaches(paper_view(s, d), NAMES), "topic", "paper_id", "approaches", "seq"), None),
    "fragmentation": (lambda s, d: gaps.fragmentation(gaps.greedy_clusters(p := gaps.approaches(paper_view(s, d), NAMES), "topic", "paper_id", "approaches", "seq").join(p.select(F.col("paper_id").alias("id"), "approaches"), "id")).withColumn("separation", F.round("separation", 6)), None),
    "coverage_gap": (
        lambda s, d: gaps.incompleteness(paper_view(s, d), paper_view(s, d).select("topic").distinct().crossJoin(F.broadcast(s.createDataFrame([("ring",), ("blue ring",), ("gadget",), ("economy",)], "aspect string"))), terms=NAMES).drop("n_expected"),
        f"""WITH {PAPERS}, x AS (SELECT DISTINCT topic, unnest(['ring', 'blue ring', 'gadget', 'economy']) AS aspect FROM papers), c AS (SELECT topic, unnest(list_concat(keywords, list_filter(['ring', 'widget', 'red', 'small'], lambda t: contains(lower(content), t)))) AS aspect FROM papers), o AS (SELECT topic, aspect FROM x EXCEPT SELECT topic, aspect FROM c),
 g AS (SELECT o.topic, o.aspect, EXISTS (SELECT 1 FROM papers p WHERE p.topic = o.topic AND len(list_filter(list_filter(regexp_extract_all(o.aspect, '([a-z]+)', 1), lambda w: length(w) > 3), lambda w: contains(lower(p.content), w))) > 0) AS gr FROM o)
SELECT topic, string_agg(aspect, ',' ORDER BY aspect) AS missing, count(*) AS n_missing, count(*) FILTER (WHERE gr) AS n_grounded, least(0.85, round((0.3 + 0.6 * count(*) / 4) * (0.6 + 0.4 * count(*) FILTER (WHERE gr) / count(*)), 3)) AS confidence FROM g GROUP BY topic""",
    ),
    "monoculture": (lambda s, d: gaps.monoculture(paper_view(s, d).withColumn("topic", F.col("title")), NAMES), f"WITH {PAPERS}, m AS (SELECT title AS topic, len(list_filter(['ring', 'widget', 'red', 'small'], lambda t: contains(title, t))) AS k FROM papers) SELECT topic, count(*) AS papers, CAST(max(k) AS BIGINT) AS methods, CAST(round(0.4 + 0.4 * least(1.0, count(*) / 5), 6) AS DOUBLE) AS confidence FROM m GROUP BY topic HAVING count(*) >= 3 AND max(k) <= 1"),
    "gap_aware_rank": (
        lambda s, d: recommend.gap_scores(paper_view(s, d).select(F.col("paper_id").alias("id"), "content", F.lit(0.75).alias("score")), ["small red things", "a ring"], least=2).select("id", F.round("score", 6).alias("score")),
        f"WITH {PAPERS} SELECT paper_id AS id, CAST(round(least(1.0, 0.75 + 0.1 * len(list_filter(['small', 'red', 'things', 'ring'], lambda w: contains(lower(content), w)))), 6) AS DOUBLE) AS score FROM papers",
    ),
    "graph_recommend": (
        lambda s, d: recommend.graph_scores(edges(s, d), s.createDataFrame([(f"n{i}",) for i in range(5)], "seed string")),
        f"WITH {_EDGES}, x AS (SELECT u AS seed, v AS id FROM e UNION SELECT v, u FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY id) AS r FROM x WHERE seed IN ('n0', 'n1', 'n2', 'n3', 'n4')) SELECT id, CAST(0.5 * count(*) AS DOUBLE) AS score FROM r WHERE r <= 10 GROUP BY id",
    ),
    "hybrid_rank": (
        lambda s, d: recommend.hybrid({"content": (p := table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("score"))), "graph": p.filter("id % 2 = 0"), "gap": p.filter("id % 3 = 0")}, 25).withColumn("score", F.round("score", 6)),
        "WITH g AS (SELECT p_partkey AS id, p_size / 50 * (0.5 + CASE WHEN p_partkey % 2 = 0 THEN 0.3 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 0.2 ELSE 0 END) AS s, 'content' || CASE WHEN p_partkey % 3 = 0 THEN '+gap' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '+graph' ELSE '' END AS reasons FROM part), r AS (SELECT *, row_number() OVER (ORDER BY round(s, 9) DESC, id) AS k FROM g) SELECT id, round(s, 6) AS score, reasons, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 25",
    ),
    "reading_order": (
        lambda s, d: recommend.reading_order(paper_view(s, d), by="topic").select("paper_id", "position", "note"),
        f"WITH {PAPERS}, r AS (SELECT paper_id, row_number() OVER (PARTITION BY topic ORDER BY year, seq) AS p, count(*) OVER (PARTITION BY topic) AS n FROM papers) SELECT paper_id, CAST(p AS INTEGER) AS position, CASE WHEN p = 1 THEN 'start' WHEN p - 1 < n // 2 THEN 'core' ELSE 'recent' END AS note FROM r",
    ),
    "diversified": (lambda s, d: recommend.diversified(paper_view(s, d).select("topic", "paper_id", "title", F.lit(0.9).alias("score"), F.row_number().over(Window.partitionBy("topic").orderBy("seq")).alias("rank")), by="topic", free=1).select("paper_id", F.round("score", 6).alias("score")), _DIVERSE),
    "paper_relevance": (
        lambda s, d: paper_view(s, d).select("paper_id", F.round(papers.relevance(F.col("title"), F.col("topic"), F.col("year") - 2000, "small red brand"), 6).alias("score")),
        f"WITH {PAPERS} SELECT paper_id, round(3 * len(list_filter(['small', 'red', 'brand'], lambda t: contains(lower(title), t))) / 3 + len(list_filter(['small', 'red', 'brand'], lambda t: contains(lower(topic), t))) / 3 + least(year - 2000, 100) / 1000, 6) AS score FROM papers",
    ),
    "paper_dedup": (
        lambda s, d: papers.dedup_by_keys(table(s, d, "part").select(F.concat(F.lit("10/"), F.floor(F.col("p_partkey") / 3)).alias("doi"), F.col("p_name").alias("title"), F.col("p_partkey").alias("seq"))).select("seq", "title"),
        "WITH a AS (SELECT p_partkey AS seq, p_name AS title, row_number() OVER (PARTITION BY p_partkey // 3 ORDER BY p_partkey) AS r FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY seq) AS k FROM a WHERE r = 1) SELECT seq, title FROM b WHERE k = 1",
    ),
}
