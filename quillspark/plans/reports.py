"""Queries over reports: indicators of orders, runs of nations and suppliers, themes, tools and gap analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gaps, reports, tools
from .knowledge import NAMES, edges
from .views import ENTITIES, FACTS, PAPERS, entities, facts, papers, table


def indicators(s, d):
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "fragmentation").when(F.col("o_orderstatus") == "O", "Inconsistency").otherwise("INCOMPLETENESS")
    verdict = F.when(k % 4 == 0, "PASS").when(k % 4 == 1, "verdict flag").when(k % 4 == 2, "REJECT")
    return o.select(k.alias("seq"), F.col("o_orderpriority").alias("topic"), kind.alias("indicator_type"), verdict.alias("verdict"), ((k % 97) / 100).alias("confidence"), F.when(k % 3 == 0, (k % 97) / 200).alias("adjusted_confidence"))


_IND = """ind AS (SELECT o_orderpriority AS topic, CASE o_orderstatus WHEN 'F' THEN 'fragmentation' WHEN 'O' THEN 'Inconsistency' ELSE 'INCOMPLETENESS' END AS kind,
 CASE o_orderkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'verdict flag' WHEN 2 THEN 'REJECT' END AS verdict, (o_orderkey % 97) / 100 AS c, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 97) / 200 END AS adj FROM orders)"""
_TOPICS = f"""WITH {_IND} SELECT topic, count(*) AS total_indicators, count(*) FILTER (WHERE kind = 'fragmentation') AS n_fragmentation, count(*) FILTER (WHERE kind = 'Inconsistency') AS n_inconsistency, count(*) FILTER (WHERE kind = 'INCOMPLETENESS') AS n_incompleteness,
 count(*) FILTER (WHERE verdict = 'PASS') AS n_pass, count(*) FILTER (WHERE verdict = 'verdict flag') AS n_flag, count(*) FILTER (WHERE verdict = 'REJECT') AS n_reject, count(*) FILTER (WHERE verdict IS NULL) AS n_none,
 round(avg(c), 3) AS avg_confidence, round(max(c), 3) AS max_confidence, round(min(c), 3) AS min_confidence FROM ind GROUP BY topic"""
_COUNTS = "count(*) FILTER (WHERE verdict IS NOT NULL) AS n, count(*) FILTER (WHERE verdict = 'PASS') AS p, count(*) FILTER (WHERE verdict = 'verdict flag') AS f, count(*) FILTER (WHERE verdict = 'REJECT') AS r"


def runs(s, d):
    """A run a nation: the balances of its even suppliers as confidences, all of them as the recorded mean."""
    sup = table(s, d, "supplier").withColumn("c", F.col("s_acctbal") / 10_000)
    kept = F.transform(F.sort_array(F.collect_list(F.when((F.col("s_suppkey") % 4 == 0) & (F.col("s_nationkey") % 5 != 0), F.struct("s_suppkey", "c")))), lambda x: x["c"])
    return sup.groupBy(F.col("s_nationkey").alias("run")).agg(kept.alias("confidences"), F.avg("c").alias("avg_confidence"))


def claims(s, d):
    """A claim a supplier, which names it, its nation and a part; every third has a method and a domain already."""
    sup, n, p = table(s, d, "supplier"), table(s, d, "nation"), table(s, d, "part")
    j = sup.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(p, F.col("p_partkey") == F.col("s_suppkey"))
    own = lambda v: F.when(F.col("s_suppkey") % 3 == 0, F.lit(v))
    return j.select(F.col("s_suppkey").cast("string").alias("claim_id"), F.concat_ws(" / ", F.upper("s_name"), "n_name", "p_name").alias("description"), own("m").alias("method"), own("d").alias("domain"), F.array().cast("array<string>").alias("findings"))


_ENRICHED = f"""WITH {ENTITIES}, c AS (SELECT s_suppkey AS k, lower(s_name || ' / ' || n_name || ' / ' || p_name) AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN part ON p_partkey = s_suppkey),
 nm AS (SELECT DISTINCT entity_type, lower(name) AS n FROM entities), h AS (SELECT c.k, nm.* FROM c JOIN nm ON contains(t, n) WHERE k % 3 <> 0), m AS (SELECT k, e.entity_type, e.entity_id, e.seq FROM h JOIN entities e ON e.entity_type = h.entity_type AND lower(e.name) = h.n),
 f AS (SELECT k, string_agg(entity_id, ',' ORDER BY seq) AS findings FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS r FROM m WHERE entity_type = 'FINDING') WHERE r <= 5 GROUP BY k)
SELECT CAST(c.k AS VARCHAR) AS claim_id, CASE WHEN c.k % 3 = 0 THEN 'm' ELSE (SELECT arg_min(entity_id, seq) FROM m WHERE m.k = c.k AND entity_type = 'METHOD') END AS method, CASE WHEN c.k % 3 = 0 THEN 'd' ELSE (SELECT arg_min(entity_id, seq) FROM m WHERE m.k = c.k AND entity_type = 'DOMAIN') END AS domain, coalesce(findings, '') AS findings FROM c LEFT JOIN f ON f.k = c.k"""


def sections(s, d):
    docs = table(s, d, "documents").select("doc_id", F.concat(F.lit("cover\nINTRO PART\n"), "text", F.lit("\nRESULTS\n"), F.substring("text", 1, 300), F.lit("\nEND\nshort")).alias("text"))
    return tools.sections_of(docs).select("chunk_id", "section", F.md5("content").alias("content_md5"), "chunk_index", "total_chunks")


_HEAD = r"\n([A-Z][A-Z\s\x0B\x1C-\x1F]+)\n"
_SECTIONS = rf"""WITH d AS (SELECT doc_id, 'cover' || chr(10) || 'INTRO PART' || chr(10) || text || chr(10) || 'RESULTS' || chr(10) || substr(text, 1, 300) || chr(10) || 'END' || chr(10) || 'short' AS t FROM documents),
 p AS (SELECT doc_id, regexp_extract_all(t, '{_HEAD}', 1) AS h, string_split_regex(t, '{_HEAD}') AS b FROM d), x AS (SELECT doc_id, unnest(generate_series(1, len(h))) AS i, h, b FROM p),
 y AS (SELECT doc_id, i, regexp_replace(h[i], '^\s+|\s+$', '', 'g') AS section, regexp_replace(b[i + 1], '^[\s\x0B\x1C-\x1F]+|[\s\x0B\x1C-\x1F]+$', '', 'g') AS content FROM x)
SELECT doc_id || '_section_' || (row_number() OVER w - 1) AS chunk_id, section, md5(content) AS content_md5, CAST(row_number() OVER w - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks FROM y WHERE length(content) >= 100 WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


def isolated(s, d):
    """A nation and its suppliers as papers; the nation refers to each of them, they to nothing."""
    sup = table(s, d, "supplier").select(F.col("s_nationkey").alias("topic"), F.concat(F.lit("s"), "s_suppkey").alias("paper_id"), F.col("s_suppkey").cast("long").alias("seq"))
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("topic"), F.concat(F.lit("n"), "n_nationkey").alias("paper_id"), F.lit(-1).cast("long").alias("seq"))
    return tools.isolation(edges(s, d), sup.unionByName(n), "topic", "paper_id", "seq").select(F.col("by").alias("topic"), "n_papers", F.round("isolation", 6).alias("isolation"))


def gap_rows(s, d):
    p = papers(s, d)
    expected = p.select("topic").distinct().join(F.broadcast(s.createDataFrame([("ring",), ("blue ring",), ("gadget",), ("economy",)], "aspect string")))
    f = facts(s, d).join(p.select(F.col("paper_id").alias("object_id")), "object_id", "left_semi")
    return gaps.analyze_gaps(p, expected, f, entities(s, d), terms=NAMES, aspects=NAMES, kg_available=False).select("topic", "indicator_id", "indicator_type", "detection_method", F.round("confidence", 6).alias("confidence"), "verdict", "rank")


def compared(s, d):
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("mode"), F.round(F.col("o_totalprice") / 1000).alias("price"), (F.col("o_orderkey") % 13).alias("rest"))
    return reports.comparisons(o, [("H1", "1-URGENT", "2-HIGH"), ("H2", "1-URGENT", "5-LOW"), ("H3", "2-HIGH", "none")], ["price", "rest"]).select("hypothesis", "comparison", "variable", "n1", "n2", F.round("u", 6).alias("u"))


_COMPARED = """WITH pl AS (SELECT * FROM (VALUES ('H1', '1-URGENT', '2-HIGH'), ('H2', '1-URGENT', '5-LOW'), ('H3', '2-HIGH', 'none')) t(h, a, b)), v AS (SELECT o_orderpriority AS m, 'price' AS variable, CAST(round(o_totalprice / 1000) AS DOUBLE) AS v FROM orders UNION ALL SELECT o_orderpriority, 'rest', o_orderkey % 13 FROM orders),
 x AS (SELECT h, a || ' vs ' || b AS comparison, variable, m = a AS first, v FROM v JOIN pl ON m IN (a, b)), r AS (SELECT *, rank() OVER (PARTITION BY h, variable ORDER BY v) + (count(*) OVER (PARTITION BY h, variable, v) - 1) / 2.0 AS r FROM x),
 g AS (SELECT h, comparison, variable, count(*) FILTER (WHERE first) AS n1, count(*) FILTER (WHERE NOT first) AS n2, sum(r) FILTER (WHERE first) AS s FROM r GROUP BY ALL)
SELECT h AS hypothesis, comparison, variable, n1, n2, round(CAST(s - n1 * (n1 + 1) / 2 AS DOUBLE), 6) AS u FROM g WHERE n1 >= 2 AND n2 >= 2"""

QUERIES = {
    "topic_results": (lambda s, d: reports.topic_results(indicators(s, d)), _TOPICS),
    "verdict_rates": (lambda s, d: reports.verdict_rates(reports.topic_results(indicators(s, d))), f"WITH {_IND}, t AS (SELECT {_COUNTS} FROM ind) SELECT n AS total_evaluated, p AS n_pass, f AS n_flag, r AS n_reject, round(p / n * 100, 1) AS pass_rate, round(f / n * 100, 1) AS flag_rate, round(r / n * 100, 1) AS reject_rate FROM t"),
    "overall_metrics": (
        lambda s, d: reports.overall_metrics(indicators(s, d)),
        f"WITH {_IND}, t AS (SELECT count(*) AS k, count(DISTINCT topic) AS m, avg(c) AS c, avg(coalesce(adj, c)) AS a, {_COUNTS} FROM ind) SELECT k AS total_indicators, m AS topics_analyzed, round(c, 3) AS avg_confidence, round(a, 3) AS avg_adjusted_confidence, round(p / n * 100, 1) AS pass_rate, round(f / n * 100, 1) AS flag_rate, round(r / n * 100, 1) AS reject_rate, round(round(f / n * 100, 1) + round(r / n * 100, 1), 1) AS rerr FROM t",
    ),
    "indicator_counts": (lambda s, d: reports.counts_by_type(indicators(s, d)), f"WITH {_IND} SELECT 'type' AS kind, kind AS key, count(*) AS n FROM ind GROUP BY ALL UNION ALL SELECT 'verdict', verdict, count(*) FROM ind WHERE verdict IS NOT NULL GROUP BY ALL"),
    "adversarial_accuracy": (
        lambda s, d: reports.adversarial_accuracy(table(s, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderkey") % 3 == 0, "PASS").otherwise("FLAG").alias("expected")), indicators(s, d).filter("seq % 5 <> 0").select(F.col("seq").alias("claim_id"), "verdict")),
        "SELECT count(*) AS total_cases, count(*) FILTER (WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 AND o_orderkey % 4 = 0) AS correct, round(count(*) FILTER (WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 AND o_orderkey % 4 = 0) / count(*) * 100, 1) AS accuracy FROM orders",
    ),
    "run_means": (lambda s, d: reports.run_means(runs(s, d)).select("run", F.round("mean_confidence", 6).alias("mean_confidence")), "SELECT s_nationkey AS run, round(coalesce(avg(s_acctbal / 10000) FILTER (WHERE s_suppkey % 4 = 0 AND s_nationkey % 5 <> 0), avg(s_acctbal / 10000)), 6) AS mean_confidence FROM supplier GROUP BY 1"),
    "run_figures": (
        lambda s, d: reports.run_figures(table(s, d, "supplier").select("s_nationkey", "s_acctbal", (F.col("s_suppkey") % 7).alias("f"), (F.col("s_suppkey") % 11).alias("t")), ["s_nationkey"], "s_acctbal", "f", "t"),
        "SELECT s_nationkey, count(*) AS n_runs, round(avg(s_acctbal), 6) AS mean, round(stddev_samp(s_acctbal), 6) AS std, round(avg(CASE WHEN s_suppkey % 11 > 0 THEN (s_suppkey % 7) / (s_suppkey % 11) * 100 END), 6) AS rerr FROM supplier GROUP BY 1",
    ),
    "ablation_table": (
        lambda s, d: reports.ablation(table(s, d, "orders").filter("not (o_orderpriority = '5-LOW' and o_orderstatus = 'P')"), ["1-URGENT", "5-LOW", "not run"], ["F", "O", "P"], "o_orderpriority", "o_orderstatus", "o_totalprice"),
        "SELECT x AS o_orderpriority, CAST(i AS INTEGER) AS place, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 6) AS F, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 6) AS O, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P' AND x <> '5-LOW'), 6) AS P FROM (VALUES ('1-URGENT', 0), ('5-LOW', 1), ('not run', 2)) t(x, i) LEFT JOIN orders ON o_orderpriority = x GROUP BY x, i",
    ),
    "mode_comparisons": (compared, _COMPARED),
    "paper_themes": (
        lambda s, d: reports.themes(papers(s, d), "topic"),
        f"WITH {PAPERS}, k AS (SELECT topic, seq, unnest(generate_series(1, len(keywords))) AS i, keywords FROM papers), g AS (SELECT topic, keywords[i] AS theme, count(*) AS n, min(seq * 100 + i) AS f FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, f) AS r FROM g) SELECT topic, CAST(r AS INTEGER) AS rank, theme, n FROM r WHERE r <= 5",
    ),
    "paper_methods": (
        lambda s, d: reports.methodologies(papers(s, d), "topic", ("widget", "red", "none of it", "ring", "small"), most=3).select("topic", F.array_join("methods", ",").alias("methods")),
        f"WITH {PAPERS}, h AS (SELECT topic, list_filter(['widget', 'red', 'none of it', 'ring', 'small'], lambda t: list_bool_or(list_transform(list(lower(content)), lambda c: contains(c, t)))) AS m FROM papers GROUP BY topic) SELECT topic, array_to_string(m[1:3], ',') AS methods FROM h",
    ),
    "job_evaluation": (
        lambda s, d: reports.job_evaluation(table(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).alias("n_gaps"), (F.col("s_suppkey") % 3).alias("n_recs"), (F.col("s_suppkey") % 5).alias("n_topics"), (F.col("s_suppkey") % 7).alias("n_facts"), (F.col("s_suppkey") % 2).alias("n_entities"), (F.col("s_suppkey") % 2 == 0).alias("full_mode"), (F.col("s_suppkey") % 6 == 0).alias("has_report"))).select("s_suppkey", "topic_coverage", "recommendation_completeness", "kg_density", "pipeline_score"),
        "SELECT s_suppkey, round(least((s_suppkey % 4) / greatest(s_suppkey % 5, 1), 1), 3) AS topic_coverage, round(least((s_suppkey % 3) / greatest(s_suppkey % 4, 1), 1), 3) AS recommendation_completeness, round((s_suppkey % 7) / greatest(s_suppkey % 2, 1), 3) AS kg_density, CAST(round(CASE WHEN s_suppkey % 2 = 0 THEN 0.2 ELSE 0.1 END + 0.2 * ((s_suppkey % 7 > 0)::INT + (s_suppkey % 4 > 0)::INT + (s_suppkey % 6 = 0)::INT + (s_suppkey % 3 > 0)::INT), 3) AS DOUBLE) AS pipeline_score FROM supplier",
    ),
    "detection_method": (
        lambda s, d: reports.by_description(table(s, d, "orders").select("o_orderkey", F.concat(F.lit("p"), F.col("o_orderkey") % 50).alias("description")), table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey") % 40).alias("description"), F.col("p_type").alias("method"), F.col("p_partkey").alias("seq")), "method", "unspecified").select("o_orderkey", "method"),
        "WITH l AS (SELECT 'p' || (p_partkey % 40) AS d, arg_max(p_type, p_partkey) AS m FROM part GROUP BY 1) SELECT o_orderkey, coalesce(m, 'unspecified') AS method FROM orders LEFT JOIN l ON d = 'p' || (o_orderkey % 50)",
    ),
    "rater_means": (
        lambda s, d: reports.means(table(s, d, "labels").withColumn("q", F.when(F.col("doc_id") % 3 != 0, F.col("quality"))).withColumn("lot", F.col("doc_id") % 5), ["lot"], ["q", "toxic"], 2),
        "SELECT doc_id % 5 AS lot, round(avg(quality) FILTER (WHERE doc_id % 3 <> 0), 2) AS q, round(avg(toxic), 2) AS toxic FROM labels GROUP BY 1",
    ),
    "facts_answer": (
        lambda s, d: tools.facts_answer(facts(s, d), predicate="EXTENDS").select("fact_id", "rank", "total"),
        f"WITH {FACTS}, r AS (SELECT fact_id, row_number() OVER (ORDER BY seq, fact_id) AS r, count(*) OVER () AS n FROM facts WHERE predicate = 'EXTENDS') SELECT fact_id, CAST(r AS INTEGER) AS rank, n AS total FROM r WHERE r <= 50",
    ),
    "entities_answer": (
        lambda s, d: tools.entities_answer(entities(s, d), "DOMAIN", most=10).select("entity_id", "rank", "total").unionByName(tools.entities_answer(entities(s, d), "no type", most=10).select("entity_id", "rank", "total")),
        f"WITH {ENTITIES}, r AS (SELECT entity_id, row_number() OVER (ORDER BY seq, entity_id) AS r, count(*) OVER () AS n FROM entities WHERE entity_type = 'DOMAIN' UNION ALL SELECT entity_id, row_number() OVER (ORDER BY seq, entity_id), count(*) OVER () FROM entities) SELECT entity_id, CAST(r AS INTEGER) AS rank, n AS total FROM r WHERE r <= 10",
    ),
    "enriched_claims": (lambda s, d: tools.enriched_claims(claims(s, d), entities(s, d)).select("claim_id", "method", "domain", F.array_join("findings", ",").alias("findings")), _ENRICHED),
    "caps_sections": (sections, _SECTIONS),
    "isolation": (isolated, "SELECT s_nationkey AS topic, count(*) + 1 AS n_papers, round(1 - count(*) / ((count(*) + 1) * count(*) / 2), 6) AS isolation FROM supplier GROUP BY 1 UNION ALL SELECT n_nationkey, 1, 0.0 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)"),
    "citation_graph": (
        lambda s, d: tools.paper_graph(papers(s, d).select("paper_id", "title"), table(s, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("citing"), F.concat(F.lit("s"), "l_suppkey").alias("cited")))[0],
        "SELECT 'p' || p_partkey AS node, 'PAPER' AS kind, p_name AS label FROM part UNION ALL SELECT DISTINCT x, 'PAPER', x FROM (SELECT 's' || l_suppkey AS x FROM lineitem UNION SELECT 'p' || l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))",
    ),
    "cluster_top_terms": (
        lambda s, d: tools.top_terms(table(s, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("cluster")), table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("degree"))).select("cluster", "size", F.array_join(F.col("top_terms").cast("array<string>"), ",").alias("top_terms")),
        "WITH g AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(n, 0) DESC, s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier LEFT JOIN g ON l_suppkey = s_suppkey) SELECT s_nationkey AS cluster, c AS size, string_agg(s_suppkey, ',' ORDER BY r) AS top_terms FROM r WHERE r <= 3 GROUP BY ALL",
    ),
    "gap_analysis": (gap_rows, None),
}
