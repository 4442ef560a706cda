"""Reports, tools and gap analysis: results that can be worked out by hand."""

import time
import itertools
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import facts, gaps, graph, reports, stats, tools


@pytest.mark.parametrize(("n", "m"), [(2, 2), (3, 4), (5, 5), (1, 3)])
def test_exact_p_against_all_orders(n, m):
    us = []
    for own in itertools.combinations(range(1, n + m + 1), n):
        us.append(sum(own) - n * (n + 1) / 2)
    for u in sorted(set(us)):
        far = max(u, n * m - u)
        assert stats.exact_p(u, n, m) == pytest.approx(min(1, 2 * sum(x >= far for x in us) / len(us)))


def test_mann_whitney_p(spark):
    rows = [("s", "a", v) for v in (6.0, 7.0, 8.0)] + [("s", "b", v) for v in (1.0, 2.0, 3.0)] + [("flat", x, 1.0) for x in "aabb"] + [("one", "a", 1.0), ("one", "b", 2.0), ("one", "b", 3.0)]
    got = {r["k"]: r for r in stats.mann_whitney(spark.createDataFrame(rows, "k string, side string, v double"), "k", "side", "v").collect()}
    assert got["s"]["p"] == pytest.approx(0.1)
    assert got["flat"]["p"] is None and got["one"]["p"] is None
    groups = spark.createDataFrame([("x", 3, 1.0), ("y", 3, 0.5), ("z", 3, float("nan")), ("w", 3, None)], "k string, n int, rho double")
    assert tuple(stats.mean_rho(groups).first()) == (2, 0.75)


def test_white_space_as_unicode_has_it(spark):
    raw = ["a   b", "\x1c a\x1db\x1f", " a　\r\nb  ", "aéb"]
    out = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "t string").select(text.clean(F.col("t"))).collect()]
    import re

    want = [re.sub(r"[^\x00-\x7F]+", " ", re.sub(r"\s+", " ", x)).strip() for x in raw]
    assert out == want
    title = spark.createDataFrame([("short\r\n\tA title of more than twenty characters\r\nrest",)], "t string").select(text.title(F.col("t"))).first()[0]
    assert title == "A title of more than twenty characters"


def test_query_expansion_tests_the_query_alone(spark):
    q = spark.createDataFrame([("attention Transformer",), ("a self attention model",)], "q string")
    got = [r[0] for r in q.select(text.expand_query(F.col("q"), (("attention", "self attention"), ("transformer", "Attention mechanism self attention")))).collect()]
    assert got == ["attention Transformer self attention Attention mechanism self attention", "a self attention model"]


def test_long_chains_are_one_component(spark):
    e = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(300)] + [("x", "y"), ("z", "z")], "u string, v string")
    got = {r["node"]: r["label"] for r in graph.connected_components(e).collect()}
    assert got == {f"{i:04}": "0000" for i in range(301)} | {"x": "x", "y": "x"}


def test_names_in_texts(spark):
    texts = spark.createDataFrame([(1, "A Red ring"), (2, "r"), (3, ""), (4, None), (5, "blue ringed thing")], "id int, text string")
    names = spark.createDataFrame([("a", "red"), ("b", "RING"), ("c", "r"), ("d", ""), ("e", "ringed"), ("f", None), ("g", "ring")], "key string, name string")
    got = {(r["id"], r["key"]) for r in tools.named_in(texts, names).collect()}
    assert got == {(1, "a"), (1, "b"), (1, "c"), (1, "g"), (2, "c"), (5, "b"), (5, "c"), (5, "e"), (5, "g")}


def test_names_that_begin_alike(spark):
    # each text holds one of the names; comparing it with all that begin alike takes far longer than the limit
    names = spark.range(40_000).selectExpr("concat('k', id) key", "format_string('Supplier#%09d', id) name")
    texts = spark.range(40_000).selectExpr("id", "format_string('by SUPPLIER#%09d / x', id * 2) text")
    began = time.time()
    got = {r["id"]: r["key"] for r in tools.named_in(texts, names).collect()}
    assert time.time() - began < 60
    assert got == {i: f"k{2 * i}" for i in range(20_000)}


def test_names_are_resolved_among_many_entities(spark):
    e = spark.range(60_000).selectExpr("concat('e', id) entity_id", "format_string('Supplier#%09d', id) name", "id seq")
    asked = spark.range(30_000).selectExpr("format_string('a supplier#%09d of', id) mention").union(spark.createDataFrame([("SUPPLIER#000000007",), ("lier#00005",), ("none",)], "mention string"))
    began = time.time()
    got = {r["mention"]: r["entity_id"] for r in facts.resolve_names(asked, e).collect()}
    assert time.time() - began < 60
    assert got == {f"a supplier#{i:09} of": f"e{i}" for i in range(30_000)} | {"SUPPLIER#000000007": "e7", "lier#00005": "e50000", "none": None}


def test_claims_name_entities_of_one_name(spark):
    # 20,000 claims and 20,000 entities of one name: the first five of them are each claim's findings
    e = spark.range(20_000).selectExpr("concat('f', id) entity_id", "'FINDING' entity_type", "if(id < 3, 'Hot Ring', 'ring') name", "20000 - id seq").union(spark.createDataFrame([("m", "METHOD", "saw", 2), ("n", "METHOD", "saws", 1)], "entity_id string, entity_type string, name string, seq long"))
    claims = spark.range(20_000).selectExpr("cast(id as string) claim_id", "concat('a ring and SAWS ', id) description", "cast(null as string) method", "'d' domain", "cast(array() as array<string>) findings")
    began = time.time()
    got = tools.enriched_claims(claims, e).collect()
    assert time.time() - began < 60
    assert len(got) == 20_000 and {(r["method"], *r["findings"]) for r in got} == {("n", *[f"f{i}" for i in range(19_999, 19_994, -1)])}


def test_claims_of_one_description(spark):
    # 40,000 claims say the same 1,400 characters, which are looked up once; names of one to four characters among them
    e = spark.createDataFrame([("m", "METHOD", "Zz9", 1), ("d", "DOMAIN", "q", 2), ("f", "FINDING", "word 77 ", 3), ("g", "FINDING", "word 777", 4), ("h", "FINDING", "99z", 5)], "entity_id string, entity_type string, name string, seq long")
    claims = spark.range(40_000).selectExpr("cast(id as string) claim_id", "if(id = 5, null, concat(array_join(transform(sequence(1, 180), i -> concat('word ', i)), ' '), ' Q zZ9')) description", "if(id = 6, 'own', null) method", "if(id = 6, 'own', '') domain", "cast(null as array<string>) findings")
    began = time.time()
    got = {r["claim_id"]: (r["method"], r["domain"], r["findings"]) for r in tools.enriched_claims(claims, e).collect()}
    assert time.time() - began < 40
    assert len(got) == 40_000 and got.pop("5") == (None, None, [])
    assert got.pop("6") == ("own", "own", []) and set(map(repr, got.values())) == {repr(("m", "d", ["f"]))}


def test_grounded_suggestions(spark):
    papers = spark.createDataFrame([(1, 0, "Deep  Learning"), (1, 1, "Graphs"), (1, 2, ""), (2, 0, "Other")], "by int, seq int, title string")
    rows = [(1, 0, "ok", ["deep learning", "GRAPHS and more", "deep learning"]), (1, 1, "one", ["graphs", "graph"]), (1, 2, "", ["deep learning", "graphs"]), (2, 0, "none", ["x"]), (1, 3, "short", [" ", "deep", "graph"])]
    got = tools.grounded_suggestions(spark.createDataFrame(rows, "by int, seq int, title string, source_papers array<string>"), papers).orderBy("seq").collect()
    assert [(r["title"], r["source_papers"]) for r in got] == [("ok", ["Deep  Learning", "Graphs"]), ("short", ["Deep  Learning", "Graphs"])]


def test_parsed_lists_and_kinds(spark):
    one = spark.createDataFrame([("Aspects:\n1. Cost\n 2.Speed \n3.\nno\n10. 4. x",)], "t string").select(tools.numbered_items(F.col("t")), tools.missing_kinds(F.array(F.lit("b")), ("a", "b", "c")), tools.missing_kinds(F.lit(None).cast("array<string>"), ("a",))).first()
    assert one[0] == ["Cost", "Speed", "4. x"] and one[1] == ["a", "c"] and one[2] == ["a"]


def test_paths_and_reach(spark):
    e = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a")], "u string, v string")
    assert tools.shortest_path(e, "a", "e") == ["a", "b", "d", "e"]
    assert tools.shortest_path(e, "a", "zz") == []
    assert tools.shortest_path(e, "a", "a") == ["a"]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "a")], "u string, v string")
    papers = spark.createDataFrame([("t", "a", 1), ("t", "c", 2), ("t", "x", 3), ("u", "q", 1)], "topic string, paper_id string, seq int")
    # a reaches c; x reaches a and c, but comes after them
    assert {r["by"]: round(r["isolation"], 6) for r in tools.isolation(chain, papers, "topic", "paper_id", "seq").collect()} == {"t": 0.666667, "u": 0.0}


def test_papers_are_kept_first_in_order(spark):
    from quillspark.operators import evaluate, papers

    rows = [("q", 1, "10/A", "One"), ("q", 2, "10/a", "Two"), ("q", 3, "10/A", "Three"), ("q", 4, None, " one "), ("q", 5, "", "THREE"), ("q", 6, "10/b", "Two"), ("q", 7, "10/b", "Four"), ("q", 8, None, ""), ("q", 9, None, None), ("p", 1, "10/A", "One")]
    seen_doi, seen_title, want = set(), set(), []
    for q, seq, doi, title in rows:
        if doi and (q, doi) in seen_doi:
            continue
        seen_doi.add((q, doi))
        if (q, (title or "").lower().strip()) in seen_title:
            continue
        seen_title.add((q, (title or "").lower().strip()))
        want.append((q, seq))
    d = spark.createDataFrame(rows, "q string, seq int, doi string, title string").repartition(4)
    assert sorted((r["q"], r["seq"]) for r in papers.dedup_in_order(d, "q").collect()) == sorted(want)
    topics = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5)], "topic string, w double")
    assert [tuple(r) for r in evaluate.best_topic(spark.createDataFrame([(1,)], "id int"), topics, F.col("w")).collect()] == [(1, "a", 1.0)]
    with pytest.raises(ValueError, match="still move"):
        graph.pagerank(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "u string, v string"), rounds=2)


def test_answers(spark):
    hits = spark.createDataFrame([(1, 0.5, 1), (2, None, 2)], "id int, score double, rank int")
    store = spark.createDataFrame([(1, "x" * 900, None, "s"), (2, "y", "T", None)], "id int, content string, title string, source string")
    got = {r["id"]: r for r in tools.passages(hits, store).collect()}
    assert (len(got[1]["content"]), got[1]["title"], got[2]["title"], got[2]["source"], got[2]["score"]) == (500, "Unknown", "T", "", 0.0)
    sources = spark.createDataFrame([("j1", "job", 1), ("j2", "job", 2), ("e1", "experiment", 9)], "source_id string, kind string, updated_at int")
    assert [tools.newest_source(sources, w).first()["source_id"] for w in ("j1", None, "gone")] == ["j1", "j2", "j2"]
    assert tools.newest_source(sources.filter("kind <> 'job'")).first()["source_id"] == "e1"
    facts = spark.range(50).select(F.col("id").cast("string").alias("fact_id"))
    first = [r[0] for r in tools.sampled(facts, 7).collect()]
    assert len(set(first)) == 7 and first == [r[0] for r in tools.sampled(facts.repartition(5), 7).collect()]
    assert first != [r[0] for r in tools.sampled(facts, 7, seed=43).collect()]


def test_collected_runs(spark, tmp_path):
    report = {"phase3_gap_detection": {"topics": [{"confidence_scores": [0.5, 0.25]}, {"error": "x", "confidence_scores": [9.0]}, {"confidence_scores": [1.0]}, {}]}}
    rows = [("/x/experiment_no-nli_llama3.2_latest.run3.json", json.dumps(report)), ("/x/experiment_full_m_latest.run1.json", "{}"), ("/x/other.json", "{}")]
    got = {(r["mode"], r["model"], r["run"]): r["confidences"] for r in reports.collected_runs(spark.createDataFrame(rows, "path string, value string")).collect()}
    assert got == {("no-nli", "llama3.2", 3): [0.5, 0.25, 1.0], ("full", "m", 1): []}
    (tmp_path / "a.bin").write_bytes(b"abc")
    one = reports.file_digests(spark.read.format("binaryFile").load(f"file://{tmp_path}")).first()
    assert (one["sha256"][:8], one["n_bytes"]) == ("ba7816bf", 3)


def test_planned_comparisons(spark):
    runs = spark.createDataFrame([("nli", float(v)) for v in (25, 26, 27, 28, 29)] + [("no-nli", float(v)) for v in (11, 12, 13, 14, 15)] + [("full", 1.0)], "mode string, indicators double")
    got = reports.comparisons(runs, [("H9", "nli", "no-nli"), ("H6", "nli", "full")], ["indicators"]).collect()
    # every run of one mode above every run of the other: U is 25 and p 2 in 252; a mode of one run has no test
    assert [(r["hypothesis"], r["comparison"], r["u"], round(r["p"], 4)) for r in got] == [("H9", "nli vs no-nli", 25.0, 0.0079)]


def test_gap_analysis(spark):
    papers = spark.createDataFrame(
        [("t", "p1", "uses red methods", ["red"], 1), ("t", "p2", "uses red methods too", ["red"], 2), ("t", "p3", "blue ones", ["blue"], 3), ("t", "p4", "blue ones", ["blue"], 4), ("one", "p5", "alone", [], 5)],
        "topic string, paper_id string, content string, keywords array<string>, seq int",
    )
    expected = spark.createDataFrame([("t", "red"), ("t", "cost")], "topic string, aspect string")
    entities = spark.createDataFrame(
        [("f1", "FINDING", "a long finding one", "p1", 1), ("f2", "FINDING", "a long finding two", "p3", 2), ("f3", "FINDING", "short", "p3", 3), ("m", "METHOD", "big model", "p4", 4), ("d", "DOMAIN", "edge", "p4", 5)],
        "entity_id string, entity_type string, name string, source_paper string, seq int",
    )
    facts = spark.createDataFrame([("x1", "f1", "CONTRADICTS", "f2", "p1", 0.9), ("x2", "f1", "CONTRADICTS", "f3", "p1", 0.9), ("x3", "m", "REQUIRES_RESOURCE", "large gpu", "p4", 0.9), ("x4", "d", "HAS_CONSTRAINT", "low power", "p4", 0.9)], "fact_id string, subject_id string, predicate string, object_id string, source_paper string, confidence double")
    edges = spark.createDataFrame([("p1", "p2")], "u string, v string")
    plain = gaps.analyze_gaps(papers, expected, facts, entities, edges, terms=("red", "blue"), aspects=("red",), rules=False).collect()
    kinds = sorted((r["topic"], r["indicator_type"], r["detection_method"]) for r in plain)
    assert kinds == [("t", "FRAGMENTATION", "citation_isolation"), ("t", "FRAGMENTATION", "clustering"), ("t", "INCOMPLETENESS", "coverage"), ("t", "INCONSISTENCY", "fact_contradiction")]
    assert [r["confidence"] for r in sorted(plain, key=lambda r: r["rank"])] == sorted((r["confidence"] for r in plain), reverse=True)
    alone = next(r for r in plain if r["detection_method"] == "citation_isolation")
    assert alone["confidence"] == pytest.approx(1 - 1 / 6) and alone["papers"] == ["p1", "p2", "p3", "p4"]
    assert next(r for r in plain if r["indicator_type"] == "INCONSISTENCY")["confidence"] == 0.5
    quick = gaps.analyze_gaps(papers, expected, facts, entities, edges, "quick", terms=("red", "blue"), aspects=("red",), rules=False)
    assert quick.filter("indicator_type = 'INCONSISTENCY'").count() == 0
    # whatever concerns all papers is about a large model on the edge, which the rules reject; the contradiction's one paper has no method
    judged = gaps.analyze_gaps(papers, expected, facts, entities, edges, terms=("red", "blue"), aspects=("red",), kg_available=False).collect()
    assert [(r["indicator_type"], r["verdict"], r["rank"]) for r in judged] == [("INCONSISTENCY", "PASS", 1)]
    assert judged[0]["confidence"] == judged[0]["adjusted_confidence"] == 0.5
    none = papers.filter("false")
    assert gaps.analyze_gaps(none, expected, facts, entities, edges, rules=False).count() == 0
