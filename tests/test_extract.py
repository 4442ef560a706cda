"""Extraction, retrieval, pairs of claims and models' answers, held against results worked out by hand."""

import json

from pyspark.sql import functions as F

from quillspark.functions import answers
from quillspark.operators import extract, facts, relations, retrieval


def papers(spark, rows):
    return spark.createDataFrame(rows, "paper_id string, seq long, title string, content string, combined string, ea string, ra string")


def test_patterns_with_findings(spark):
    d = spark.createDataFrame([(1, "We train a ResNet and reported an 95.2 % F1 score, Dice; it achieves 3% on MNIST.")], "doc_id int, text string")
    got = {(r["entity_type"], r["name"]) for r in facts.pattern_entities(d).collect()}
    assert got == {("METHOD", "ResNet"), ("METRIC", "F1 score"), ("METRIC", "Dice"), ("DATASET", "MNIST"), ("FINDING", "Result: 95.2 %"), ("FINDING", "Result: 3%")}


def test_extract_prefers_answers(spark):
    whole = json.dumps({"entities": [{"name": "Alpha", "type": "METHOD"}, {"name": "Beta data", "type": "odd"}, {"type": "DOMAIN"}], "relations": [
        {"subject": "alpha", "predicate": "IMPROVES", "object": "beta", "confidence": 0.9, "evidence": "e"}, {"subject": "alpha", "predicate": "NONE SUCH", "object": "beta"},
        {"subject": "alpha", "object": "gamma"}, {"subject": "alpha", "object": "unknown", "confidence": "high"}, {"subject": "Alpha", "object": "UNKNOWN"}]})
    rows = [
        ("a", 1, "One", "Alpha extends Beta data in a long enough sentence.", f"```json\n{whole}\n```", None, None),
        ("b", 2, None, "LSTM improves accuracy because of it all. However, nothing.", "[1]", '[{"name": "Zeta", "type": "nope"}, {"name": "alpha", "type": "METHOD"}]', '[{"subject": "alpha", "object": "alpha"}]'),
        ("c", 3, "Three", "The LSTM improves accuracy on MNIST, because it does. Then it ends.", None, "no JSON", None),
        ("d", 4, "Four", "", None, None, None), ("e", 5, "Five", None, None, None, None),
    ]
    got = extract.extract(papers(spark, rows), "combined", "ea", "ra")
    ents = {(r["entity_type"], r["name"]): (r["entity_id"], r["source_paper"]) for r in got.entities.collect()}
    assert set(ents) == {("PAPER", "One"), ("PAPER", "Unknown"), ("PAPER", "Three"), ("METHOD", "Alpha"), ("CONCEPT", "Beta data"), ("DOMAIN", "unknown"), ("METHOD", "LSTM"), ("METRIC", "accuracy"), ("DATASET", "MNIST")}
    assert ents["METHOD", "Alpha"][1] == "a"
    name = {i: n for (_, n), (i, _) in ents.items()}
    made = sorted((r["source_paper"], name[r["subject_id"]], r["predicate"], name[r["object_id"]], r["confidence"], r["extraction_method"]) for r in got.facts.collect())
    assert made == [
        ("a", "Alpha", "DISCUSSES", "unknown", 0.7, "llm_combined"), ("a", "Alpha", "EXTENDS", "Beta data", 0.6, "pattern"), ("a", "Alpha", "IMPROVES", "Beta data", 0.9, "llm_combined"),
        ("b", "Alpha", "DISCUSSES", "Alpha", 0.7, "llm"), ("c", "LSTM", "APPLIES_TO", "MNIST", 0.6, "pattern"),
    ]
    counts = {r["paper_id"]: (r["entities"], r["llm_facts"], r["pattern_facts"], r["total_facts"]) for r in got.counts.collect()}
    assert counts == {"a": (3, 2, 1, 3), "b": (1, 1, 0, 1), "c": (3, 0, 1, 1)}
    assert extract.totals(got.counts).first() == (3, 7, 5)


def test_extract_of_nothing(spark):
    got = extract.extract(papers(spark, []))
    assert not got.entities.count() and not got.facts.count() and extract.totals(got.counts).first() == (0, 0, 0)


def test_seed_links_what_a_source_names_first(spark):
    chunks = spark.createDataFrame([("s1", 1, "and MNIST there."), ("s1", 0, "A CNN of the ResNet kind"), ("s2", 0, "CNN, LSTM, GRU"), ("s3", 0, None)], "source string, chunk_index int, content string")
    assert {r["paper_id"]: r["content"] for r in extract.source_texts(chunks, width=30).collect()} == {"s1": "A CNN of the ResNet kind and M", "s2": "CNN, LSTM, GRU", "s3": ""}
    got = {(r["subject"], r["object"], r["predicate"], r["source_paper"]) for r in extract.graph_seed(chunks).collect()}
    assert got == {("CNN", "ResNet", "DISCUSSES", "s1"), ("CNN", "MNIST", "DISCUSSES", "s1"), ("ResNet", "MNIST", "DISCUSSES", "s1"), ("LSTM", "GRU", "DISCUSSES", "s2")}


def test_mentions_by_join_and_by_broadcast_agree(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["Red apples and pears", "a pear", "none", "RED", "a pear"])], "i int, sentence string")
    e = spark.createDataFrame([(f"e{i}", "METHOD", n, i) for i, n in enumerate(["pear", "red", "apple", "x"])], "entity_id string, entity_type string, name string, seq int")
    read = lambda most: {r["i"]: [x["entity_id"] for x in r["found"]] for r in facts.mentions(texts, e, most=most).collect()}
    assert read(10) == read(1) == {0: ["e0", "e1", "e2"], 1: ["e0"], 2: [], 3: ["e1"], 4: ["e0"]}


def test_retrieve(spark):
    rows = [(f"c{i}", i // 3, i % 3, f"text {i} of things", [1.0, i / 10]) for i in range(9)]
    store = spark.createDataFrame(rows, "chunk_id string, doc_id int, chunk_index int, content string, embedding array<float>")
    got = retrieval.retrieve(store, "3", [1.0, -1.0], k=2, width=1).orderBy("rank").collect()
    assert [(r["id"], r["context"]) for r in got] == [("c0", "text 1 of things"), ("c3", "text 4 of things")]
    assert {"base_score", "doc_id"} <= set(got[0].asDict()) and "embedding" not in got[0].asDict()
    plain = retrieval.retrieve(store, "text 3", [1.0, 0.0], k=2, rerank=False, where="doc_id = 1").orderBy("rank").collect()
    assert [r["id"] for r in plain] == ["c3", "c4"]
    far = retrieval.retrieve(store, "q", [1.0, 0.0], k=2, scorer=lambda q, t: F.substring(t, 6, 1).cast("double")).orderBy("rank").collect()
    assert [(r["id"], r["score"], r["bi_encoder_score"]) for r in far] == [("c3", 3.0, 0.9578), ("c2", 2.0, 0.9806)]


def test_claim_pairs_and_indicators(spark):
    p = spark.createDataFrame([("t", f"p{i}", i, f"T{i}", "x" * 400) for i in range(8)] + [("u", "q", 1, None, None), ("u", "r", 2, "R", "r")], "topic string, paper_id string, seq int, title string, content string")
    pairs = relations.claim_pairs(p)
    rows = pairs.collect()
    assert len(rows) == 15 + 1 and all(len(r["claim_a"]) == 304 for r in rows if r["topic"] == "t") and {r["claim_a"] for r in rows if r["topic"] == "u"} == {"."}
    scores = spark.createDataFrame([("p0|p3", 0.81234, True), ("p1|p2", 0.2, False)], "pair_id string, score double, contradicts boolean")
    told = spark.createDataFrame([("t", "they differ"), ("u", "They differ."), ("v", "No contradictions detected"), ("w", None)], "topic string, answer string")
    got = {r["topic"]: (r["detection_method"], r["confidence"], r["related_papers"]) for r in relations.contradiction_indicators(pairs, scores, told).collect()}
    assert got == {"t": ("nli_cross_encoder", 0.812, ["p0", "p3"]), "u": ("llm_nli", 0.4, [])}


def _one(spark, f, raw):
    return spark.createDataFrame([(raw,)], "raw string").select(f(F.col("raw")).alias("x")).first()["x"]


def test_gap_answers(spark):
    a = _one(spark, answers.gaps, 'Here: ```json\n[{"gap": "G", "confidence": 0.9, "evidence": ["e", "f"]}, {"title": "H", "type": "x", "evidence": "one", "confidence": "n/a"}]\n```')
    assert [tuple(x) for x in a] == [("G", "", "general", 0.9, ["e", "f"], []), ("H", "", "x", 0.5, ["one"], [])]
    b = _one(spark, answers.gaps, "Intro words here\n1. First gap:\nmore of it\n 2) short\n- Second gap is this")
    assert [(x["title"], x["description"]) for x in b] == [("Intro words here", "Intro words here"), ("First gap", "more of it"), ("Second gap is this", "Second gap is this")]
    assert _one(spark, answers.gaps, "") == [] and not _one(spark, answers.gaps, None)


def test_recommendation_answers(spark):
    a = _one(spark, answers.recommendations, '[{"title": "A title of some length", "type": "incompleteness"}, {"title": "n/a"}, {"description": "Only a description", "priority": "low"}]')
    assert [(x["title"], x["gap_type"], x["priority"]) for x in a] == [("A title of some length", "INCOMPLETENESS", "high"), ("Usulan penelitian", "", "low")]
    b = _one(spark, answers.recommendations, '{"title": "First of the two"}\n{"title": "Second of the two"}')
    assert [x["title"] for x in b] == ["First of the two", "Second of the two"]
    c = _one(spark, answers.recommendations, "1. do a larger study\n2. measure it again")
    assert [(x["title"], x["priority"]) for x in c] == [("1. do a larger study", "medium"), ("measure it again", "medium")]
    assert _one(spark, answers.recommendations, '{"title": "cut off') == []


def test_other_answers(spark):
    w = _one(spark, answers.weaknesses, '{"tersurat": ["- small sample", {"point": "* no control", "quote": "\\"none\\""}], "implicit": [{"basis": "without a point"}]}')
    assert [tuple(x) for x in w["stated"]] == [("small sample", "", ""), ("no control", "", "none")] and w["implied"] == []
    s = _one(spark, answers.selection, 'x {"kata_kunci": ["k"], "suggestions": [{"judul": "J", "papers": ["a", " ", "b"], "gap_type": "g"}, "plain"], "ringkasan": "sum"}')
    assert s["keywords"] == ["k"] and s["summary"] == "sum" and [(x["title"], x["source_papers"], x["gap_type"]) for x in s["suggestions"]] == [("J", ["a", "b"], "G"), ("plain", [], "")]
    assert _one(spark, answers.selection, "only prose")["summary"] == "only prose"
    assert [tuple(x) for x in _one(spark, answers.paper_groups, '[{"paper": "P"}, {"title": "Q", "category": "c"}]')] == [("P", "Lainnya"), ("Q", "c")]
    assert [tuple(x) for x in _one(spark, answers.roadmap, '[{"tasks": ["a", "b"]}, {"phase": "End", "items": ["c"]}]')] == [("Phase 1", ["a", "b"]), ("End", ["c"])]
    r = _one(spark, answers.roadmap, "**Plan**\nFase 1: Theory\n- read papers\n1. write more\n\n## Phase 2 -\n* build it")
    assert [tuple(x) for x in r] == [("Theory", ["read papers", "write more"]), ("Tahap 2", ["build it"])]
    assert [tuple(x) for x in _one(spark, answers.roadmap, "Here is the plan\n- read papers\n")] == [("Rencana Penelitian", ["read papers"])]


def test_legacy_jobs_and_nested_payloads(spark):
    from quillspark.operators import jobs

    raw = spark.createDataFrame([('{"a": {"status": "running", "error": "x"}, "b": {"status": "completed", "message": "m", "error": "e"}, "c": 3}',), ("[1]",), (None,)], "raw string")
    got = {r["job_id"]: (r["status"], r["message"], r["error"]) for r in jobs.legacy_jobs(raw).collect()}
    assert got == {"a": ("queued", jobs.INTERRUPTED, None), "b": ("completed", "m", "e")}
    p = spark.createDataFrame([('{"Text": 1, "k": {"raw": 2, "l": [1, 2], "s": "' + "y" * 200 + '"}}',), ("[]",), ("{",), (None,)], "p string")
    out = [r[0] for r in p.select(jobs.sanitised_json(F.col("p"))).collect()]
    assert json.loads(out[0]) == {"k": {"l": 2, "s": "y" * 160}} and out[1:] == [None, None, None]


def test_strategy_of_lists(spark):
    from quillspark.operators import recommend

    a = spark.createDataFrame([("x", 0.4), ("y", 0.2)], "id string, score double")
    assert recommend.strategy("content", content=a) is a
    assert [(r["id"], round(r["score"], 6)) for r in recommend.strategy("other", content=a, graph=a, k=1).collect()] == [("x", 0.32)]


def test_weakness_windows(spark):
    from quillspark.functions import chunking

    body, late = "x" * 2000, "y" * 1300
    rows = [(0, f"Intro text.\nLimitations\n{body}"), (1, f"{body}\nConclusion\n{late}"), (2, f"Conclusion\n{body}"), (3, "z" * 5000), (4, None), (5, "")]
    got = {r["doc_id"]: r["excerpt"] for r in chunking.weakness_windows(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    # a generic header counts past 40 % of the text only; without a header the text's end does
    assert got == {0: rows[0][1][12:1512], 1: rows[1][1][2001:3201], 2: rows[2][1], 3: "z" * 4000, 4: "", 5: ""}
