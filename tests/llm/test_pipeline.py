"""The stages in turn, each judged on its own input, and the registered queries."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from quillspark.llm import queries as q
from quillspark.llm.site_quality import good_documents

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.staged(stage(spark, docs, SF), f"test-{name}")
        after = docs.collect()
        sizes.append((name, len(before), len(after)))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality_classifier":
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            assert not [i for i in gone if labels.get(i) == 1]
        if name == "exact_dedup":
            assert len({"".join((r["text"] or "").split()) for r in after}) == len(after)
        if name == "source_mix":
            assert max(collections.Counter(r["doc_id"] for r in after).values()) <= 3
        if name == "packing":
            assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}
            assert sum(r["length"] for r in after if r["start"] == 0) > 0
    assert all(b > 0 for _, _, b in sizes)


def test_near_stage_takes_four_fifths(spark):
    words = [f"w{i}" for i in range(100)]
    # 96 shingles each: nine changed words leave 87 of 105 (0.829), twelve 84 of 108 (0.778)
    texts = [words, words[:91] + [f"x{i}" for i in range(9)], [f"v{w}" for w in words], [f"v{w}" for w in words[:88]] + [f"y{i}" for i in range(12)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()} == {0, 2, 3}


def test_rows_are_judged_one_by_one(spark):
    text = lambda of: " ".join(f"{of}{i}" for i in range(60))
    a, b = text("a"), text("b")
    near = a.replace("a59", "a60")
    rows = [(3, a), (5, a), (5, b), (7, b), (7, b), (None, a), (None, text("c")), (None, text("c")), (8, text("d")), (8, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    want = sorted([(3, a), (5, b), (None, text("c")), (8, text("d")), (8, text("e"))], key=repr)
    assert kept(stages["exact_dedup"](spark, docs, SF)) == want
    assert kept(stages["near_dedup"](spark, docs, SF)) == want
    more = docs.unionByName(spark.createDataFrame([(5, near, "en", "s", 0), (None, near, "en", "s", 0)], docs.schema))
    assert kept(stages["near_dedup"](spark, more, SF)) == want


def test_quality_stage_rejects_rows_not_ids(spark):
    good, junk = " ".join(f"plain{chr(97 + i % 26)}" for i in range(90)), "### | BUY $$$ !!! " * 30
    rows = [(i, good if i % 2 else junk) for i in range(40)] + [(90, good), (90, junk), (None, good), (None, junk)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    after = sorted(((r["doc_id"], r["text"]) for r in good_documents(docs, labels).collect()), key=repr)
    assert after == sorted([(i, t) for i, t in rows if t == good], key=repr)


def corner_rows():
    text = lambda of: " ".join(f"{of}{chr(97 + i % 26)}" for i in range(60))
    rows = [(1, None, "en", "s"), (2, None, None, None), (3, "", "en", None), (4, " \n\t", None, "s"), (None, None, "en", "s"), (None, "", None, None)]
    rows += [(i, text(f"t{i % 4}q"), "en" if i % 3 else None, "s" if i % 2 else None) for i in range(10, 40)]
    return rows + rows[8:11] + [(50, "long " * 20_000, "en", "s"), (51, "two words", "en", "s"), (52, "two words", "de", "s")]


def test_stages_on_corner_cases(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names the stages use themselves."""
    docs = spark.createDataFrame(corner_rows(), "doc_id long, text string, lang string, source string").repartition(3)
    for c in ("n", "row", "row_no", "copies", "row_no_copies", "kept", "component", "digest", "size", "key", "label", "p", "batch"):
        docs = docs.withColumn(c, F.lit(None).cast("int"))
    own = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        rows = after.collect()
        if name == "packing":
            assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
            continue
        assert after.columns == docs.columns
        got = collections.Counter((r["doc_id"], r["text"]) for r in rows)
        assert set(got) <= set(own)
        if name == "exact_dedup":
            assert sum(not (t or "").split() for _, t in got.elements()) == 1
            assert len({"".join((t or "").split()) for _, t in own}) == sum(got.values())
        if name == "near_dedup":
            assert sum(not (t or "").split() for _, t in got.elements()) == sum(not (t or "").split() for _, t in own)
            assert sum(t == "two words" for _, t in got.elements()) == 1
        if name == "source_mix":
            assert all(n <= 3 * own.count(k) for k, n in got.items())


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        assert after.count() == 0
        assert name == "packing" or after.columns == docs.columns


def test_registered():
    assert sorted(q.queries(), key=lambda n: int(n[2:].split("_")[0])) == [n for n in q.queries()]
    assert [int(n[2:].split("_")[0]) for n in q.queries()] == list(range(1, 11))
