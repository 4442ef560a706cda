"""Each operator against brute force on a small corpus with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup as ed
from quillspark.llm import language_id as li
from quillspark.llm import license_scan as ls
from quillspark.llm import minhash_dedup as md
from quillspark.llm import packing as pk
from quillspark.llm import quality_rules as qr
from quillspark.llm import site_quality as sq
from quillspark.llm import source_mix as sm
from quillspark.llm import substring_dedup as sd
from quillspark.llm import token_shards as ts
from quillspark.llm.common import WordHashes, tasks_for, windows_hash
from quillspark.llm.queries import tokenizer_path

# columns named like those that operators make
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n int, size int, digest string, copies int"


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, base = prose(70), prose(200)
    texts = [prose(rng.randint(1, 150)) for _ in range(30)]
    texts += [base] * 6 + [base.replace(" ", "\n", 9) + " "]
    for _ in range(25):
        w = base.split()
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [f"{prose(rng.randint(0, 60))} {passage} {prose(rng.randint(0, 60))}" for _ in range(12)]
    texts += [None, "", " \n\t", "one", "one", "a b c", " x ", "word " * 300, "x#y | z\nx#y | z\n", prose(6000), "Été où À.", "<|endoftext|> 7's 77 don't"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "\U0001f600", "z", None][i * i % 5], 0, None, 1, 2, "d", 3) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language_id_codes_every_character():
    rng = random.Random(8)
    # letters in the thousands: two languages with no letter in common, and one of Latin letters
    scripts = {"ja": range(0x4E00, 0x4E00 + 2000), "zh": range(0x6000, 0x6000 + 2000), "en": range(97, 123)}
    prose = {lang: [chr(rng.choice(of)) for _ in range(6000)] for lang, of in scripts.items()}
    model = li.Model({lang: li.plain("".join(t[:5000])) for lang, t in prose.items()})
    got, scores = model.predict(["".join(t[100:400]) for t in prose.values()])
    assert got == list(prose) and min(scores) > 0.5
    assert model.alphabet.n > 2 * li.ALPHABET
    # a character that no sample has is not taken for one that a sample has
    assert model.alphabet.encode("\u0416")[0].tolist() == [model.alphabet.n - 1]


def test_language_id_learns_every_language(spark):
    rows = [(i, f"{chr(0x4E00 + i // 4)} {chr(0x5E00 + i // 4)}" * 9, f"l{i // 4:03}") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    learned = {r["lang"] for r in docs.filter(~li.held_out()).select("lang").distinct().collect()}
    assert len(learned) > 300
    assert set(li.learn(docs).langs) == learned


def words(t):
    return (t or "").encode().split()


def test_quality_rules(docs, empty):
    got = {r["doc_id"]: r for r in qr.quality_rules(docs).collect()}
    for i, t, *_ in corpus():
        w, r = words(t), got[i]
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), len(covered), len(lines) - len(set(lines)))
        assert r["word_chars"] == sum(len(x.decode()) for x in w)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert qr.quality_rules(empty).count() == 0


def test_line_rules(spark):
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(11)) + "."
    bad = ["HOME ABOUT CONTACT US NOW", "Home | About | Contact | Help", "a*** b### c$$$ d%%% e&&& f***", "Please enable JavaScript to go on reading here.", "this line does not end as prose would end it"]
    rows = [(0, "\n".join(prose() for _ in range(9))), (1, "\n".join([prose() for _ in range(6)] + bad * 3))]
    got = {r["doc_id"]: r for r in qr.quality_rules(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[0]["kept"]
    assert not got[1]["kept"]
    assert got[1]["n_lost_words"] == 3 * sum(len(b.split()) for b in bad)


def test_white_space_at_line_ends(spark):
    rng = random.Random(4)
    lines = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(11)) + "." for _ in range(9)]
    ends = ["", " " * 9, "\t" * 12, "\r", " \t\x0b\x0c\r " * 5]
    rows = [(i, "\n".join(x + e for x in lines)) for i, e in enumerate(ends)] + [(9, "\n".join(x[:-1] + " " * 20 for x in lines))]
    got = {r["doc_id"]: r for r in qr.quality_rules(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [got[i]["kept"] for i in (0, 1, 2, 3, 4, 9)] == [True] * 5 + [False]
    assert qr.quality_rules(spark.createDataFrame([(0, "Bitte alle Cookies annehmen, und dann geht es weiter.")], "doc_id int, text string"), phrases=("alle cookies",)).first()["n_lost_words"] == 9


def test_exact_dedup(docs, empty):
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    for batches in (1, 2, 4):
        got = {r["doc_id"]: r for r in ed.exact_dedup(docs, batches).collect()}
        for n, g in groups.items():
            for _, i in g:
                r = got[i]
                assert (r["keep_id"], r["group_size"], r["kept"]) == (min(g)[1], len(g), i == min(g)[1])
                assert r["text_sha256"] == hashlib.sha256(n.encode()).hexdigest()
    assert ed.exact_dedup(empty).count() == 0
    assert ed.without_copies(docs).columns == docs.columns
    assert ed.without_copies(docs).count() == len(groups)
    assert ed.exact_dedup(docs.unionByName(docs.filter("doc_id = 3"))).filter("doc_id = 3").select("group_size").first()[0] == 2


def test_screen_beyond_the_broadcast(docs, monkeypatch):
    rows = ed.digests(docs)
    snap = ed.freeze(ed._grouped(rows.filter("doc_id < 50")))
    batch = ed._grouped(rows)
    small = {bytes(r["digest"]): r["hit"] for r in ed.screen(batch, snap).collect()}
    monkeypatch.setattr(ed, "FILTER_BYTES", -1)
    assert {bytes(r["digest"]): r["hit"] for r in ed.screen(batch, snap).collect()} == small
    inside = {bytes(r["digest"]) for r in snap.groups.collect()}
    assert all(small[d] for d in inside)
    assert sum(small.values()) < len(small)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 30000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys, others = rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**64, 20000, np.uint64)
    f = ed.Filters([(2, *ed.fuse_build(keys))])
    assert f.hits(np.full(n, 2), keys).all()
    assert f.hits(np.full(20000, 2), others).mean() < 0.01
    assert not f.hits(np.full(5, 1), others[:5]).any()


def shingles(t):
    w = [x.lower() for x in words(t)]
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block", [256, 4, 2])
def test_minhash_dedup(docs, empty, monkeypatch, block):
    monkeypatch.setattr(md, "BLOCK_ROWS", block)
    sets = {r[0]: shingles(r[1]) for r in corpus()}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {i: lo if x == hi else x for i, x in label.items()}
    got = {r["doc_id"]: r for r in md.minhash_dedup(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == label
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (label[i] == i) for i, r in got.items())
    assert len(set(label.values())) < len(label) - 10
    assert md.minhash_dedup(empty).count() == 0
    assert md.without_near_copies(docs).columns == docs.columns


@pytest.mark.parametrize("block", [256, 16, 5])
def test_minhash_dedup_of_chains_and_clusters(spark, monkeypatch, block):
    """Groups that share passages but split into clusters, and chains whose ends are not alike: every link is found across blocks."""
    monkeypatch.setattr(md, "BLOCK_ROWS", block)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for c in range(4):  # clusters that share half of their words, a chain of small steps in each
        own = base[:70] + [f"c{c}x{i}" for i in range(50)]
        for _ in range(30):
            own = list(own)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = f"n{rng.randint(0, 40)}"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in md.minhash_dedup(d).collect()} == dict(enumerate(label))
    assert 4 <= len(set(label)) < 40


@pytest.mark.parametrize("percent", [40, 50, 60, 80, 85, 100])
def test_overlap_follows_percent(percent):
    tail = sum(math.comb(md.K, i) * (percent / 100) ** i * (1 - percent / 100) ** (md.K - i) for i in range(md.overlap(percent)))
    assert tail <= 1e-9
    assert md.overlap(85) == 23
    with pytest.raises(ValueError):
        md.overlap(20)


def test_small_sets_always_share_listed_values():
    for n in range(1, md.K + 1):
        assert 1 <= md.least_overlap(n, 85) <= n
    assert md.least_overlap(md.K + 1, 85) == md.OVERLAP


@pytest.mark.parametrize("hot", [2000, 0])
def test_substring_dedup(docs, empty, hot):
    first, rows = {}, corpus()
    for i, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    got = {r["doc_id"]: r for r in sd.substring_dedup(docs, hot_bucket=hot, with_text=True).collect()}
    total = 0
    for i, t, *_ in rows:
        w = words(t)
        gone = {j + k for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for k in range(50)}
        kept, r = b" ".join(x for j, x in enumerate(w) if j not in gone), got[i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
        assert r["kept_text"].encode() == kept
        total += len(gone)
    assert total > 1000
    assert sd.substring_dedup(empty).count() == 0
    again = sd.substring_dedup(docs.unionByName(docs.filter("doc_id = 40")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    assert again.count() == len(rows) + 2


@pytest.mark.parametrize("hot", [2000, 0])
def test_contents_of_equal_power_sums(spark, hot):
    """One super-k-mer a document: blocks by Thue-Morse parity against their complement, whose sums over powers of any odd base agree modulo 2^64."""
    hashes = WordHashes()
    least = min(([f"{s}m{i}".encode() for i in range(10)] for s in range(30_000)), key=lambda w: int(windows_hash(hashes.of(w), 10, seed=2)[0]))
    text = lambda flip: b" ".join(b" ".join([*least, b"xx" if (bin(i).count("1") + flip) % 2 else b"yy", b"u%d" % i]) for i in range(512))
    a, b = text(0).split(), text(1).split()
    assert len(sd.super_kmers(hashes.of(a), 50, 10)[0]) == 1
    windows = lambda t: {tuple(t[j : j + 50]) for j in range(len(t) - 49)}
    assert not windows(a) & windows(b)
    d = spark.createDataFrame([(1, text(0).decode()), (2, text(1).decode()), (3, text(0).decode() + " end")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in sd.substring_dedup(d, hot_bucket=hot).collect()} == {1: 0, 2: 0, 3: len(a)}


def test_language_id(spark, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "12 !", "de"), (10**6 + 2, "", None)], "doc_id long, text string, lang string")
    r = li.language_id(d.select("doc_id", "text", "lang").unionByName(extra)).collect()
    lang = {x["doc_id"]: x["lang"] for x in d.collect()}
    held = [x for x in r if x["held_out"] and x["doc_id"] in lang]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in r)
    assert sum(x["lang_pred"] == lang[x["doc_id"]] for x in held) / len(held) > 0.97
    assert all(0 <= x["score"] <= 1 for x in r)
    assert {x["lang_pred"] for x in r if x["doc_id"] >= 10**6} == {"und"}
    assert li.language_id(empty).count() == 0
    assert {x["lang_pred"] for x in li.language_id(extra.withColumn("text", F.lit("hello")).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_parse_against_brute_force():
    samples = {"a": "the cat sat on the mat and the dog", "b": "le chat est sur la table du chien"}
    m = li.Model(samples)

    def phrases(sample, t):
        i = n = 0
        while i < len(t):
            k = 1
            while i + k < len(t) and t[i : i + k + 1] in sample:
                k += 1
            i, n = i + k, n + 1
        return n

    for t in ("the cat on the table", "le dog du mat", "zzz", "a"):
        codes, _ = m.alphabet.encode(t)
        got = m.phrases([codes])[0].tolist()
        assert got == [phrases(samples[x], t) for x in m.langs]


@pytest.mark.parametrize("stretch", [7, 1024])
def test_parse_of_whole_texts(monkeypatch, stretch):
    """Phrases don't depend on where stretches end: texts of thousands of characters, also such as repeat themselves."""
    monkeypatch.setattr(li, "STRETCH", stretch)
    rng = random.Random(stretch)
    prose = lambda n, of: " ".join("".join(rng.choices(of, k=rng.randint(1, 8))) for _ in range(n))
    samples = {"a": prose(300, "abcde"), "b": prose(300, "defgh"), "c": "abab ab " * 40 + "cd " * 50}
    m = li.Model(samples)

    def phrases(sample, t):
        i = n = 0
        while i < len(t):
            k = 1
            while i + k < len(t) and t[i : i + k + 1] in sample:
                k += 1
            i, n = i + k, n + 1
        return n

    texts = [prose(900, "abcdefgh"), "ab" * 3000, "abab ab cd " * 500, "cd " * 2000 + prose(50, "xyab"), "a", samples["a"][:1000] + samples["b"], "zz" * 600, "abc" * stretch]
    texts = [li.plain(t) for t in texts]
    got = m.phrases([m.alphabet.encode(t)[0] for t in texts])
    assert got.tolist() == [[phrases(samples[x], t) for x in m.langs] for t in texts]


def test_language_id_of_rare_planes_and_sizes(spark):
    d = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(chr(0x30000) * 20 + " " + chr(0x30010) * 9, "han"), ("plain words here", "en")] * 12)], "doc_id long, text string, lang string")
    got = {(r["lang"], r["lang_pred"]) for r in li.language_id(d).join(d.select("doc_id", "lang"), "doc_id").collect()}
    assert got == {("han", "han"), ("en", "en")}
    assert 2 * li.TOTAL_CHARS * li.ALPHABET * 4 <= li.MODEL_BYTES
    # rows that repeat, ties between languages, and columns of other names
    same = d.withColumn("text", F.lit("one and the same text")).withColumn("score", F.lit(1)).withColumn("held_out", F.lit(None).cast("int"))
    assert {r["lang_pred"] for r in li.language_id(same.unionByName(same)).collect()} == {"en"}


def test_license_scan_of_rows(spark):
    """Rows without doc_id and rows that repeat one are scanned one by one; other columns change nothing."""
    notice = ls.KNOWN[2][1]
    rows = [(None, notice), (None, "prose"), (None, f"{notice}\n{notice}"), (1, "prose"), (1, notice), (2, None), (3, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x")).withColumn("licence", F.lit(1))
    got = collections.Counter((r["doc_id"], r["n_notices"], r["notices"]) for r in ls.license_scan(d).collect())
    assert got == collections.Counter([(None, 1, "MIT"), (None, 0, ""), (None, 2, "MIT"), (1, 0, ""), (1, 1, "MIT"), (2, 0, ""), (3, 0, "")])
    same = collections.Counter((r["doc_id"], r["n_notices"], r["notices"]) for r in ls.license_scan(d, ls.known_licences(spark)).collect())
    assert same == got


def test_licence_anchors(spark):
    """No known text is passed over for want of a word, however it is spelt."""
    forms = [r[0] for r in spark.createDataFrame([*ls.KNOWN, *ls.full_texts()], "n string, t string").select(ls.canonical(F.col("t"))).collect()]
    found = ls.anchors(forms)
    assert all(found)
    for f in forms:
        for b, a in ls.SPELLINGS:
            assert any(x in f.replace(a, b) for x in found)


def test_license_scan(spark, docs, empty):
    mit = dict((b, a) for a, b in ls.KNOWN)
    rows = [(0, "copyright (c) 2020 someone\n" + ls.KNOWN[-2][1].upper()), (1, "Some prose.\nreleased under the mit licence\nMore."), (2, None), (3, "nothing"), (4, "MIT License"), (5, "Copyright 2000 X")]
    got = {r["doc_id"]: r for r in ls.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert mit and got[0]["text_licence"] == "ISC"
    assert (got[1]["text_licence"], got[1]["notices"], got[1]["n_notices"]) == (None, "MIT", 1)
    assert [got[i]["notices"] for i in (2, 3, 4, 5)] == [""] * 4
    assert ls.license_scan(docs).count() == len(corpus())
    assert ls.license_scan(empty).count() == 0


def test_license_scan_of_wrapped_files(spark):
    full = {}
    for name, text in ls.full_texts():
        full.setdefault(name, text)
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0"} <= set(full)
    head = {"MIT": "MIT License\n\nCopyright (c) 2020 Someone\n\n", "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) 2021, X\nAll rights reserved.\n\n", "ISC": "Copyright 2001 Y\n\n"}
    fill = lambda t, n: "\n\n".join("\n".join(textwrap.wrap(p, n)) for p in re.split(r"\n\s*\n", t))
    short = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD"]
    rows = [(f"{name} {n}", head.get(name, "") + fill(full[name], n)) for name in short for n in (40, 72, 78)]
    rows += [(name, text) for name, text in full.items() if name not in short]
    pages = [(f"page {name}", f"Some prose.\n\n{fill(full[name], 70)}\n\nMore prose.") for name in short]
    notice = [("wrapped", "Prose.\n\n  Licensed under the\n  Apache License, Version 2.0.\n\nMore.")]
    got = {r["doc_id"]: r for r in ls.license_scan(spark.createDataFrame(rows + pages + notice, "doc_id string, text string")).collect()}
    assert {i: got[i]["text_licence"] for i, _ in rows} == {i: i.split()[0] for i, _ in rows}
    for i, _ in pages:
        assert (got[i]["text_licence"], got[i]["notices"], got[i]["n_notices"]) == (None, i.split()[1], 1)
    assert (got["wrapped"]["notices"], got["wrapped"]["n_notices"]) == ("Apache-2.0", 1)


def test_site_quality(spark, docs, empty):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = sq.site_quality(d, labels).join(labels, "doc_id").collect()
    assert sum(x["kept"] for x in r if x["quality"] == 1) >= 0.99 * sum(x["quality"] for x in r)
    assert sum(not x["kept"] for x in r if x["quality"] == 0) >= 0.9 * sum(1 - x["quality"] for x in r)
    none = labels.filter("false")
    assert sq.site_quality(docs, none).filter("kept").count() == len(corpus())
    assert sq.site_quality(empty, none).count() == 0
    assert sq.good_documents(docs, labels).columns == docs.columns
    sites = {x["doc_id"]: x["path_score"] for x in sq.site_quality(docs, labels).collect()}
    assert all(0 < v < 1 for v in sites.values())


def test_site_posteriors_by_hand(spark):
    """Hosts and paths, null ones too, a site of one row, repeated rows, ties and clashing names against plain Python."""
    rng = random.Random(6)
    good = lambda: " ".join(rng.choices(["plain", "words", "of", "good", "prose", "here"], k=60)) + "."
    junk = lambda: "### | BUY $$$ !!! " * rng.randint(3, 9)
    sites = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), (None, None)]
    rows = [(i, good() if rng.random() < (0.9 if sites[i % 6][0] == "a" else 0.3) else junk(), *sites[i % 6]) for i in range(90)]
    rows += [(90, good(), "lone", "p"), (91, None, "b", "x"), (92, "", "b", "x"), rows[3], rows[3], (None, good(), "a", "y")]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, lang string, no long").withColumn("logit", F.lit(0)).withColumn("n", F.lit(1)).repartition(3)
    labels = spark.createDataFrame([(i, int("BUY" not in t)) for i, t, *_ in rows[:60]] + [(5, None), (999, 1)], "doc_id long, quality int")
    got = sq.site_quality(d, labels, row_col="no").join(d.select(F.col("no").alias("row"), "source", "lang", "text"), "row").collect()
    assert len(got) == len(rows)
    n, mean = len(got), sum(r["doc_score"] for r in got) / len(got)

    def sums(key):
        out = collections.defaultdict(list)
        for r in got:
            out[key(r)].append(r["doc_score"])
        return out

    def strength(sites):
        between = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in sites.values())
        within = mean * (1 - mean)
        spread = (between - (len(sites) - 1) * within) / max(1, n - sum(len(v) ** 2 for v in sites.values()) / n)
        return min(1000, max(5, within / max(spread, 1e-9) - 1))

    hosts, paths = sums(lambda r: r["source"]), sums(lambda r: (r["source"], r["lang"]))
    a, b = strength(hosts), strength(paths)
    odds = lambda p: math.log(max(p, 1e-6) / max(1 - p, 1e-6))
    for r in got:
        h, p, s = hosts[r["source"]], paths[r["source"], r["lang"]], r["doc_score"]
        host = (sum(h) + a * mean) / (len(h) + a)
        assert r["host_score"] == pytest.approx(host)
        assert r["path_score"] == pytest.approx((sum(p) + b * host) / (len(p) + b))
        above = (sum(h) - s + a * mean) / (len(h) - 1 + a)
        others = (sum(p) - s + b * above) / (len(p) - 1 + b)
        assert r["quality_score"] == pytest.approx(1 / (1 + math.exp(-(odds(s) + odds(others) - odds(mean)))), rel=1e-6, abs=1e-9)
        assert r["kept"] == (r["quality_score"] >= 0.5)
    lone = next(r for r in got if r["source"] == "lone")
    # nothing but the document itself speaks for its site, so the global rate stands for it
    assert lone["quality_score"] == pytest.approx(lone["doc_score"], abs=1e-6)


def test_words_are_evidence(spark):
    """Texts alike in all counts are told apart by their words."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["abcd", "efgh", "ijkl"] if i % 2 else ["mnop", "qrst", "uvwx"], k=80)), "s", "l") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in sq.site_quality(d, labels).collect()}
    assert all(got[i] == bool(i % 2) for i in range(300, 400))


def test_fit_by_gradient():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, len(sq.FEATURES) + 3)), (rng.random(300) < 0.4).astype(float)
    m = sq.fit(x, y)
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    w = np.array(m.weights) * (x.std(0) + 1e-9)
    p = 1 / (1 + np.exp(-(x @ np.array(m.weights) + m.bias)))
    penalty = np.array([1.0] * len(sq.FEATURES) + [sq.WORD_RIDGE] * 3)
    assert np.abs(z.T @ (y - p) - penalty * w).max() < 1e-6
    assert m.rate == y.mean()


def test_source_mix(spark, docs, empty):
    got = {r["doc_id"]: r for r in sm.mix_sources(docs).collect()}
    size = {r[0]: len(words(r[1])) for r in corpus()}
    source = {r[0]: r[3] for r in corpus()}
    names = sorted({s for s in source.values() if s}) + [None]
    totals = [sum(n for i, n in size.items() if source[i] == s) for s in names]
    want = dict(zip(names, sm.level_targets(totals, [1 + i % 3 for i in range(len(names))], 3), strict=True))
    taken = collections.Counter()
    for i, r in got.items():
        assert r["size"] == size[i]
        assert r["target"] == pytest.approx(want[source[i]])
        assert r["taken"] <= 3 * r["size"]
        taken[source[i]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(n for i, n in size.items() if source[i] == s) / 2 + 1 for s in names)
    assert {r["doc_id"]: r["taken"] for r in sm.mix_sources(docs.repartition(3)).collect()} == {i: r["taken"] for i, r in got.items()}
    assert sm.mix_sources(empty).count() == 0
    m = sm.mixed_documents(docs)
    assert m.columns == docs.columns
    assert m.count() == sum(r["copies"] for r in got.values())


def test_targets(spark, monkeypatch):
    assert sm.level_targets([10, 100, 100], [1, 2, 3], 3) == pytest.approx([30, 72, 108])
    assert sum(sm.level_targets([5, 5, 1000], [1, 2, 3], 3)) == pytest.approx(1010)
    rows = spark.createDataFrame([("=a", "a", 5, 1), ("=b", "b", 50, 1), ("=c", "c", 1000, 1), ("", None, 7, 1)], "k string, source string, source_size long, n_rows long")
    small = {r["k"]: r["target"] for r in sm.source_targets(rows, (1, 2, 3), 3).collect()}
    monkeypatch.setattr(sm, "DRIVER_SOURCES", 0)
    assert {r["k"]: r["target"] for r in sm.source_targets(rows, (1, 2, 3), 3).collect()} == pytest.approx(small)


def test_flight_holds_totals():
    rng = np.random.default_rng(0)
    size = np.sort(rng.integers(0, 500, 400))[::-1]
    p = np.full(400, 0.37)
    out = sm.fly(p, size, np.random.default_rng(1), False)
    assert ((out > 0) & (out < 1)).sum() <= 3
    assert out.sum() == pytest.approx(p.sum())
    assert out @ size == pytest.approx(p @ size)
    landed = sm.fly(p, size, np.random.default_rng(1), True, p @ size)
    assert set(landed) <= {0.0, 1.0}
    assert abs(landed @ size - p @ size) <= 0.005 * (p @ size)


@pytest.mark.parametrize("sizes", [[50] * 10, [5000, *range(300, 0, -1)], [9, 9, 9, 4, 4, 1, 0, 0], [7, 5]])
def test_flight_keeps_inclusion_probabilities(sizes):
    size = np.array(sizes)
    p = np.random.default_rng(3).uniform(0.1, 0.9, len(size))
    runs = np.array([sm.fly(p, size, np.random.default_rng(seed), True, 1e9) for seed in range(1500)])
    # five standard errors
    assert np.abs(runs.mean(0) - p).max() < 5 * np.sqrt(0.25 / len(runs))
    if len(size) > 100:
        assert np.abs(runs @ size - p @ size).max() < 50


def test_mix_of_repeated_rows_and_clashing_names(spark):
    rows = [(i % 7 if i % 5 else None, f"w{i} " * (1 + i % 4), "ab"[i % 2]) for i in range(80)] + [(None, None, None), (None, "", "a"), (9, "x", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("row", "row_no", "copies", "__copies", "target"):
        d = d.withColumn(c, F.lit(0))
    mixed = sm.mixed_documents(d)
    assert mixed.columns == d.columns
    taken = sm.mix_sources(d).agg(F.sum("copies")).first()[0]
    assert mixed.count() == taken
    most = collections.Counter(r["text"] for r in mixed.collect())
    own = collections.Counter(t for _, t, _ in rows)
    assert all(n <= 3 * own[t] for t, n in most.items())


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in corpus()}


def test_packing(docs, empty, ids):
    got = pk.pack(docs, tokenizer_path(), with_ids=True).collect()
    seen, windows = collections.defaultdict(dict), collections.defaultdict(list)
    for r in got:
        own = np.frombuffer(r["ids"], "<u4")
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]][r["start"]] = own.tolist()
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in ids.items():
        assert [x for s in sorted(seen[i]) for x in seen[i][s]] == own
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(windows) <= total / 2048 + 2
    assert pk.pack(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 9, 300])
def test_differencing(n):
    x = np.random.default_rng(n).integers(1, 1025, n)
    w = pk.pack_group(x, 2048)
    loads = np.bincount(w, x)
    assert loads.max() <= 2048
    assert len(loads) <= max(1, x.sum() / 2048 * 1.06 + 1)


@pytest.mark.parametrize("most_words", [400_000, 500])
def test_encoder_against_the_tokenizer(most_words):
    from tokenizers import Tokenizer

    from quillspark.llm.tokens import Encoder

    rng, own, t = random.Random(2), Encoder(tokenizer_path(), most_words), Tokenizer.from_file(tokenizer_path())
    # letters whose lower-case or composed form ends in a mark, final sigmas, marks of their own, digits, other scripts
    chars = "aZe7 0.,!?;:*$%#&|'\"\u2019-\u0130\u0130\u0131\u03a3\u03c2\u00c9e\u0301\ufb1d\u0915\u0903\u4e2d\u1e9e \n\t\u00a0"
    texts = ["\u0130K\u0130. T\u00dcRK\u0130YE \u0130Y\u0130, GEZ\u0130."] + ["".join(rng.choices(chars, k=rng.randint(0, 30))) for _ in range(6000)]
    for at in range(0, len(texts), 300):
        some = texts[at : at + 300]
        flat, ends = own.encode(pa.array(some), 1)
        for x, begin, end in zip(some, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            assert flat[begin:end].tolist() == [*t.encode(x, add_special_tokens=False).ids, 1], x


def test_token_shards(spark, docs, empty, ids, tmp_path):
    path = f"file://{tmp_path}/shards"
    rows = ts.token_shards(docs, tokenizer_path(), path, length=64, per_shard=32, waves=3).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    shards = {s: ts.read_shard(spark, path, s) for s in {r["shard"] for r in rows}}
    assert [len(shards[s]) for s in sorted(shards)][:-1] == [32] * (len(shards) - 1)
    for r in rows:
        own = shards[r["shard"]][r["byte_offset"] // r["stride"]]
        assert (r["byte_offset"] // r["stride"], r["shard"]) == (r["slot"] % 32, r["slot"] // 32)
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"]
        assert own[: r["n_tokens"]].tolist() == ids[r["doc_id"]][r["part"] * 64 : (r["part"] + 1) * 64]
        assert not own[r["n_tokens"] :].any()
    assert len(rows) == sum(-(-len(x) // 64) for x in ids.values())
    made = ts.read_manifest(spark, path)
    assert (made["n_sequences"], made["n_shards"], made["stride"], made["per_shard"]) == (len(rows), len(shards), 129, 32)
    # the same slots however the input is split and the ranges are cut
    slots = {(r["doc_id"], r["part"]): r["slot"] for r in rows}
    again = ts.token_shards(docs.repartition(7), tokenizer_path(), length=64, n_tasks=3, waves=1).collect()
    assert {(r["doc_id"], r["part"]): r["slot"] for r in again} == slots
    assert ts.token_shards(empty, tokenizer_path(), f"{path}-none").count() == 0
    assert ts.read_manifest(spark, f"{path}-none")["n_sequences"] == 0


def test_tasks_grow_with_the_plan(spark, docs):
    least = 4 * spark.sparkContext.defaultParallelism
    assert tasks_for(docs.limit(5)) == tasks_for(spark.range(10)) == least
    big = spark.range(10**10)
    assert tasks_for(big) == 8 * 10**10 // (256 << 20) and tasks_for(big, most=100) == 100
    # a product of unknown sizes has no known size
    assert tasks_for(big.crossJoin(big.toDF("b"))) == least


def test_token_shards_of_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b"), (None, "a b"), (None, None), (3, "c"), (3, "c"), (3, "d d"), (2, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit(9)).withColumn("ids", F.lit(1))
    got = ts.token_shards(d.repartition(3), tokenizer_path()).collect()
    assert sorted(r["slot"] for r in got) == list(range(7))
    assert sum(r["doc_id"] is None for r in got) == 3
    with pytest.raises(Exception, match="fit 1 bytes"):
        ts.token_shards(d, tokenizer_path(), width=1)


def test_shards_of_the_registered_query(spark):
    from quillspark.llm.queries import queries

    r = queries()["op7_token_shards"](spark, "/root/testdata/sf0.001").orderBy("slot").limit(50).collect()
    grid = ts.read_shard(spark, r[0]["path"], 0)
    assert [zlib.crc32(grid[i].tobytes()) for i in range(50)] == [x["ids_crc32"] for x in r]


@pytest.mark.parametrize("n", [1, 2, 5, 17, 1000, 4097, 65537])
def test_feistel_is_a_permutation(spark, n):
    out = [tuple(r) for r in spark.range(n).select(ts.feistel_slots(F.col("id"), n, 7), ts.feistel_slots(F.col("id"), n, 8)).collect()]
    assert sorted(a for a, _ in out) == list(range(n))
    assert n < 1000 or sum(a != b for a, b in out) > 0.9 * n
    assert n < 1000 or sum(a != i for i, (a, _) in enumerate(out)) > 0.9 * n
