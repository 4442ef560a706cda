"""Licence scans by canonical digests, in built-in functions only.

A text becomes canonical: lower case, copyright lines out, equivalent spellings made one, everything but letters and digits
to single blanks. Its SHA-256 is joined with the digests of known licences, which are made the same way. The texts looked
up are each whole document, with its line breaks folded too, each whole line, each block between blank lines with its
line breaks folded, and runs of blocks. So a full licence file is found however it is wrapped, and so are a wrapped
notice in a page and a full licence there, if it is parted by blank lines as in the files under licences/.

Whole texts are hash-joined with the known digests, which go by broadcast only if they are few, as is checked. Lines and blocks are
looked up within their row, so nothing but the known digests moves; they are made canonical only in texts that have one of
the words without which none of the known texts can be there.

Null and empty texts have no licence. Rows are scanned one by one, whether their doc_id is repeated or null. Other columns of the
input are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: More known digests than this are joined by shuffle.
FEW = 20_000
#: Spellings that mean the same, as in the SPDX matching guidelines.
SPELLINGS = (("licence", "license"), ("favour", "favor"), ("merchantability and", "merchantability or"), ("sub licence", "sublicense"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("organisation", "organization"), ("initialise", "initialize"), ("judgement", "judgment"), ("whilst", "while"), ("wilful", "willful"), ("gnu gpl", "gnu general public license"))
#: Notices of well-known licences; their full texts are files in licences/.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
)


#: Titles that stand before a licence's text or don't.
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "ISC": ("ISC License", "The ISC License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD")}
#: Copyright lines of wrapped texts, where a line can begin with the word by chance.
OWNER = "(?m)^[^a-z0-9\n]*(copyright[ \t]*(\\(c\\)|©|[0-9<\\[{]|by )|\\(c\\)[ \t]*([0-9<\\[]|copyright)|©|all rights reserved)[^\n]*$"


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files in licences/, with numbered clauses and without numbers."""
    out = []
    for path in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out.append((path.stem, text))
        if path.stem.startswith("BSD"):
            out.append((path.stem, re.sub(r"(?m)^\d\. ", "", text)))
    return out


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty if nothing is left."""
    return _letters(F.regexp_replace(F.lower(text), "(?m)^[^a-z0-9\n]*(copyright|\\(c\\)|©)[^\n]*$", ""))


def _letters(out: Column) -> Column:
    out = F.trim(F.regexp_replace(out, "[^\\p{L}\\p{N}]+", " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def known_licences(spark: SparkSession, licences: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """digest, licence: one row per digest; of licences with one text the first by name."""
    rows = spark.createDataFrame(list(licences), "licence string, text string")
    return rows.select("licence", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("licence").alias("licence"))


def _blocks(text: Column) -> Column:
    """The blocks of a text that have letters or digits: canonical form with line breaks folded, whether there were any."""
    bare = F.regexp_replace(F.lower(text), OWNER, "")
    parts = F.transform(F.split(bare, "\n[ \t\r\f]*(?=\n)"), lambda b: F.struct(_letters(b).alias("f"), F.contains(F.trim(b, F.lit(" \t\r\n\f")), F.lit("\n")).alias("wrapped")))
    return F.filter(parts, lambda p: p["f"] != "")


def known_blocks(spark: SparkSession, licences: tuple[tuple[str, str], ...] = KNOWN) -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """(licences by digest of the folded text, with titles or not; licences with the digests of their blocks)."""
    full = full_texts()
    titled = full + [(name, f"{title}\n\n{text}") for name, text in full for title in TITLES.get(name, ())]
    fold = lambda rows: spark.createDataFrame(rows, "licence string, text string").select("licence", _blocks(F.col("text"))["f"].alias("f"))
    whole = fold([*licences, *titled]).select("licence", F.sha2(F.array_join("f", " "), 256)).collect()
    parts = fold([*licences, *full]).select("licence", F.transform("f", lambda x: F.sha2(x, 256))).distinct().collect()
    return {digest: licence for licence, digest in sorted(map(tuple, whole), reverse=True)}, [(licence, digests) for licence, digests in parts]


def anchors(texts: list[str]) -> list[str]:
    """Strings one of which every lower-case text has that becomes one of these canonical texts.

    A word of a canonical text stood in the text as it is, unless a spelling made it; all spellings of licence begin alike.
    """
    made = [w for _, b in SPELLINGS for w in b.split()]
    out = set()
    for t in texts:
        safe = [w for w in t.split() if w.isascii() and not any(m in w or w in m for m in made)]
        out.add("licen" if "licens" in t else max(safe, key=lambda w: (len(w), w), default=""))
    return sorted(a for a in out if not any(b != a and b in a for b in out))


def _line_notices(text: Column, known: dict[str, str]) -> Column:
    """The licences of a text's lines, in order."""
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.element_at(names, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())


def _block_notices(blocks: Column, parts: list[tuple[str, list[str]]]) -> Column:
    """The licences that stand as runs of blocks; of runs that begin at one block the longest counts."""
    order = sorted(parts, key=lambda x: (len(x[1]), x[0]), reverse=True)
    known = F.array(*[F.struct(F.lit(licence).alias("licence"), F.array(*[F.lit(d) for d in digests]).alias("ds")) for licence, digests in order])
    firsts = sorted({d[0] for _, d in parts})
    rows = F.transform(blocks, lambda b: F.struct(F.sha2(b["f"], 256).alias("d"), b["wrapped"].alias("wrapped")))

    def longest(rows: Column, b: Column, i: Column) -> Column:
        # a block of one line is looked up as a line
        here = F.filter(known, lambda k: (F.transform(F.slice(rows, i + 1, F.size(k["ds"])), lambda r: r["d"]) == k["ds"]) & ((F.size(k["ds"]) > 1) | b["wrapped"]))
        return F.when(b["d"].isin(firsts), F.get(here, F.lit(0))["licence"])

    # an array of one, so that the digests are made once
    return F.filter(F.flatten(F.transform(F.array(rows), lambda r: F.transform(r, lambda b, i: longest(r, b, i)))), lambda x: x.isNotNull())


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_sha256 (of the canonical text), text_licence, n_notices, notices (names, sorted).

    If known is given (digest, licence), only its digests are looked up: of whole documents and lines.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    if known is not None:
        return _scan_of(texts, known)
    lines = {r["digest"]: r["licence"] for r in known_licences(spark).collect()}
    wholes, parts = known_blocks(spark)
    full = [(name, text) for name, text in full_texts()]
    forms = [r[0] for r in spark.createDataFrame([*KNOWN, *full], "licence string, text string").select(F.array_join(_blocks(F.col("text"))["f"], " ")).distinct().collect()]
    some = F.lit(False)
    for a in anchors(forms):
        some = some | F.contains(F.col("low"), F.lit(a))
    rows = texts.withColumn("low", F.lower("t")).withColumn("some", some)
    rows = rows.withColumn("blocks", F.when(F.col("some"), _blocks(F.col("t"))))
    rows = rows.select(
        "doc_id",
        F.sha2(canonical(F.col("t")), 256).alias("digest"),
        F.when(F.col("some"), F.sha2(F.array_join("blocks.f", " "), 256)).alias("folded"),
        F.when(F.col("some"), F.concat(_line_notices(F.col("t"), lines), _block_notices(F.col("blocks"), parts))).otherwise(F.array().cast("array<string>")).alias("found"),
    )
    by_fold = spark.createDataFrame(list(wholes.items()), "folded string, full string")
    by_digest = spark.createDataFrame(list(lines.items()), "digest string, licence string")
    out = rows.join(F.broadcast(by_digest), "digest", "left").join(F.broadcast(by_fold), "folded", "left")
    licence = F.coalesce("licence", "full")
    return out.select("doc_id", F.col("digest").alias("text_sha256"), licence.alias("text_licence"), F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))


def _scan_of(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The same for any number of known digests: lines are joined with them, and their finds with their rows."""
    if known.count() <= FEW:
        known = F.broadcast(known)
    rows = staged(texts.withColumn("row", F.monotonically_increasing_id()), "licence-rows")
    lines = rows.select("row", F.explode(F.split("t", "\n")).alias("line")).select("row", F.sha2(canonical(F.col("line")), 256).alias("digest"))
    found = lines.join(known, "digest").groupBy("row").agg(F.count("*").alias("n_notices"), F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("notices"))
    whole = rows.select("row", "doc_id", F.sha2(canonical(F.col("t")), 256).alias("digest")).join(known, "digest", "left")
    out = whole.join(found, "row", "left")
    return out.select("doc_id", F.col("digest").alias("text_sha256"), F.col("licence").alias("text_licence"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))
