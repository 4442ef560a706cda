"""Chunking: windows that start at a fixed stride, cut back to a sentence end. Starts don't depend on cuts, so all windows of a text
are made at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import SECTION_WORDS
from .text import bind, clean


def windows(text: Column, size: int, overlap: int) -> Column:
    """array<struct<start, end, content>> of text: each window cut after the last ". " that begins in its final 100 characters.

    Each step binds what the next one uses, so that nothing is worked out twice.
    """
    return bind(text, lambda t: bind(F.length(t), lambda n: _windows(t, n, size, overlap)))


def _windows(text: Column, n: Column, size: int, overlap: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    raw = F.transform(starts, lambda s: F.struct(s.alias("s"), F.substring(text, s + 1, F.lit(size)).alias("raw")))
    tail = F.transform(raw, lambda x: F.struct(x["s"].alias("s"), x["raw"].alias("raw"), F.length(x["raw"]).alias("len")))
    dot = F.transform(tail, lambda x: F.struct(x["s"].alias("s"), x["raw"].alias("raw"), x["len"].alias("len"), F.locate(" .", F.reverse(F.right(x["raw"], F.lit(100)))).alias("back")))
    # the place of the stop, counted from the end of the window
    cut = F.transform(dot, lambda x: F.struct(x["s"].alias("s"), x["raw"].alias("raw"), F.when((x["s"] + size < n) & (x["back"] > 0) & (x["len"] - x["back"] > 1), x["len"] - x["back"]).otherwise(x["len"]).alias("keep")))
    return F.when(n > 0, F.transform(cut, lambda x: F.struct(x["s"].alias("start"), (x["s"] + x["keep"]).alias("end"), F.substring(x["raw"], F.lit(1), x["keep"]).alias("content")))).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,content:string>>)"))


def chunk_fixed(docs: DataFrame, size: int = 512, overlap: int = 50, least: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of the cleaned text: chunk_id, doc_id, chunk_index, total_chunks, start_char, end_char, content. No shuffle."""
    df = docs.select(F.col(id_col).alias("doc_id"), clean(F.coalesce(text_col, F.lit(""))).alias("t"))
    kept = F.filter(windows(F.col("t"), size, overlap), lambda w: F.length(F.trim(w["content"])) >= least)
    df = df.select("doc_id", kept.alias("w")).select("doc_id", F.size("w").alias("total_chunks"), F.posexplode("w").alias("chunk_index", "c"))
    return df.select(F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "chunk_index", "total_chunks", F.col("c.start").alias("start_char"), F.col("c.end").alias("end_char"), F.trim("c.content").alias("content"))


def is_header(line: Column, words: tuple[str, ...] = SECTION_WORDS) -> Column:
    """A numbered or roman header, a known word in at most seven, or several words in capitals."""
    numbered = line.rlike("^((\\d{1,2}(\\.\\d{1,2})*)|([IVXLC]{1,5}))[.)]?\\s+[A-Z]\\w.{0,48}$")
    known = line.rlike("(?i)^(\\d{1,2}[.)]?\\s+)?(" + "|".join(words) + ")\\b") & (F.size(F.split(line, "\\s+")) <= 7)
    capitals = (F.upper(line) == line) & (F.lower(line) != line) & F.length(line).between(3, 40) & (line.contains(" ") | F.lower(line).isin(*words))
    return (line != "") & (F.length(line) <= 60) & (numbered | known | capitals)


def sections(docs: DataFrame, words: tuple[str, ...] = SECTION_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section_no, section, body: what stands between headers, if there are two or more. In the row, without a shuffle."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.split(F.coalesce(text_col, F.lit("")), "\n").alias("l"))
    at = F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: is_header(F.trim(F.element_at("l", i)), words))
    df = df.withColumn("at", at).filter(F.size("at") >= 2).select("doc_id", "l", "at", F.posexplode("at").alias("k", "line"))
    end = F.coalesce(F.get("at", F.col("k") + 1), F.size("l") + 1)
    body = F.trim(F.array_join(F.slice("l", F.col("line") + 1, end - F.col("line") - 1), "\n"))
    return df.select("doc_id", F.col("k").alias("section_no"), F.trim(F.element_at("l", F.col("line"))).alias("section"), body.alias("body")).filter("body <> ''")


def chunk_sections(docs: DataFrame, size: int = 512, overlap: int = 50, least: int = 100, words: tuple[str, ...] = SECTION_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks by section; chunk_index runs on over a document's sections."""
    s = sections(docs, words, id_col, text_col).withColumn("b", F.trim(F.regexp_replace("body", "\\s+", " "))).withColumn("n", F.length("b"))
    w = s.select("doc_id", "section_no", "section", "n", F.posexplode(windows(F.col("b"), size, overlap)).alias("k", "c"))
    order = Window.partitionBy("doc_id").orderBy("section_no", "k")
    long_enough = F.length(F.trim("c.content")) >= least
    before = F.coalesce(F.max(F.when(long_enough, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = w.withColumn("ok", long_enough | ((before == 0) & (F.col("c.end") >= F.col("n")))).filter("ok")
    return w.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "section", F.trim("c.content").alias("content"))


def chunk_documents(docs: DataFrame, size: int = 512, overlap: int = 50, least: int = 100, words: tuple[str, ...] = SECTION_WORDS) -> DataFrame:
    """By section where a document has sections, by fixed windows where it hasn't."""
    by_section = chunk_sections(docs, size, overlap, least, words)
    rest = docs.join(by_section.select("doc_id").distinct(), "doc_id", "left_anti")
    return by_section.unionByName(chunk_fixed(rest, size, overlap, least).select("doc_id", "chunk_index", F.lit(None).cast("string").alias("section"), "content"))


def weakness_windows(docs: DataFrame, precise: str = "limitations?|weakness(es)?|threats to validity|future work", generic: str = "discussion|conclusions?", most: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, excerpt: text after headers that name weaknesses (1500 characters) and, past 40 % of the text, after generic ones
    (1200); overlapping windows count once, up to most characters; the tail of the text if there is none."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("t"))

    def found(pattern: str, width: int, share: float) -> Column:
        # where each header line begins: the text up to it, by splitting at headers
        parts = F.split(F.col("t"), f"(?im)(?=^\\s*(?:\\d+\\.?\\s*)?(?:{pattern})\\b)")
        starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.aggregate(F.slice(parts, F.lit(1), i - 1), F.lit(0), lambda a, x: a + F.length(x)))
        good = F.filter(starts, lambda s: (s > 0) & (s >= F.length("t") * F.lit(share)))
        return F.transform(good, lambda s: F.struct(s.alias("s"), F.least(s + width, F.length("t")).alias("e")))

    spans = F.array_sort(F.concat(found(precise, 1500, 0.0), found(generic, 1200, 0.4)))
    kind = "struct<e:int,out:string>"
    fold = F.aggregate(spans, F.expr(f"cast(named_struct('e', 0, 'out', '') as {kind})"), lambda a, s: F.when((s["s"] < a["e"]) | (F.length(a["out"]) >= most), a).otherwise(F.struct(s["e"].alias("e"), F.concat(a["out"], F.substring(F.col("t"), s["s"] + 1, s["e"] - s["s"])).alias("out"))))
    return df.withColumn("f", fold["out"]).select("doc_id", F.substring(F.when(F.col("f") == "", F.right("t", F.lit(most))).otherwise(F.col("f")), 1, most).alias("excerpt"))
