"""Line-first quality rules, in built-in functions only.

Each line is judged on its own: does it end as prose does, is it navigation, is it boilerplate? Lines that fail are
taken out; a document is rejected if too large a share of its words goes with them, or if the base counts fail.

Null and empty texts: no words, all counts 0, base_failed (under 50 words), not kept. Repeated rows are judged one by
one; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD

SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture; a line with one of them fails.
BOILERPLATE = ("lorem ipsum", "javascript", "cookie policy", "privacy policy", "terms of use", "all rights reserved", "click here", "sign in", "log in", "subscribe now", "share this", "read more")
#: What may end a line of prose.
ENDS = tuple(".!?:;,\"'”’»)…")
#: Characters that part the entries of a menu.
SEPARATORS = "|»•"


def _n(text: Column, of: str) -> Column:
    """How many characters of text are in of; replace() finds bytes, where translate() and patterns go by character."""
    rest = text
    for c in of:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.length(text) - F.length(rest)


def _words(c: Column) -> Column:
    """The words of a line or text: what is between white space."""
    return F.filter(F.split(c, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _any(text: Column, of: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [text.contains(x) for x in of])


def line_fails(line: Column, furniture: Column, marks: Column, phrases: tuple[str, ...] = BOILERPLATE) -> Column:
    """Whether a line is navigation, boilerplate, shouting, symbols, or doesn't end as prose does, white space aside.

    furniture and marks: whether the document has a boilerplate phrase, a symbol or a separator at all.
    """
    return (
        ((F.length(line) >= 20) & ~F.right(F.rtrim(line, F.lit(SPACES)), F.lit(1)).isin(*ENDS))
        | ((F.length(line) >= 8) & ~line.rlike("\\p{Ll}") & line.rlike("\\p{Lu}"))
        | (marks & ((_n(line, SEPARATORS) >= 3) | (_n(line, SYMBOLS) * 12 > F.length(line))))
        | (furniture & _any(F.lower(line), phrases))
    )


def quality_rules(docs: DataFrame, max_lost: float = 0.4, phrases: tuple[str, ...] = BOILERPLATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, the words that line rules remove, the cleaned text, and the verdict.

    phrases: what makes a line boilerplate, in lower case; the default is English, other languages bring their own.
    """
    at = lambda a, i: F.element_at(a, i)
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("furniture", _any(F.lower("t"), phrases)).withColumn("marks", _any(F.col("t"), tuple(SYMBOLS + SEPARATORS)))
    df = df.withColumn("good", F.filter("lines", lambda x: ~line_fails(x, F.col("furniture"), F.col("marks"), phrases)))
    df = df.withColumn("w", _words(F.col("t")))
    df = df.withColumn("n_words", F.size("w").cast("long"))
    # (hash of three words, position) in order: equal windows stand side by side
    df = df.withColumn("g", F.when(F.col("n_words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.struct(F.xxhash64(at(F.col("w"), i), at(F.col("w"), i + 1), at(F.col("w"), i + 2)).alias("h"), i.alias("i"))))).otherwise(F.expr("array()")))
    df = df.withColumn("p", F.sort_array(F.transform(F.filter(F.col("g"), lambda x, k: (x["h"] == F.get("g", k - 1)["h"]) | (x["h"] == F.get("g", k + 1)["h"])), lambda x: x["i"])))
    # three words for each window, less what the next one covers too
    repeat = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    lost = F.col("n_words") - F.aggregate(F.transform("good", lambda x: F.size(_words(x))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _n(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        lost.alias("n_lost_words"),
        F.array_join("good", "\n").alias("cleaned"),
    )
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return df.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("n_lost_words") <= F.col("n_words") * F.lit(max_lost)))
