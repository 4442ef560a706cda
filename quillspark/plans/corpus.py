"""Queries over texts: cleaning, metadata, chunking, language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking, text
from .views import table

#: Words that the driver's invented texts have, in the place of vocabularies that don't occur there.
EN, DE, STOP = ("the", "and", "of", "that", "is"), ("der", "die", "und", "das", "ein"), ("that", "with")

_docs = lambda s, d: table(s, d, "documents")
#: White space in DuckDB's patterns, and as the characters that trim() takes off.
_SP = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIP = "(" + " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) + ")"
_CLEAN = f"trim(regexp_replace(regexp_replace(text, '{_SP}+', ' ', 'g'), '[^\\x00-\\x7F]+', ' ', 'g'), {_STRIP})"
_words = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"


def chunks(spark, d):
    c = chunking.chunk_fixed(_docs(spark, d))
    return c.select("doc_id", "chunk_index", "total_chunks", "start_char", "end_char", F.md5("content").alias("content_md5"))


_CHUNKS = f"""WITH d AS (SELECT doc_id, {_CLEAN} AS t FROM documents), w AS (SELECT doc_id, t, unnest(generate_series(0, length(t) - 1, 462)) AS s FROM d WHERE length(t) > 0),
 r AS (SELECT *, substr(t, s + 1, 512) AS raw FROM w), p AS (SELECT *, greatest(0, length(raw) - 100) AS tail_at, strpos(reverse(substr(raw, greatest(0, length(raw) - 100) + 1)), ' .') AS back FROM r),
 q AS (SELECT *, CASE WHEN back > 0 THEN tail_at + length(substr(raw, tail_at + 1)) - back - 1 END AS dot FROM p),
 k AS (SELECT *, CASE WHEN s + 512 < length(t) AND dot > 0 THEN dot + 1 ELSE length(raw) END AS n FROM q), c AS (SELECT doc_id, s, s + n AS e, trim(substr(raw, 1, n), ' ') AS content FROM k)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks, CAST(s AS INTEGER) AS start_char, CAST(e AS INTEGER) AS end_char, md5(content) AS content_md5
FROM c WHERE length(content) >= 100"""


def language(spark, d):
    df = _docs(spark, d).select("lang", text.guess_language(F.col("text"), DE, EN, ("de", "en")).alias("guess"))
    return df.groupBy("lang", "guess").count().withColumnRenamed("count", "n")


_LANG = f"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '([a-z]+)', 1) AS ws FROM documents), h AS (SELECT lang, len(list_filter(ws, lambda x: x IN {_words(DE)})) AS a, len(list_filter(ws, lambda x: x IN {_words(EN)})) AS b FROM w)
SELECT lang, CASE WHEN a = 0 AND b = 0 THEN 'unknown' WHEN a > b THEN 'de' ELSE 'en' END AS guess, count(*) AS n FROM h GROUP BY ALL"""


def overlap(spark, d):
    """How much of each turn's content the turn before it has."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.content_overlap(F.col("text"), F.col("before"), STOP), 6).alias("score"))


_OVERLAP = f"""WITH c AS (SELECT a.conv_id, a.turn, lower(b.text) AS t, list_filter(list_distinct(regexp_extract_all(lower(a.text), '([a-z]{{4,}})', 1)), lambda x: x NOT IN {_words(STOP)}) AS ws FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn)
SELECT conv_id, turn, CASE WHEN len(ws) > 0 THEN round(len(list_filter(ws, lambda x: contains(t, x))) / len(ws), 6) ELSE 0.0 END AS score FROM c"""

QUERIES = {
    "doc_clean": (lambda s, d: _docs(s, d).select("doc_id", F.md5(text.clean(F.col("text"))).alias("clean_md5"), F.length(text.clean(F.col("text"))).alias("n")), f"SELECT doc_id, md5({_CLEAN}) AS clean_md5, CAST(length({_CLEAN}) AS INTEGER) AS n FROM documents"),
    "doc_chunks_fixed": (chunks, _CHUNKS),
    "doc_title": (lambda s, d: _docs(s, d).select("doc_id", text.title(F.col("text")).alias("title")), "SELECT doc_id, list_filter(list_transform(list_slice(string_split(text, chr(10)), 1, 20), lambda x: trim(x, ' ')), lambda x: length(x) > 20 AND length(x) < 200)[1] AS title FROM documents"),
    "doc_year": (lambda s, d: table(s, d, "events").select("event_id", text.year(F.date_format("ts", "yyyy-MM-dd")).alias("year")), "SELECT event_id, CAST(regexp_extract(strftime(ts, '%Y-%m-%d'), '\\b(19|20)\\d{2}\\b') AS INTEGER) AS year FROM events"),
    "doc_citations": (
        lambda s, d: _docs(s, d).select("doc_id", F.array_join(F.sort_array(text.citations(F.concat(F.lit("[1] ["), (F.col("doc_id") % 7).cast("string"), F.lit("] (Smith et al., 2020) (Doe, 2019) [1] "), F.col("text")))), ";").alias("cites")),
        "WITH t AS (SELECT doc_id, '[1] [' || (doc_id % 7) || '] (Smith et al., 2020) (Doe, 2019) [1] ' || text AS x FROM documents) SELECT doc_id, list_aggregate(list_sort(list_distinct(list_concat(regexp_extract_all(x, '\\[\\d+\\]'), regexp_extract_all(x, '\\([A-Z][a-z]+(?: et al\\.)?, \\d{4}\\)')))), 'string_agg', ';') AS cites FROM t",
    ),
    "doc_id_md5": (lambda s, d: table(s, d, "pages").select("page_id", text.doc_key(F.col("url")).alias("key")), "SELECT page_id, substr(md5(url), 1, 16) AS key FROM pages"),
    "doc_sentences": (lambda s, d: _docs(s, d).select("doc_id", F.size(text.sentences(F.col("text"))).alias("n")), f"SELECT doc_id, CAST(len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_SP}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {_STRIP})), lambda x: length(x) > 20)) AS INTEGER) AS n FROM documents"),
    "html_strip": (lambda s, d: table(s, d, "pages").select("page_id", F.md5(text.strip_markup(F.col("html"))).alias("text_md5")), f"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{_SP}+', ' ', 'g'), {_STRIP})) AS text_md5 FROM pages"),
    "lang_guess_confusion": (language, _LANG),
    "content_overlap": (overlap, _OVERLAP),
    "norm_type_verdict": (
        lambda s, d: table(s, d, "orders").groupBy(text.verdict(F.concat(F.lit("x"), F.when(F.col("o_orderstatus") == "F", "Flagged").when(F.col("o_orderstatus") == "O", "pass").otherwise("rejected"))).alias("verdict")).count().withColumnRenamed("count", "n"),
        "SELECT CASE o_orderstatus WHEN 'F' THEN 'FLAG' WHEN 'O' THEN 'PASS' ELSE 'REJECT' END AS verdict, count(*) AS n FROM orders GROUP BY ALL",
    ),
    "degenerate_texts": (lambda s, d: _docs(s, d).groupBy(text.is_degenerate(F.col("text"), 60).alias("degenerate")).count().withColumnRenamed("count", "n"), "SELECT length(trim(text, ' ')) < 60 OR regexp_matches(lower(trim(text, ' ')), '^(n/?a|none|null|unknown|tbd|-+|\\.+)$') AS degenerate, count(*) AS n FROM documents GROUP BY ALL"),
    "expanded_queries": (
        lambda s, d: table(s, d, "part").select("p_partkey", text.expand_query(F.col("p_name"), (("red", "crimson scarlet"), ("small", "little"), ("widget", "little thing"))).alias("q")),
        "SELECT p_partkey, p_name || CASE WHEN contains(lower(p_name), 'red') AND NOT contains(lower(p_name), 'crimson scarlet') THEN ' crimson scarlet' ELSE '' END || CASE WHEN contains(lower(p_name), 'small') AND NOT contains(lower(p_name), 'little') THEN ' little' ELSE '' END || CASE WHEN contains(lower(p_name), 'widget') AND NOT contains(lower(p_name), 'little thing') THEN ' little thing' ELSE '' END AS q FROM part",
    ),
    "section_chunks": (lambda s, d: chunking.chunk_documents(_docs(s, d), words=("the", "der", "que")).select("doc_id", "chunk_index", "section", F.md5("content").alias("content_md5")), None),
    "weakness_windows": (lambda s, d: chunking.weakness_windows(_docs(s, d), "the|das", "and|und").select("doc_id", F.length("excerpt").alias("n")), None),
    "needs_ocr": (lambda s, d: _docs(s, d).groupBy(((F.length(F.trim("text")) / F.lit(1)) < 50).alias("needs_ocr")).count().withColumnRenamed("count", "n"), "SELECT length(trim(text, ' ')) < 50 AS needs_ocr, count(*) AS n FROM documents GROUP BY ALL"),
}
