"""Text expressions: Column in, Column out, all in built-in functions.

Java's \\s, \\b and (?i) are ASCII only; where other alphabets matter, patterns name what they mean. White space is
all that Unicode calls so, and the separators \\x1C to \\x1F.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as a set of characters, for strip(), and as a pattern.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE = "[\\s\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row however often use needs it, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean(text: Column) -> Column:
    """White space to one blank, then runs beyond ASCII to a blank, then trimmed; two blanks in a row can stay."""
    return strip(F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "[^\\x00-\\x7F]+", " "))


def title(text: Column) -> Column:
    """The first of the first 20 lines whose trimmed length lies between 20 and 200."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 20), lambda x: strip(x))
    return F.get(F.filter(lines, lambda x: (F.length(x) > 20) & (F.length(x) < 200)), F.lit(0))


def abstract(text: Column) -> Column:
    """What follows an abstract header, to a blank line or the next header; 500 characters at most."""
    return F.substring(strip(F.regexp_extract(text, "(?is)abstract[:\\s]*\\n?(.*?)(?=\\n\\s*\\n|\\n[a-z]+:|$)", 1)), 1, 500)


def year(text: Column) -> Column:
    found = F.regexp_extract(F.substring(text, 1, 2000), "\\b(19|20)\\d{2}\\b", 0)
    return F.when(found != "", found.cast("int"))


def _listed(found: Column, sep: str) -> Column:
    return F.slice(F.filter(F.transform(F.split(found, sep), lambda x: strip(x)), lambda x: x != ""), 1, 10)


def keywords(text: Column) -> Column:
    return _listed(F.regexp_extract(text, "(?is)key\\s?words?[:\\s]+(.*?)(?=\\n\\s*\\n|$)", 1), "[,;]")


def authors(text: Column) -> Column:
    return _listed(F.regexp_extract(F.substring(text, 1, 1000), "(?i)authors?[:\\s]+([^\\n]+)", 1), ",| and ")


def citations(text: Column, numbered: str = "\\[\\d+\\]", named: str = "\\([A-Z][a-z]+(?: et al\\.)?, \\d{4}\\)", most: int = 50) -> Column:
    """Numbered citations, then (Author, year) ones; each once, in the order met."""
    return F.slice(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(f"({numbered})")), F.regexp_extract_all(text, F.lit(f"({named})")))), 1, most)


def doc_key(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 16)


def sentences(text: Column, least: int = 20) -> Column:
    """Sentences longer than least characters; a stop is . ? or ! and white space."""
    return F.filter(F.transform(F.split(text, f"(?<=[.!?]){SPACE}+"), lambda x: strip(x)), lambda x: F.length(x) > least)


def strip_markup(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), f"{SPACE}+", " "))


def words(text: Column) -> Column:
    """Lower-case words of ASCII letters."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"))


def guess_language(text: Column, first: tuple[str, ...], second: tuple[str, ...], names: tuple[str, str]) -> Column:
    """names[0] if it has strictly more hits, names[1] otherwise, unknown without a hit."""
    found = words(text)
    hits = lambda own: F.size(F.filter(found, lambda w: w.isin(*own)))
    a, b = hits(first), hits(second)
    return F.when((a == 0) & (b == 0), "unknown").when(a > b, names[0]).otherwise(names[1])


def expand_query(query: Column, expansions: tuple[tuple[str, str], ...]) -> Column:
    """The query and, for each term in it, the phrase that goes with it unless the query itself has that already."""
    low = F.lower(query)
    added = [F.when(low.contains(term) & ~low.contains(phrase.lower()), F.lit(phrase)) for term, phrase in expansions]
    return F.concat_ws(" ", query, *added)


def normalise(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(text), f"{SPACE}+", " "))


def content_overlap(needle: Column, text: Column, stop: tuple[str, ...] = ()) -> Column:
    """The share of needle's distinct words of four letters or more, without stop words, that stand somewhere in text."""
    own = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(needle), F.lit("([a-z]{4,})"))), lambda w: ~w.isin(*stop) if stop else F.lit(True))
    return bind(F.lower(text), lambda hay: bind(own, lambda o: F.when(F.size(o) > 0, F.size(F.filter(o, lambda w: hay.contains(w))) / F.size(o)).otherwise(0.0)))


def is_degenerate(text: Column, least: int = 10) -> Column:
    """Too short, or a placeholder."""
    return text.isNull() | (F.length(strip(text)) < least) | F.lower(strip(text)).rlike("^(n/?a|none|null|unknown|tbd|-+|\\.+)$")


def without_tag(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s*\\[[A-Z_]+\\]\\s*", "")


def indicator_type(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.contains("fragment"), "fragmentation").when(t.contains("inconsist"), "inconsistency").when(t.contains("incomplet"), "incompleteness").otherwise("unknown")


def verdict(text: Column) -> Column:
    t = F.upper(text)
    return F.when(t.contains("REJECT"), "REJECT").when(t.contains("FLAG"), "FLAG").when(t.contains("PASS"), "PASS").otherwise("UNKNOWN")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def json_rows(raw: Column, schema: str) -> Column:
    """A model's JSON as an array of structs: an array, one object, either in fences or in prose, an array under a key, or an array cut off."""
    bare = F.trim(F.regexp_replace(raw, "(?s)^.*?```(?:json)?\\s*|```.*$", ""))
    array = F.regexp_extract(bare, "(?s)(\\[.*\\])", 1)
    cut = F.concat(F.regexp_extract(bare, "(?s)(\\[.*\\})", 1), F.lit("]"))
    one = F.regexp_extract(bare, "(?s)(\\{.*\\})", 1)
    kind = f"array<{schema}>"
    tried = [F.from_json(x, kind, {"mode": "PERMISSIVE"}) for x in (F.when(bare.startswith("["), bare), array, cut)] + [F.array(F.from_json(one, schema))]
    good = [F.when(F.size(F.filter(t, lambda r: r.isNotNull())) > 0, F.filter(t, lambda r: r.isNotNull())) for t in tried]
    return F.coalesce(*good, F.from_json(F.lit("[]"), kind))
