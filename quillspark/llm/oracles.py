"""DuckDB SQL of the operators that SQL can express: the same results by plain means, over the documents table."""

from __future__ import annotations

import string

from .license_scan import KNOWN, SPELLINGS
from .quality_rules import BOILERPLATE, ENDS, SEPARATORS, SYMBOLS

_WORD = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _replaced(expression: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for a, b in pairs:
        expression = f"replace({expression}, {_text(a)}, {_text(b)})"
    return expression


def _numbered(text: str = "coalesce(text, '')") -> str:
    """Documents with a number of their own, for repeated rows."""
    return f"d AS (SELECT row_number() OVER () AS r, doc_id, {text} AS t FROM documents)"


def _leads(to: tuple[int, ...], by: str = "PARTITION BY r ORDER BY i") -> str:
    """Tables s2, s4, ...: as many words from each place on; null where the text ends before."""
    made, last = [], "w"
    for k in to:
        half, word = k // 2, "word" if k == 2 else f"s{k // 2}"
        made.append(f"x{k} AS (SELECT *, {word} || ' ' || lead({word}, {half}) OVER ({by}) AS s{k} FROM {last})")
        last = f"x{k}"
    return ", ".join(made)


def license_scan() -> str:
    def canonical(text: str) -> str:
        bare = f"regexp_replace(lower({text}), '(?m)^[^a-z0-9\\n]*(copyright|\\(c\\)|©)[^\\n]*$', '', 'g')"
        return _replaced(f"trim(regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')", SPELLINGS)

    known = ", ".join(f"({_text(name)}, {_text(text)})" for name, text in KNOWN)
    return f"""WITH {_numbered()}, k AS (SELECT sha256({canonical("x")}) AS digest, min(n) AS licence FROM (VALUES {known}) v(n, x) GROUP BY 1),
 l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d), f AS (SELECT r, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names FROM l JOIN k ON digest = sha256({canonical("line")}) GROUP BY r)
SELECT d.doc_id, sha256({canonical("t")}) AS text_sha256, licence AS text_licence, coalesce(n, 0) AS n_notices, coalesce(names, '') AS notices FROM d LEFT JOIN k ON digest = sha256({canonical("t")}) LEFT JOIN f USING (r)"""


def substring_dedup() -> str:
    return f"""WITH {_numbered()}, w AS (SELECT r, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT r, doc_id, regexp_extract_all(t, '{_WORD}') AS ws FROM d)),
 {_leads((2, 4, 8, 16, 32))}, x AS (SELECT r, doc_id, i, word, s32 || ' ' || lead(s16, 32) OVER o || ' ' || lead(s2, 48) OVER o AS win FROM x32 WINDOW o AS (PARTITION BY r ORDER BY i)),
 f AS (SELECT win, min(doc_id) AS first FROM x WHERE win IS NOT NULL GROUP BY win), m AS (SELECT x.*, coalesce(first < doc_id, false) AS again FROM x LEFT JOIN f ON f.win = x.win),
 g AS (SELECT r, i, word, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
 a AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE gone) AS k, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(k, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (r)"""


def minhash_dedup(percent: int = 85) -> str:
    text = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""WITH RECURSIVE {_numbered(text)}, q AS (SELECT r, doc_id, regexp_extract_all(t, '{_WORD}') AS ws FROM d), c AS (SELECT ws, min(r) AS r, min(doc_id) AS id FROM q WHERE len(ws) > 0 GROUP BY ws),
 w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM c), {_leads((2, 4))},
 sh AS (SELECT DISTINCT r, s4 || ' ' || word5 AS g FROM (SELECT r, s4, lead(word, 4) OVER (PARTITION BY r ORDER BY i) AS word5 FROM x4) WHERE word5 IS NOT NULL UNION ALL SELECT r, array_to_string(ws, ' ') FROM c WHERE len(ws) < 5),
 n AS (SELECT r, count(*) AS n FROM sh GROUP BY r), p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
 l AS (SELECT f.id AS a, g.id AS b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b JOIN c f ON f.r = a JOIN c g ON g.r = b WHERE 100 * k >= {percent} * (x.n + y.n - k) AND f.id IS NOT NULL AND g.id IS NOT NULL), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 reach AS (SELECT id AS node, id AS label FROM c WHERE id IS NOT NULL UNION SELECT e.b, reach.label FROM reach JOIN e ON e.a = reach.node), top AS (SELECT node, min(label) AS label FROM reach GROUP BY node),
 own AS (SELECT q.doc_id, CASE WHEN q.doc_id IS NOT NULL THEN coalesce(id, q.doc_id) END AS class_id, CASE WHEN q.doc_id IS NOT NULL THEN coalesce(label, q.doc_id) END AS component_id, coalesce(n.n, 0) AS n_shingles FROM q LEFT JOIN c ON c.ws = q.ws LEFT JOIN top ON node = id LEFT JOIN n ON n.r = c.r)
SELECT doc_id, n_shingles, class_id, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM own"""


def exact_dedup() -> str:
    plain = _replaced("coalesce(text, '')", tuple((c, "") for c in " \t\n\x0b\x0c\r"))
    return f"""WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, sha256({plain}) AS digest FROM documents),
 g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY digest ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, digest AS text_sha256 FROM g"""


def quality_rules(max_lost: float = 0.4) -> str:
    def count(text: str, of: str) -> str:
        return f"(length({text}) - length(regexp_replace({text}, '[{of}]', '', 'g')))"

    def some(text: str, of: tuple[str, ...]) -> str:
        return "(" + " OR ".join(f"contains({text}, {_text(x)})" for x in of) + ")"

    end = r"right(regexp_replace(x, '[\x20\x09-\x0D]+$', ''), 1)"
    fails = f"""(length(x) >= 20 AND NOT list_contains({_list(ENDS)}, {end})) OR (length(x) >= 8 AND NOT regexp_matches(x, '\\p{{Ll}}') AND regexp_matches(x, '\\p{{Lu}}'))
  OR {count("x", SEPARATORS)} >= 3 OR {count("x", SYMBOLS)} * 12 > length(x) OR {some("lower(x)", BOILERPLATE)}"""
    return f"""WITH {_numbered()}, q AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
 w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM q), tri AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
 rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri WHERE g IS NOT NULL) WHERE c > 1), cov AS (SELECT r, CAST(sum(n) AS BIGINT) AS n FROM (SELECT r, least(3, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 3)) AS n FROM rep) GROUP BY r),
 bad AS (SELECT r, CAST(sum(len(regexp_extract_all(x, '{_WORD}'))) AS BIGINT) AS n FROM (SELECT r, unnest(ls) AS x FROM q) WHERE {fails} GROUP BY r),
 m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST({count("t", SYMBOLS)} AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(bad.n, 0) AS n_lost_words FROM q LEFT JOIN cov USING (r) LEFT JOIN bad USING (r)),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_lost_words <= n_words * CAST({max_lost} AS DOUBLE) AS kept FROM b"""
