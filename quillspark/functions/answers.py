"""Answers of models as rows: JSON in fences, in prose or bare, under one of several keys; lists of plain text where there is no JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, is_degenerate, json_rows, strip

#: An item of a plain list begins with a number or a dash.
ITEM = "\\n\\s*(?:\\d+[.)]\\s*|-\\s+)"
#: Openings of lines that announce a roadmap and are none of its steps.
ANNOUNCING = ("berikut", "peta jalan", "here", "roadmap")
_NONE = "array<string>"


def _fields(*names: str) -> str:
    return "struct<" + ",".join(f"{n}:string" for n in names) + ">"


def _first(row: Column, *names: str, default: str = "") -> Column:
    """The first of names that the row has, trimmed."""
    return strip(F.coalesce(*[row[n] for n in names], F.lit(default)))


def _object(raw: Column) -> Column:
    return F.regexp_extract(raw, "(?s)(\\{.*\\})", 1)


def _list_of(value: Column) -> Column:
    """A JSON list of anything as strings; one string is a list of one."""
    return F.coalesce(F.when(F.ltrim(value).startswith("["), F.from_json(value, _NONE)), F.when(strip(value) != "", F.array(value)), F.array().cast(_NONE))


def listed(text: Column, least: int = 10) -> Column:
    """Items of a plain list as (title, description): the first line without a colon at its end, and the rest or the title again."""

    def item(x: Column) -> Column:
        title = F.rtrim(strip(F.substring_index(x, "\n", 1)), F.lit(":"))
        rest = strip(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 1, 1_000_000_000))
        return F.struct(F.substring(title, 1, 200).alias("title"), F.when(rest != "", rest).otherwise(title).alias("description"))

    items = F.filter(F.transform(F.split(text, ITEM), strip), lambda x: F.length(x) >= least)
    return F.transform(items, item)


def gaps(raw: Column) -> Column:
    """title, description, type, confidence, evidence, directions of each gap; of a plain list if there is no JSON."""
    rows = json_rows(raw, _fields("title", "gap", "description", "type", "confidence", "evidence", "suggested_directions"))
    kind = "array<struct<title:string,description:string,type:string,confidence:double,evidence:array<string>,directions:array<string>>>"

    def of(r: Column) -> Column:
        return F.struct(_first(r, "title", "gap", default="Untitled").alias("title"), _first(r, "description").alias("description"), _first(r, "type", default="general").alias("type"), F.coalesce(r["confidence"].try_cast("double"), F.lit(0.5)).alias("confidence"), _list_of(r["evidence"]).alias("evidence"), _list_of(r["suggested_directions"]).alias("directions"))

    none = F.array().cast(_NONE)
    plain = F.transform(listed(raw), lambda x: F.struct(x["title"].alias("title"), x["description"].alias("description"), F.lit("general").alias("type"), F.lit(0.5).alias("confidence"), none.alias("evidence"), none.alias("directions")))
    return bind(rows, lambda r: F.when(F.size(r) > 0, F.transform(r, of).cast(kind)).otherwise(plain.cast(kind)))


def recommendations(raw: Column) -> Column:
    """title, description, gap_type, why, how, priority (by place if it has none) of each usable one; of a plain list if there is no JSON."""
    objects = F.regexp_extract_all(raw, F.lit("(?s)(\\{[^{}]*\\})"), F.lit(1))
    shape = _fields("title", "description", "gap_type", "type", "why", "how", "priority")
    single = F.filter(F.transform(objects, lambda o: F.from_json(o, shape)), lambda r: r.isNotNull())
    rows = bind(json_rows(raw, shape), lambda r: F.when((F.size(r) > 1) | (F.size(single) <= 1), r).otherwise(single))
    kind = "array<struct<title:string,description:string,gap_type:string,why:string,how:string,priority:string>>"

    def of(r: Column, i: Column) -> Column:
        place = F.when(i < 2, "high").when(i < 4, "medium").otherwise("low")
        made = F.struct(F.when(_first(r, "title") == "", "Usulan penelitian").otherwise(_first(r, "title")).alias("title"), _first(r, "description").alias("description"), F.upper(_first(r, "gap_type", "type")).alias("gap_type"), _first(r, "why").alias("why"), _first(r, "how").alias("how"), F.coalesce(r["priority"], place).alias("priority"))
        return F.when(~(is_degenerate(_first(r, "title")) & is_degenerate(_first(r, "description"))), made)

    good = F.filter(F.transform(rows, of), lambda x: x.isNotNull())
    usable = F.filter(listed(raw), lambda x: ~x["title"].rlike("^[\\[{]") & ~(is_degenerate(x["title"]) & is_degenerate(x["description"])))
    plain = F.transform(usable, lambda x: F.struct(x["title"].alias("title"), x["description"].alias("description"), F.lit("").alias("gap_type"), F.lit("").alias("why"), F.lit("").alias("how"), F.lit("medium").alias("priority")))
    looks_json = F.ltrim(raw).rlike("^[\\[{]")
    return bind(good, lambda g: F.when(F.size(g) > 0, g.cast(kind)).when(looks_json, F.array().cast(kind)).otherwise(plain.cast(kind)))


def weaknesses(raw: Column, most: int = 3) -> Column:
    """stated and implied weaknesses, each (point, basis, quote), the first few of both; bullets and quotation marks around them are taken off."""
    bullets, marks = F.lit("-•* \t\n"), F.lit('" ')
    shape = _fields("poin", "point", "kelemahan", "kekurangan", "dasar", "basis", "alasan", "bukti", "kutipan", "quote", "kutipan_verbatim")
    top = F.from_json(_object(raw), "struct<tersurat:string,explicit:string,tersirat:string,implicit:string>")

    def one(item: Column) -> Column:
        return bind(F.when(F.ltrim(item).startswith("{"), F.from_json(item, shape)), lambda r: F.struct(
            F.ltrim(F.when(r.isNull(), strip(item)).otherwise(_first(r, "poin", "point", "kelemahan", "kekurangan")), bullets).alias("point"),
            F.when(r.isNull(), "").otherwise(_first(r, "dasar", "basis", "alasan", "bukti")).alias("basis"),
            F.when(r.isNull(), "").otherwise(F.trim(_first(r, "kutipan", "quote", "kutipan_verbatim"), marks)).alias("quote"),
        ))

    def of(*names: str) -> Column:
        found = F.filter(F.transform(_list_of(F.coalesce(*[top[n] for n in names])), one), lambda x: x["point"] != "")
        return F.slice(found, 1, most)

    return F.struct(of("tersurat", "explicit").alias("stated"), of("tersirat", "implicit").alias("implied"))


def selection(raw: Column, most_sources: int = 5) -> Column:
    """keywords, themes, suggestions (title, rationale, basis, source_papers, gap_type) and summary; without JSON, 500 characters of the answer are the summary."""
    top = F.from_json(_object(raw), _fields("common_keywords", "kata_kunci", "shared_themes", "tema", "suggestions", "summary", "ringkasan"))
    shape = _fields("title", "judul", "rationale", "alasan", "basis", "evidence", "bukti", "source_papers", "supporting_papers", "papers", "gap_type")

    def of(item: Column) -> Column:
        row = F.from_json(F.when(F.ltrim(item).startswith("{"), item).otherwise(F.to_json(F.struct(item.alias("title")))), shape)
        return bind(row, lambda r: F.struct(
            _first(r, "title", "judul").alias("title"), _first(r, "rationale", "alasan").alias("rationale"), _first(r, "basis", "evidence", "bukti").alias("basis"),
            F.slice(F.filter(F.transform(_list_of(F.coalesce(r["source_papers"], r["supporting_papers"], r["papers"])), strip), lambda x: x != ""), 1, most_sources).alias("source_papers"),
            F.upper(_first(r, "gap_type")).alias("gap_type"),
        ))

    held = F.coalesce(*[top[n] for n in ("common_keywords", "kata_kunci", "shared_themes", "tema", "suggestions", "summary", "ringkasan")]).isNotNull()
    lists = lambda *names: F.when(held, _list_of(F.coalesce(*[top[n] for n in names]))).otherwise(F.array().cast(_NONE))
    return F.struct(
        lists("common_keywords", "kata_kunci").alias("keywords"), lists("shared_themes", "tema").alias("themes"), F.transform(lists("suggestions"), of).alias("suggestions"),
        F.when(held, F.coalesce(top["summary"], top["ringkasan"], F.lit(""))).otherwise(F.substring(strip(raw), 1, 500)).alias("summary"),
    )


def paper_groups(raw: Column) -> Column:
    """title and basis of each paper; Lainnya for one without a basis."""
    rows = json_rows(raw, _fields("title", "paper", "basis", "category"))
    return F.transform(rows, lambda r: F.struct(_first(r, "title", "paper").alias("title"), _first(r, "basis", "category", default="Lainnya").alias("basis")))


def roadmap(raw: Column) -> Column:
    """phase and items of each phase: of JSON, else of headed parts of a text, else of its lines as one phase."""
    rows = json_rows(raw, _fields("phase", "items", "tasks"))
    kind = "array<struct<phase:string,items:array<string>>>"
    told = F.transform(rows, lambda r, i: F.struct(F.coalesce(r["phase"], F.concat(F.lit("Phase "), (i + 1).cast("string"))).alias("phase"), _list_of(F.coalesce(r["items"], r["tasks"])).alias("items")))
    text = F.regexp_replace(raw, "\\*\\*|__", "")
    parts = F.split(text, "(?i)(?:^|\\n)\\s*(?:#{1,3}\\s*)?(?:Phase|Fase|Tahap)\\s*\\d+\\s*[:.-]?[ \\t]*", -1)

    def steps(body: Column) -> Column:
        lines = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(strip(F.ltrim(strip(x), F.lit("-•* "))), "^\\d+[.)]\\s*", ""))
        return F.filter(lines, lambda x: F.length(x) > 3)

    def phase(part: Column, i: Column) -> Column:
        head = F.rtrim(strip(F.substring_index(part, "\n", 1)), F.lit(": "))
        body = F.substring(part, F.length(F.substring_index(part, "\n", 1)) + 1, 1_000_000_000)
        return F.struct(F.when(head != "", head).otherwise(F.concat(F.lit("Tahap "), (i + 1).cast("string"))).alias("phase"), steps(body).alias("items"))

    headed = F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), phase), lambda p: F.size(p["items"]) > 0)
    rest = F.filter(steps(text), lambda x: ~F.lower(x).rlike("^(" + "|".join(ANNOUNCING) + ")"))
    flat = F.when(F.size(rest) > 0, F.array(F.struct(F.lit("Rencana Penelitian").alias("phase"), rest.alias("items")))).otherwise(F.array().cast(kind))
    return bind(told, lambda t: F.when(F.size(t) > 0, t.cast(kind)).otherwise(bind(headed, lambda h: F.when(F.size(h) > 0, h.cast(kind)).otherwise(flat.cast(kind)))))
