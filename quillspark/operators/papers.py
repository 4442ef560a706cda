"""External papers: parsers of captured API answers, federation, dedup, relevance. Live requests are a provider's business."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, strip_markup

PAPER = "paper_id string, title string, authors array<string>, abstract string, year int, journal string, doi string, url string, citation_count int, source_api string"


def _as_paper(df: DataFrame, source: str, **c: Column) -> DataFrame:
    kinds = dict(x.split() for x in PAPER.split(", "))
    return df.select(*[c.get(n, F.lit(source) if n == "source_api" else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])


def semantic_scholar(raw: DataFrame, col: str = "raw") -> DataFrame:
    kind = "struct<data:array<struct<paperId:string,title:string,abstract:string,year:int,venue:string,citationCount:int,url:string,authors:array<struct<name:string>>,externalIds:map<string,string>>>>"
    p = raw.select(F.explode(F.from_json(col, kind)["data"]).alias("p"))
    return _as_paper(p, "semantic_scholar", paper_id=F.col("p.paperId"), title=F.col("p.title"), authors=F.col("p.authors.name"), abstract=F.col("p.abstract"), year=F.col("p.year"), journal=F.col("p.venue"), doi=F.col("p.externalIds")["DOI"], url=F.col("p.url"), citation_count=F.col("p.citationCount"))


def crossref(raw: DataFrame, col: str = "raw") -> DataFrame:
    date = "struct<`date-parts`:array<array<int>>>"
    kind = f"struct<message:struct<items:array<struct<DOI:string,title:array<string>,abstract:string,URL:string,`container-title`:array<string>,`is-referenced-by-count`:int,author:array<struct<given:string,family:string>>,`published-print`:{date},`published-online`:{date}>>>>"
    p = raw.select(F.explode(F.from_json(col, kind)["message"]["items"]).alias("p"))
    year = F.coalesce(F.col("p")["published-print"]["date-parts"][0][0], F.col("p")["published-online"]["date-parts"][0][0])
    return _as_paper(p, "crossref", paper_id=F.col("p.DOI"), title=F.col("p.title")[0], authors=F.transform("p.author", lambda a: F.concat_ws(" ", a["given"], a["family"])), abstract=strip_markup(F.col("p.abstract")), year=year, journal=F.col("p")["container-title"][0], doi=F.col("p.DOI"), url=F.col("p.URL"), citation_count=F.col("p")["is-referenced-by-count"])


def pubmed(raw: DataFrame, col: str = "raw") -> DataFrame:
    kind = "struct<uid:string,title:string,pubdate:string,fulljournalname:string,authors:array<struct<name:string>>,elocationid:string>"
    entries = raw.select(F.explode(F.map_filter(F.from_json(F.get_json_object(col, "$.result"), "map<string,string>"), lambda k, _: k != "uids")).alias("k", "v"))
    p = entries.select(F.from_json("v", kind).alias("p"))
    return _as_paper(p, "pubmed", paper_id=F.col("p.uid"), title=F.col("p.title"), authors=F.col("p.authors.name"), abstract=F.lit(""), year=F.col("p.pubdate").substr(1, 4).try_cast("int"), journal=F.col("p.fulljournalname"), doi=F.nullif(F.regexp_extract("p.elocationid", "doi: (\\S+)", 1), F.lit("")))


def europe_pmc(raw: DataFrame, col: str = "raw") -> DataFrame:
    kind = "struct<resultList:struct<result:array<struct<id:string,title:string,authorString:string,abstractText:string,pubYear:string,journalTitle:string,doi:string,citedByCount:int>>>>"
    p = raw.select(F.explode(F.from_json(col, kind)["resultList"]["result"]).alias("p"))
    return _as_paper(p, "europepmc", paper_id=F.col("p.id"), title=strip_markup(F.col("p.title")), authors=F.slice(F.split("p.authorString", ", "), 1, 10), abstract=strip_markup(F.col("p.abstractText")), year=F.col("p.pubYear").try_cast("int"), journal=F.col("p.journalTitle"), doi=F.col("p.doi"), citation_count=F.col("p.citedByCount"))


def core(raw: DataFrame, col: str = "raw") -> DataFrame:
    kind = "struct<results:array<struct<id:string,title:string,authors:array<struct<name:string>>,abstract:string,yearPublished:int,publisher:string,doi:string,downloadUrl:string,citationCount:int>>>"
    p = raw.select(F.explode(F.from_json(col, kind)["results"]).alias("p"))
    return _as_paper(p, "core", paper_id=F.col("p.id"), title=F.col("p.title"), authors=F.slice(F.col("p.authors.name"), 1, 5), abstract=F.substring("p.abstract", 1, 2000), year=F.col("p.yearPublished"), journal=F.col("p.publisher"), doi=F.col("p.doi"), url=F.col("p.downloadUrl"), citation_count=F.col("p.citationCount"))


def science_direct(raw: DataFrame, col: str = "raw") -> DataFrame:
    kind = "struct<`search-results`:struct<entry:array<struct<`dc:identifier`:string,`dc:title`:string,`dc:creator`:string,`prism:coverDate`:string,`prism:publicationName`:string,`prism:doi`:string,`prism:url`:string>>>>"
    p = raw.select(F.explode(F.from_json(col, kind)["search-results"]["entry"]).alias("p"))
    of = lambda n: F.col("p")[n]
    return _as_paper(p, "sciencedirect", paper_id=of("dc:identifier"), title=of("dc:title"), authors=F.array(of("dc:creator")), year=F.substring(of("prism:coverDate"), 1, 4).try_cast("int"), journal=of("prism:publicationName"), doi=of("prism:doi"), url=of("prism:url"))


def arxiv(raw: DataFrame, col: str = "raw") -> DataFrame:
    """Atom feeds: one row per entry."""
    e = raw.select(F.explode(F.xpath(F.regexp_replace(col, "xmlns(:\\w+)?=\"[^\"]*\"", ""), F.lit("//entry/id/text()"))).alias("id"), F.regexp_replace(col, "xmlns(:\\w+)?=\"[^\"]*\"", "").alias("x"))
    entries = e.select("id", F.explode(F.regexp_extract_all("x", F.lit("(?s)(<entry>.*?</entry>)"))).alias("one")).filter(F.col("one").contains(F.col("id")))
    text = lambda p: F.trim(F.regexp_replace(F.xpath_string("one", F.lit(p)), "\\s+", " "))
    return _as_paper(entries, "arxiv", paper_id=F.regexp_extract("id", "([^/]+)$", 1), title=text("/entry/title"), authors=F.xpath("one", F.lit("/entry/author/name/text()")), abstract=text("/entry/summary"), year=F.substring(text("/entry/published"), 1, 4).try_cast("int"), url=F.col("id"))


SOURCES = {"arxiv": arxiv, "semantic_scholar": semantic_scholar, "crossref": crossref, "pubmed": pubmed, "core": core, "europepmc": europe_pmc, "sciencedirect": science_direct}


def federated(answers: dict[str, DataFrame], year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Papers of captured answers by source; unknown years stay."""
    out = None
    for name, raw in answers.items():
        part = SOURCES[name](raw)
        out = part if out is None else out.unionByName(part)
    if year_from:
        out = out.filter(F.col("year").isNull() | (F.col("year") >= year_from))
    return out.filter(F.col("year").isNull() | (F.col("year") <= year_to)) if year_to else out


def relevance(title: Column, abstract: Column, cites: Column, query: str) -> Column:
    """3 times the share of query terms in the title, once that in the abstract, and a little for citations."""
    import re

    terms = sorted({t for t in re.findall("[a-z0-9]+", query.lower()) if len(t) > 2})
    cited = F.least(F.coalesce(cites, F.lit(0)), F.lit(100)) / 1000
    if not terms:
        return cited
    share = lambda c: F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.lower(F.coalesce(c, F.lit(""))).contains(t))) / len(terms)
    return 3 * share(title) + share(abstract) + cited


def dedup_by_keys(papers: DataFrame, seq: str = "seq", by: list[str] | None = None) -> DataFrame:
    """The first paper of each DOI as it is written, then of each title but for case and white space: two passes, distributed.

    That is keep-first in order: a DOI counts as seen even where its paper falls by title. Papers without DOI are told by title alone; no
    title is a title like any other. by: columns within which papers are compared.
    """
    by, doi, low = by or [], F.coalesce("doi", F.lit("")), strip(F.lower(F.coalesce("title", F.lit(""))))
    # papers without DOI are each a group of their own, so none of them is skewed
    first = papers.withColumn("r", F.row_number().over(Window.partitionBy(*by, doi, F.when(doi == "", F.col(seq))).orderBy(seq))).filter((doi == "") | (F.col("r") == 1))
    return first.withColumn("r", F.row_number().over(Window.partitionBy(*by, low).orderBy(seq))).filter("r = 1").drop("r")


def dedup_in_order(papers: DataFrame, by: str, seq: str = "seq") -> DataFrame:
    """The same within each search's answer."""
    return dedup_by_keys(papers, seq, [by])


def as_document(papers: DataFrame) -> DataFrame:
    """paper_id, content (title, blank line, abstract), metadata without nulls."""
    meta = F.map_filter(F.create_map(*[x for n in ("title", "journal", "doi", "url", "source_api") for x in (F.lit(n), F.col(n))], F.lit("year"), F.col("year").cast("string")), lambda _, v: v.isNotNull())
    return papers.select("paper_id", F.concat_ws("\n\n", "title", F.nullif("abstract", F.lit(""))).alias("content"), meta.alias("metadata"))
