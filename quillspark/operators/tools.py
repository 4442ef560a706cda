"""What agents and routes ask of facts, papers and graphs: limited answers with totals, previews, parsed answers of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise, strip
from ..session import checkpointed

#: Characters of a name that it is looked up by in texts.
GRAM = 4


def limited(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first most rows in order, with rank, and in total how many there were before the limit."""
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy(*order).limit(most)
    # at most most rows, and one
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.crossJoin(F.broadcast(total))


def facts_answer(facts: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None, most: int = 50) -> DataFrame:
    rows = facts
    for c, v in (("subject_id", subject), ("predicate", predicate), ("object_id", obj)):
        rows = rows if v is None else rows.filter(F.col(c) == v)
    return limited(rows.select("seq", "fact_id", "subject_id", "predicate", "object_id", "confidence"), ["seq", "fact_id"], most).drop("seq")


def entities_answer(entities: DataFrame, entity_type: str | None = None, types: tuple[str, ...] = ("METHOD", "FINDING", "DOMAIN", "PAPER", "CONCEPT"), most: int = 50) -> DataFrame:
    """Entities of a type; of all types if it is none of the known ones."""
    rows = entities.filter(F.col("entity_type") == entity_type) if entity_type in types else entities
    return limited(rows.select("seq", "entity_id", "entity_type", "name"), ["seq", "entity_id"], most).drop("seq")


def passages(hits: DataFrame, store: DataFrame, width: int = 500) -> DataFrame:
    """hits (id, score, rank) with content cut to width, title (Unknown if it has none) and source, from store (id, content, title, source)."""
    out = hits.join(store.select("id", F.substring("content", 1, width).alias("content"), F.coalesce("title", F.lit("Unknown")).alias("title"), F.coalesce("source", F.lit("")).alias("source")), "id")
    return out.select("id", "content", "title", "source", F.coalesce("score", F.lit(0.0)).alias("score"), "rank")


def named_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, key of all names (key, name) that a text (id, text) holds, without regard to case. Empty names are in no text.

    Texts are compared with distinct names: where a name's first characters stand, what is as long as a name of that beginning is joined
    with it, so names that begin alike don't make rows unless they are there.
    """
    low = names.select("key", F.lower("name").alias("name")).filter("name <> ''")
    return held_names(texts, low.select("name").distinct()).join(low, "name").select("id", "key").distinct()


def held_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, name of all names (name: lower case, distinct, none empty) that a text (id, text) holds."""
    one = names.withColumn("gram", F.substring("name", 1, GRAM))
    begins = one.groupBy("gram").agg(F.collect_set(F.length("name")).alias("lengths"))
    # a name shorter than a gram is a gram of its own; only lengths that names have are looked up
    sizes = one.agg(F.coalesce(F.max(F.length("name")), F.lit(0)).alias("longest"), F.collect_set(F.length("gram")).alias("sizes"))  # one row
    rows = texts.select("id", F.lower("text").alias("text")).filter("text <> ''").crossJoin(F.broadcast(sizes))
    at = F.sequence(F.lit(1), F.length("text"))
    ahead = F.array_distinct(F.transform(at, lambda i: F.substring(F.col("text"), i, F.col("longest"))))
    heads = rows.select("id", "sizes", F.explode(ahead).alias("ahead"))
    grams = heads.select("id", "ahead", F.explode("sizes").alias("n")).select("id", "ahead", F.substring(F.col("ahead"), F.lit(1), F.col("n")).alias("gram"))
    spans = grams.join(begins, "gram").select("id", F.explode(F.transform("lengths", lambda n: F.substring(F.col("ahead"), F.lit(1), n))).alias("name"))
    return spans.join(names.select("name"), "name", "left_semi").select("id", "name").distinct()


def enriched_claims(claims: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """claims (claim_id, description, method, domain, findings) with what their description names: the first method and domain, the first findings.

    A claim that has both a method and a domain stays as it is, and so does whatever a claim has of its own. What a description
    names depends on nothing else, so each is looked up once, however many claims have it.
    """
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    open_claims = claims.filter(~(full("method") & full("domain")))
    e = entities.filter(F.col("entity_type").isin("METHOD", "DOMAIN", "FINDING"))
    # a name stands for its first entities: of a claim's names no others can be among the first
    by_place = Window.partitionBy("entity_type", "name").orderBy("seq", "key")
    e = e.select(F.col("entity_id").alias("key"), "entity_type", F.lower("name").alias("name"), "seq").filter("name <> ''")
    # the constant limit lets each task drop what it can before the rows are dealt out by name
    e = e.withColumn("r", F.row_number().over(by_place)).filter(F.col("r") <= max(most, 1)).filter(F.col("r") <= F.when(F.col("entity_type") == "FINDING", most).otherwise(1))
    said = open_claims.select(F.col("description").alias("id"), F.col("description").alias("text")).distinct()
    held = held_names(said, e.select("name").distinct())
    found = held.join(e, "name")
    first = lambda t: F.min(F.when(F.col("entity_type") == t, F.struct("seq", "key")))["key"]
    own = found.groupBy(F.col("id").alias("said")).agg(first("METHOD").alias("m"), first("DOMAIN").alias("d"), F.slice(F.transform(F.sort_array(F.collect_list(F.when(F.col("entity_type") == "FINDING", F.struct("seq", "key")))), lambda x: x["key"]), 1, most).alias("f"))
    out = claims.join(own, ~(full("method") & full("domain")) & (F.col("description") == F.col("said")), "left").drop("said")
    none = F.array().cast("array<string>")
    return out.withColumn("findings", F.when(F.size(F.coalesce("findings", none)) > 0, F.col("findings")).otherwise(F.coalesce("f", none))).withColumn("method", F.when(full("method"), F.col("method")).otherwise(F.col("m"))).withColumn("domain", F.when(full("domain"), F.col("domain")).otherwise(F.col("d"))).drop("m", "d", "f")


def grounded_suggestions(suggestions: DataFrame, papers: DataFrame, most: int = 3) -> DataFrame:
    """suggestions (by, seq, title, source_papers) tied to two known titles (by, seq, title) or more, the first few; source_papers become those titles.

    A source means the first title that is it, holds it or is in it. by: one request, so its titles and sources are few.
    """
    known = papers.filter(F.coalesce(F.col("title"), F.lit("")) != "").select("by", F.col("seq").alias("at"), strip(F.col("title")).alias("known"), normalise(F.col("title")).alias("n"))
    rows = suggestions.filter(F.coalesce(F.col("title"), F.lit("")) != "")
    asked = rows.select("by", "seq", F.posexplode("source_papers").alias("i", "s")).withColumn("c", normalise(F.col("s"))).filter("c <> ''")
    hits = asked.join(known, "by").filter(F.contains("n", F.col("c")) | F.contains("c", F.col("n")))
    first = hits.groupBy("by", "seq", "i").agg(F.min(F.struct("at", "known"))["known"].alias("known"))
    tied = first.groupBy("by", "seq").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("i", "known"))), lambda x: x["known"])).alias("sources")).filter(F.size("sources") >= 2)
    out = rows.join(tied, ["by", "seq"]).withColumn("rank", F.row_number().over(Window.partitionBy("by").orderBy("seq")))
    return out.filter(F.col("rank") <= most).drop("source_papers").withColumnRenamed("sources", "source_papers")


def numbered_items(text: Column) -> Column:
    """The items of a numbered list: lines that begin with a digit, without numbers and stops before them."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x.rlike("^[0-9]"))
    return F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, "^[0-9.]+", ""))), lambda x: x != "")


def sections_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 100) -> DataFrame:
    """doc_id, chunk_id, section, content, chunk_index, total_chunks: what stands between lines of capitals, short sections left out."""
    head = "\n([A-Z][A-Z\\s\\x1C-\\x1F]+)\n"
    titles, parts = F.regexp_extract_all(F.col(text_col), F.lit(head)), F.split(F.col(text_col), head, -1)
    pairs = F.arrays_zip(F.transform(titles, strip).alias("section"), F.transform(F.slice(parts, 2, 1_000_000_000), strip).alias("content"))
    kept = docs.select(F.col(id_col).alias("doc_id"), F.filter(pairs, lambda p: F.length(p["content"]) >= least).alias("p"))
    out = kept.select("doc_id", F.size("p").alias("total_chunks"), F.posexplode("p").alias("chunk_index", "s"))
    return out.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_section_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "s.section", "s.content", "chunk_index", "total_chunks")


def shortest_path(edges: DataFrame, source: str, target: str, most: int = 100) -> list[str]:
    """The nodes of a shortest directed path, of several the first by its last steps; empty if there is none. At most most steps."""
    from .graph import distances

    e = edges.select("u", "v").distinct()
    depth = checkpointed(distances(e, source, most))
    end = depth.filter(F.col("node") == target).first()
    if end is None:
        return []
    path = [target]
    for d in range(end["depth"] - 1, -1, -1):
        path.append(e.filter(F.col("v") == path[-1]).join(depth.filter(F.col("depth") == d), F.col("u") == F.col("node")).agg(F.min("u")).first()[0])
    return path[::-1]


def reachable_pairs(edges: DataFrame, papers: DataFrame, by: str, id_col: str, seq: str, rounds: int = 1000) -> DataFrame:
    """by, a, b of papers of one group, a before b, with a directed path from a to b. Only papers that have edges start anywhere."""
    e = checkpointed(edges.select("u", "v").filter("u <> v").distinct())
    rows = papers.select(F.col(by).alias("by"), F.col(id_col).cast("string").alias("id"), F.col(seq).alias("s"))
    starts = rows.select("id").distinct().join(e.select(F.col("u").alias("id")).distinct(), "id", "left_semi")
    seen = checkpointed(starts.select(F.col("id").alias("a"), F.col("id").alias("node"), F.lit(0).alias("depth")))
    for depth in range(rounds + 1):
        if depth == rounds:
            raise ValueError(f"paths are longer than {rounds} steps")
        step = seen.filter(F.col("depth") == depth).join(e, F.col("node") == F.col("u")).select("a", F.col("v").alias("node")).distinct().join(seen, ["a", "node"], "left_anti").withColumn("depth", F.lit(depth + 1))
        seen = checkpointed(seen.unionByName(step))
        if not seen.filter(F.col("depth") == depth + 1).limit(1).count():
            break
    first, second = rows.select("by", F.col("id").alias("a"), F.col("s").alias("sa")), rows.select("by", F.col("id").alias("b"), F.col("s").alias("sb"))
    pairs = seen.filter("a <> node").select("a", F.col("node").alias("b"))
    return pairs.join(first, "a").join(second, ["by", "b"]).filter("sa < sb").select("by", "a", "b").distinct()


def isolation(edges: DataFrame, papers: DataFrame, by: str, id_col: str, seq: str) -> DataFrame:
    """by, n_papers, isolation: 1 less the share of pairs of a group's papers, in their order, that a path joins; 0 for one paper."""
    n = papers.groupBy(F.col(by).alias("by")).agg(F.count("*").alias("n_papers"))
    joined = reachable_pairs(edges, papers, by, id_col, seq).groupBy("by").agg(F.count("*").alias("k"))
    pairs = F.col("n_papers") * (F.col("n_papers") - 1) / 2
    return n.join(joined, "by", "left").select("by", "n_papers", F.when(pairs > 0, 1 - F.coalesce("k", F.lit(0)) / pairs).otherwise(0.0).alias("isolation"))


def paper_graph(papers: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, kind, label; edges: u, v, predicate) of papers (paper_id, title) and citations (citing, cited); both ends of a citation are nodes."""
    nodes = papers.select(F.col("paper_id").alias("node"), F.lit("PAPER").alias("kind"), F.col("title").alias("label"))
    ends = citations.select(F.col("citing").alias("node")).union(citations.select("cited")).distinct().join(nodes, "node", "left_anti")
    edges = citations.select(F.col("citing").alias("u"), F.col("cited").alias("v")).distinct().withColumn("predicate", F.lit("CITES"))
    return nodes.unionByName(ends.select("node", F.lit("PAPER").alias("kind"), F.col("node").alias("label"))), edges


def top_terms(clusters: DataFrame, degrees: DataFrame, most: int = 3) -> DataFrame:
    """cluster, size, top_terms: each cluster's nodes of the highest degree, from (node, cluster) and (node, degree)."""
    rows = clusters.join(degrees, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    # a bounded heap a task and cluster, not the cluster
    near = rows.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("degree"), "node"))).filter(F.col("r") <= most)
    best = near.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]).alias("top_terms"))
    return rows.groupBy("cluster").agg(F.count("*").alias("size")).join(best, "cluster")


def sampled(facts: DataFrame, n: int, seed: int = 42, id_col: str = "fact_id") -> DataFrame:
    """n facts by a seeded hash of their id: the same at every run, however the table is split."""
    return facts.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def missing_kinds(found: Column, expected: tuple[str, ...]) -> Column:
    """What is expected and not found, in the order expected."""
    return F.array_except(F.array(*[F.lit(x) for x in expected]), F.coalesce(found, F.array().cast("array<string>")))


def newest_source(sources: DataFrame, wanted: str | None = None) -> DataFrame:
    """The row of sources (source_id, kind, updated_at) to read: the wanted job, else the latest job, else the newest experiment."""
    order = F.when(F.col("source_id").eqNullSafe(F.lit(wanted)) & (F.col("kind") == "job"), 0).when(F.col("kind") == "job", 1).otherwise(2)
    return sources.withColumn("order", order).orderBy("order", F.desc("updated_at"), "source_id").limit(1).drop("order")
