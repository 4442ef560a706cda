"""Recommendations: by neighbours, by gaps, hybrid, diversified; reading order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tools import held_names

WEIGHTS = (("content", 0.5), ("graph", 0.3), ("gap", 0.2))
#: Up to so many words of gaps a list holds them as an array; of more, only those that stand in a text are met.
FEW_WORDS = 100
#: Words of more characters are compared one by one.
LONG_WORD = 1000


def graph_scores(edges: DataFrame, seeds: DataFrame, most: int = 10, per_hit: float = 0.5) -> DataFrame:
    """id, score: per_hit for each seed that a node is next to, of at most most neighbours a seed."""
    near = seeds.join(edges, F.col("seed") == F.col("u")).select("seed", F.col("v").alias("id")).union(seeds.join(edges, F.col("seed") == F.col("v")).select("seed", F.col("u"))).distinct()
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("id"))).filter(F.col("r") <= most)
    return few.groupBy("id").agg((F.count("*") * per_hit).alias("score"))


def gap_scores(hits: DataFrame, gaps: list[str], content: str = "content", per_word: float = 0.1, least: int = 1) -> DataFrame:
    """hits with score raised for each distinct word of the gaps' descriptions that the content holds, 1 at most."""
    words = sorted({w for g in gaps for w in g.lower().split() if len(w) >= least})
    if not words:
        return hits
    found = F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.lower(F.col(content)).contains(w)))
    return hits.withColumn("score", F.least(F.lit(1.0), F.col("score") + found * per_word))


def hybrid(lists: dict[str, DataFrame], k: int, weights: tuple[tuple[str, float], ...] = WEIGHTS) -> DataFrame:
    """id, score, reasons, rank: weighted sums over the lists (id, score)."""
    rows = None
    for name, w in weights:
        if name in lists:
            part = lists[name].select("id", (F.col("score") * w).alias("s"), F.lit(name).alias("why"))
            rows = part if rows is None else rows.unionByName(part)
    g = rows.groupBy("id").agg(F.sum("s").alias("score"), F.array_join(F.sort_array(F.collect_set("why")), "+").alias("reasons")).orderBy(F.desc(F.round("score", 9)), "id").limit(k)
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")))


def diversified(hits: DataFrame, title: str = "title", weight: float = 0.3, free: int = 3, by: str | None = None) -> DataFrame:
    """hits (score, rank) with score less a penalty for words shared with all earlier titles, if more than free; not under 0.

    A word is shared where its first title stands earlier, so titles are compared with one row a word and list, not with each other.
    """
    lists = [by] if by else []
    return _less_shared(hits, _first_places(hits, title, lists), title, weight, free, lists)


def _own_words(title: str) -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(title, F.lit(""))), "\\s+"))


def _first_places(hits: DataFrame, title: str, lists: list[str]) -> DataFrame:
    """lists, word, r: the rank of the first title of a list that has the word."""
    return hits.select(*lists, F.explode(_own_words(title)).alias("word"), F.col("rank").alias("r")).groupBy(*lists, "word").agg(F.min("r").alias("r"))


def _less_shared(hits: DataFrame, first: DataFrame, title: str, weight: float, free: int, lists: list[str]) -> DataFrame:
    # the row goes with its first word; the others have its number
    own = _own_words(title)
    rows = hits.withColumn("row_no", F.monotonically_increasing_id())
    words = rows.select("row_no", *[F.col(c).alias(f"list_{c}") for c in lists], F.col("rank").alias("at"), F.struct(*hits.columns).alias("hit"), F.posexplode(own).alias("i", "w"))
    words = words.withColumn("hit", F.when(F.col("i") == 0, F.col("hit")))
    met = words.join(first, reduce(Column.__and__, [F.col(f"list_{c}").eqNullSafe(F.col(c)) for c in lists], F.col("w") == F.col("word")), "left")
    got = met.groupBy("row_no").agg(F.first("hit", ignorenulls=True).alias("hit"), F.count_if(F.col("r") < F.col("at")).cast("int").alias("shared"))
    df = got.select("hit.*", "shared")
    return df.withColumn("score", F.when(F.col("shared") > free, F.greatest(F.lit(0.0), F.col("score") - F.col("shared") * weight * 0.1)).otherwise(F.col("score")))


def reading_order(papers: DataFrame, year: str = "year", seq: str = "seq", by: str | None = None) -> DataFrame:
    """papers with position and note, oldest first; a missing year is last. papers is a short list, or each list of by is."""
    part = Window.partitionBy(by) if by else Window.partitionBy()
    n = F.count("*").over(part)
    pos = F.row_number().over(part.orderBy(F.coalesce(year, F.lit(9999)), seq))
    return papers.withColumn("position", pos).withColumn("n", n).withColumn("note", F.when(F.col("position") == 1, "start").when(F.col("position") - 1 < F.floor(F.col("n") / 2), "core").otherwise("recent")).drop("n")


def reasons(hits: DataFrame) -> DataFrame:
    """hits with why: what the score, year and gaps say."""
    parts = [F.when(F.col("score") > 0.8, "highly relevant").when(F.col("score") > 0.6, "relevant"), F.when(F.coalesce("year", F.lit(0)) >= 2020, "recent")]
    return hits.withColumn("why", F.concat_ws("; ", *parts))


def from_gaps(gaps: DataFrame, most: int = 5) -> DataFrame:
    """One recommendation for each of the first gaps (type, description, seq): priority by place."""
    texts = {"fragmentation": "Compare the separate approaches on one benchmark", "inconsistency": "Replicate the conflicting results", "incompleteness": "Study the aspects that are missing"}
    r = F.row_number().over(Window.orderBy("seq"))
    first = gaps.orderBy("seq").limit(most).withColumn("position", r)
    action = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), F.col("type")), F.lit("Examine the gap"))
    return first.select("position", "type", action.alias("title"), "description", F.when(F.col("position") <= 2, "high").when(F.col("position") <= 4, "medium").otherwise("low").alias("priority"))


def strategy(name: str, **made: DataFrame) -> DataFrame:
    """The list of a strategy: content, graph or gap_aware as it is given; any other name is hybrid, of the lists that are there."""
    if name in ("content", "graph", "gap_aware") and name in made:
        return made[name]
    k = made.pop("k", 10)
    return hybrid(made, k)


def gap_words(gaps: DataFrame, text: str = "description", by: str | None = None) -> DataFrame:
    """(by,) word: the distinct words of five letters or more that describe gaps."""
    words = gaps.select(*([by] if by else []), F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+")).alias("word"))
    return words.filter(F.length("word") > 4).distinct()


def _gaps_named(rows: DataFrame, words: DataFrame, by: str) -> DataFrame:
    """rows (title, abstract) with has_gaps and n_gaps: whether their list has words (by, word), and how many of them title or abstract hold."""
    low = [F.lower("title"), F.lower(F.coalesce("abstract", F.lit("")))]
    if words.groupBy(by).count().filter(F.col("count") > FEW_WORDS).isEmpty():
        held = rows.join(words.groupBy(by).agg(F.collect_list("word").alias("gap_words")), by, "left")
        named = F.filter(F.coalesce("gap_words", F.array().cast("array<string>")), lambda w: F.contains(low[0], w) | F.contains(low[1], w))
        return held.withColumn("n_gaps", F.size(named)).withColumn("has_gaps", F.col("gap_words").isNotNull()).drop("gap_words")
    # a gap's word has no white space, so it stands within a word of the text; such a word is looked up once for all texts
    own = F.filter(F.array_distinct(F.concat(*[F.split(t, "\\s+") for t in low])), lambda w: F.length(w) > 4)
    said = rows.select(F.col(by).alias("of"), F.explode(own).alias("own")).distinct()
    told = words.select(F.col(by).alias("list"), "word")
    short = held_names(said.select(F.col("own").alias("id"), F.col("own").alias("text")).distinct().filter(F.length("text") <= LONG_WORD), told.select(F.col("word").alias("name")).distinct().filter(F.length("name") <= LONG_WORD))
    met = said.join(short, F.col("own") == F.col("id")).join(told, (F.col("of") == F.col("list")) & (F.col("name") == F.col("word"))).select("of", "own", "word")
    met = met.union(said.filter(F.length("own") > LONG_WORD).join(told, F.col("of") == F.col("list")).filter(F.contains("own", F.col("word"))).select("of", "own", "word"))
    met = met.groupBy(F.col("of").alias("list"), F.col("own").alias("held")).agg(F.collect_list("word").alias("words"))
    # the row goes with its first word; the others have its number
    listed = rows.join(words.select(by).distinct().withColumn("has_gaps", F.lit(True)), by, "left").withColumn("has_gaps", F.coalesce("has_gaps", F.lit(False)))
    # numbered before they are taken apart
    parts = listed.withColumn("row_no", F.monotonically_increasing_id()).select("row_no", F.col(by).alias("of"), F.struct(*listed.columns).alias("row"), F.posexplode_outer(own).alias("i", "own"))
    parts = parts.withColumn("row", F.when(F.coalesce("i", F.lit(0)) == 0, F.col("row"))).join(met, (F.col("of") == F.col("list")) & (F.col("own") == F.col("held")), "left")
    return parts.groupBy("row_no").agg(F.first("row", ignorenulls=True).alias("row"), F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("n_gaps")).select("row.*", "n_gaps")


def _leading(rows: DataFrame, k: int, by: str, weight: float) -> DataFrame:
    """The rows that can be among a list's k best once shared words are taken off: no row loses more than for all its words, or rises above 0."""
    least = F.greatest(F.lit(0.0), F.col("score") - F.size(_own_words("title")) * weight * 0.1)
    best = rows.select(F.col(by).alias("of"), F.when(F.col("score") < 0, F.col("score")).otherwise(least).alias("least"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("least")))).filter(F.col("r") <= k)
    bar = best.groupBy("of").agg(F.when(F.count("*") == k, F.min("least")).alias("bar"))
    # far less than a step of scores, far more than their rounding
    return rows.join(bar, F.col(by).eqNullSafe(F.col("of")), "left").filter(F.col("bar").isNull() | F.coalesce(F.greatest(F.col("score"), F.lit(0.0)) >= F.col("bar") - 1e-9, F.lit(True))).drop("of", "bar")


def agent_list(candidates: DataFrame, gaps: DataFrame, k: int, by: str, weight: float = 0.3, per_word: float = 0.1, free: int = 3) -> DataFrame:
    """The best k of each list (by) of candidates (id, title, abstract, year, keywords, score, rank), which are top-ks.

    Scores rise by the words of the list's gaps (by, description) in title or abstract, 1 at most; then titles that repeat
    earlier ones lose, and the rest go by score. reason says why: score, year, keywords and gaps, in that order.
    """
    titled = candidates.withColumn("title", F.coalesce("title", F.lit("Unknown")))
    rows = _gaps_named(titled, gap_words(gaps, "description", by), by).withColumn("told_score", F.col("score"))
    rows = rows.withColumn("score", F.when(F.col("n_gaps") > 0, F.least(F.lit(1.0), F.col("score") + F.col("n_gaps") * per_word)).otherwise(F.col("score")))
    if weight > 0:
        # reasons are told of the rows that are left
        rows = _leading(rows, k, by, weight)
    told = F.concat_ws(
        "; ", F.when(F.col("told_score") > 0.8, "Highly relevant to your query").when(F.col("told_score") > 0.6, "Relevant to your research area"),
        F.when(F.col("year") >= 2020, F.concat(F.lit("Recent publication ("), F.col("year").cast("string"), F.lit(")"))),
        F.when(F.size("keywords") > 0, "Matches key research themes"), F.when(F.col("has_gaps"), "Addresses identified research gaps"),
    )
    rows = rows.withColumn("reason", F.when(told == "", "Relevant to your query").otherwise(told))
    rows = rows.withColumn("reason", F.when(F.col("n_gaps") > 0, F.concat("reason", F.lit(" | Addresses "), F.col("n_gaps").cast("string"), F.lit(" identified gap(s)"))).otherwise(F.col("reason")))
    rows = rows.drop("has_gaps", "told_score")
    fresh = _less_shared(rows, _first_places(titled, "title", [by]), "title", weight, free, [by]) if weight > 0 else rows
    order = Window.partitionBy(by).orderBy(F.desc(F.round("score", 12)), "old_rank")
    return fresh.withColumnRenamed("rank", "old_rank").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
