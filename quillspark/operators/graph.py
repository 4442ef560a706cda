"""Graph operators over edges (u, v), as joins and aggregations; rounds are cut by checkpoint() in the shared folder."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed


def last_edges(facts: DataFrame) -> DataFrame:
    """One edge a pair, with predicate and confidence of its last fact."""
    return facts.groupBy(F.col("subject_id").alias("u"), F.col("object_id").alias("v")).agg(F.max(F.struct("seq", "fact_id", "predicate", "confidence")).alias("l")).select("u", "v", "l.predicate", "l.confidence")


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree; nodes at an edge only."""
    ends = edges.select(F.col("u").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select("v", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def distances(edges: DataFrame, source: str, most: int | None = None, both_ways: bool = False) -> DataFrame:
    """node, depth: the fewest steps from source; frontier by frontier, each node once."""
    e = edges.select("u", "v")
    if both_ways:
        e = e.union(e.select("v", "u"))
    e = e.distinct()
    seen = checkpointed(e.sparkSession.createDataFrame([(source, 0)], e.select(F.col("u").alias("node")).schema.add("depth", T.IntegerType())))
    depth = 0
    while most is None or depth < most:
        step = seen.filter(F.col("depth") == depth).join(e, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth + 1))
        new = checkpointed(seen.unionByName(step))
        if not new.filter(F.col("depth") == depth + 1).limit(1).count():
            break
        seen, depth = new, depth + 1
    return seen


def neighbourhood(edges: DataFrame, source: str, depth: int = 1, distinct_edges: bool = False) -> DataFrame:
    """u, v, depth of edges met within depth steps both ways; one met from both ends comes twice unless distinct_edges."""
    near = distances(edges, source, depth - 1, both_ways=True)
    out = edges.join(near, F.col("u") == F.col("node")).unionByName(edges.join(near, F.col("v") == F.col("node"))).select("u", "v", F.col("depth"))
    return out.groupBy("u", "v").agg(F.min("depth").alias("depth")) if distinct_edges else out


def simple_paths(edges: DataFrame, source: str, target: str, most: int = 4, limit: int | None = 3) -> DataFrame:
    """path (array), length: simple paths, the shortest first, then by path."""
    e = edges.select("u", "v").distinct()
    paths = e.filter(F.col("u") == source).select(F.array("u", "v").alias("path"), "v")
    done = paths.filter(F.col("v") == target)
    for _ in range(most - 1):
        paths = paths.filter(F.col("v") != target).alias("p").join(e.alias("e"), F.col("p.v") == F.col("e.u")).filter(~F.array_contains("path", F.col("e.v"))).select(F.concat("path", F.array("e.v")).alias("path"), F.col("e.v").alias("v"))
        done = done.unionByName(paths.filter(F.col("v") == target))
    done = done.select("path", (F.size("path") - 1).alias("length")).orderBy("length", "path")
    return done.limit(limit) if limit else done


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6, weight: str | None = None) -> DataFrame:
    """node, rank: power iteration, mass of nodes without out-edges spread evenly, until the change is under tol * nodes.

    Not done within the rounds is an error, unless tol is 0: then the rounds are what is wanted.
    """
    e = edges.select("u", "v", (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    out = e.groupBy("u").agg(F.sum("w").alias("total"))
    e = checkpointed(e.join(out, "u").select("u", "v", (F.col("w") / F.col("total")).alias("share")))
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    nodes = checkpointed(nodes.join(out.select(F.col("u").alias("node"), F.lit(False).alias("dangling")), "node", "left").withColumn("dangling", F.coalesce("dangling", F.lit(True))))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        lost = ranks.filter("dangling").agg(F.sum("rank")).first()[0] or 0.0
        got = e.join(ranks, e["u"] == ranks["node"]).groupBy("v").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = ranks.join(got, F.col("node") == F.col("v"), "left").select("node", "dangling", F.col("rank").alias("old"), (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        new = checkpointed(new)
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.drop("old")
        if change < tol * n:
            break
    else:
        if tol:
            raise ValueError(f"ranks still move after {rounds} rounds")
    return ranks.select("node", "rank")


def spread_labels(edges: DataFrame, pick: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """node, label: labels from neighbours, round by round; pick makes node, label of (node, own, label, n) votes."""
    e = checkpointed(edges.select("u", "v").union(edges.select("v", "u")).filter("u <> v").distinct())
    labels = e.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = e.join(labels, e["v"] == labels["node"]).groupBy(F.col("u").alias("node"), "label").agg(F.count("*").alias("n"))
        new = checkpointed(pick(votes.join(labels.select("node", F.col("label").alias("own")), "node")))
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").limit(1).count()
        labels = new
        if not moved:
            break
    return labels


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the least node reachable): each round takes the least label around, then the label's own label, so long chains shorten fast.

    Rounds go on until nothing moves. Skewed neighbours are split by the adaptive join.
    """
    e = checkpointed(edges.select("u", "v").union(edges.select("v", "u")).filter("u <> v").distinct())
    labels = checkpointed(e.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")))
    while True:
        near = e.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = checkpointed(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")))
        tops = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = checkpointed(step.join(tops, "label").select("node", F.col("top").alias("label"), (F.col("top") != F.col("was")).alias("moved")))
        labels = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return labels


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """The most frequent label around, the least at a tie."""
    return spread_labels(edges, lambda v: v.groupBy("node").agg(F.max(F.struct("n", F.struct(F.col("label")).alias("s"))).alias("m"), F.max("n").alias("top"), F.collect_list(F.struct("n", "label")).alias("all")).select("node", F.array_min(F.transform(F.filter("all", lambda x: x["n"] == F.col("top")), lambda x: x["label"])).alias("label")), rounds)


def statistics(edges: DataFrame) -> DataFrame:
    """nodes, edges, edges_per_node, density, components, connected."""
    e = edges.select("u", "v").distinct()
    n = e.select("u").union(e.select("v")).distinct().count()
    m = e.count()
    parts = connected_components(e).select("label").distinct().count() + e.filter("u = v").select("u").join(e.filter("u <> v").select("u").union(e.filter("u <> v").select("v")).distinct(), "u", "left_anti").distinct().count()
    return e.sparkSession.createDataFrame([(n, m, m / n if n else 0.0, m / (n * (n - 1)) if n > 1 else 0.0, parts, parts == 1)], "nodes long, edges long, edges_per_node double, density double, components long, connected boolean")


def network(facts: DataFrame, min_degree: int = 1, max_nodes: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of an undirected view: a link a pair with its weight, predicates and the confidence of its first fact; nodes of
    enough neighbours, the max_nodes best of them, and links between those."""
    f = facts.filter("subject_id <> '' and object_id <> '' and lower(subject_id) <> lower(object_id)")
    links = f.groupBy(F.least("subject_id", "object_id").alias("u"), F.greatest("subject_id", "object_id").alias("v")).agg(F.count("*").alias("weight"), F.array_join(F.sort_array(F.collect_set("predicate")), ",").alias("predicates"), F.min(F.struct("seq", "confidence"))["confidence"].alias("confidence"))
    nodes = links.select(F.col("u").alias("node")).unionAll(links.select("v")).groupBy("node").agg(F.count("*").alias("degree")).filter(F.col("degree") >= min_degree).orderBy(F.desc("degree"), "node").limit(max_nodes)
    keep = lambda c: nodes.select(F.col("node").alias(c))
    return nodes, links.join(keep("u"), "u", "left_semi").join(keep("v"), "v", "left_semi")


def modularity_communities(links: DataFrame) -> DataFrame:
    """node, cluster: greedy modularity merging, clusters numbered by size, then by their first node.

    Merging is sequential by definition, but parts of the graph that nothing joins don't meet: a component is one task. Weights are not
    negative.
    """
    w = links.select("u", "v", F.col("weight").cast("double").alias("weight"))
    # a component's nodes are merged by themselves; a node with links to itself alone is one too
    part = connected_components(w).select(F.col("node").alias("u"), "label")
    rows = checkpointed(w.join(part, "u", "left").withColumn("label", F.coalesce("label", "u")))
    twice = 2 * (rows.agg(F.sum("weight")).first()[0] or 0.0) or 1.0

    def merge(df: pd.DataFrame) -> pd.DataFrame:
        weight: dict[str, dict[str, float]] = {}
        for u, v, w in df[["u", "v", "weight"]].itertuples(index=False):
            weight.setdefault(u, {})[v] = weight.get(u, {}).get(v, 0) + w
            weight.setdefault(v, {})[u] = weight.get(v, {}).get(u, 0) + w
        share = {u: sum(x.values()) / twice for u, x in weight.items()}
        members = {u: [u] for u in weight}
        between = {u: {v: w / twice for v, w in x.items() if v != u} for u, x in weight.items()}
        # the largest gain; at a tie the first u of (u, v), u before v, a longer one before its own beginning, then the last v
        first = {u: i for i, u in enumerate(sorted(weight, key=lambda u: [*map(ord, u), float("inf")]))}
        last = {u: -i for i, u in enumerate(sorted(weight))}
        name = {u: u for u in weight}
        # a pair is noted at the one with more neighbours, with those of the same weight and share: only their tie tells them apart
        like: dict[str, dict[tuple[float, float], list[tuple[tuple[int, int], str]]]] = {u: {} for u in weight}
        noted_at: dict[str, set[str]] = {u: set() for u in weight}
        heap: list[tuple[float, tuple[int, int], str, tuple[float, float]]] = []
        gain = lambda u, kind: -2 * (kind[0] - share[u] * kind[1])

        def tie(u: str, v: str) -> tuple[int, int]:
            a, b = name[u], name[v]
            return (first[a], last[b]) if a < b else (first[b], last[a])

        def note(u: str, v: str) -> None:
            u, v = (u, v) if len(between[u]) >= len(between[v]) else (v, u)
            kind, entry = (between[u][v], share[v]), (tie(u, v), v)
            heapq.heappush(same := like[u].setdefault(kind, []), entry)
            noted_at[v].add(u)
            if same[0] == entry:
                heapq.heappush(heap, (gain(u, kind), entry[0], u, kind))

        for u, x in between.items():
            for v in x:
                if u < v:
                    note(u, v)
        while heap:
            # what is noted of a pair is its gain or more: shares only grow, and a pair is noted anew where its weight, tie or other share changes
            _, _, u, kind = heap[0]
            same = like[u].get(kind, []) if u in like else []
            while same and not (between[u].get(same[0][1]) == kind[0] and share.get(same[0][1]) == kind[1] and tie(u, same[0][1]) == same[0][0]):
                heapq.heappop(same)
            if not same:
                heapq.heappop(heap)
                continue
            now = (gain(u, kind), same[0][0], u, kind)
            if now != heap[0]:
                heapq.heapreplace(heap, now)
                continue
            if -now[0] <= 1e-12:
                break
            v = same[0][1]
            u, v = (u, v) if len(between[u]) >= len(between[v]) else (v, u)
            share[u] += share.pop(v)
            members[u] += members.pop(v)
            renamed, name[u] = name[v] < name[u], min(name[u], name[v])
            changed, noted_at[u] = noted_at[u], set()
            for x, w in between.pop(v).items():
                between[x].pop(v)
                if x != u:
                    between[u][x] = between[x][u] = between[u].get(x, 0) + w
                    changed.add(x)
            del like[v], noted_at[v]
            for x in between[u] if renamed else changed & between[u].keys():
                note(u, x)
        return pd.DataFrame([(n, min(g), len(g)) for g in members.values() for n in g], columns=["node", "first", "n"])

    found = checkpointed(rows.groupBy("label").applyInPandas(merge, "node string, first string, n long"))
    # one row a cluster is numbered
    number = found.filter("node = first").select("first", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("cluster"))
    return found.join(number, "first").select("node", "cluster")


def node_view(nodes: DataFrame, links: DataFrame, search: str = "", selected: str | None = None) -> DataFrame:
    """nodes (node, label, weight) with radius by weight, and dimmed: not named by search, or not beside the selected node."""
    top = nodes.agg(F.greatest(F.lit(1.0), F.max(F.coalesce("weight", F.lit(1)).cast("double"))).alias("top"))  # one row
    rows = nodes.crossJoin(F.broadcast(top)).withColumn("radius", 3 + 9 * F.sqrt(F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)) / F.col("top"))).drop("top")
    wanted = search.strip().lower()
    dimmed = F.lit(False) if not wanted else ~F.coalesce(F.lower("label").contains(wanted), F.lit(False))
    if selected is not None:
        ends = F.when(F.col("u") == selected, F.col("v")).otherwise(F.col("u"))
        near = links.filter((F.col("u") == selected) | (F.col("v") == selected)).select(ends.alias("node")).distinct().withColumn("near", F.lit(True))
        rows = rows.join(near, "node", "left")
        dimmed = dimmed | ~(F.coalesce("near", F.lit(False)) | (F.col("node") == selected))
        return rows.withColumn("dimmed", dimmed).drop("near")
    return rows.withColumn("dimmed", dimmed)
