"""Graph operators over edge tables; iterations are checkpointed through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import blocks
from threadloom.operators.joins import parts_of, spread
from threadloom.plans.fixpoint import connected_components, discard, fixpoint, saved


def actor_edges(edges: DataFrame, source: str, target: str, scope: list[str], day: str) -> DataFrame:
    """Weight, first and last day of each directed pair of actors; self-loops out."""
    return edges.where(F.col(source) != F.col(target)).groupBy(*scope, source, target).agg(F.count(F.lit(1)).alias("weight"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def reciprocity(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """Directed pairs, and those whose reverse exists too."""
    back = pairs.select(F.col(target).alias("_s"), F.col(source).alias("_t")).distinct()
    mutual = pairs.join(back, (F.col(source) == F.col("_s")) & (F.col(target) == F.col("_t")), "left_semi")
    return pairs.agg(F.count(F.lit(1)).alias("edges")).crossJoin(F.broadcast(mutual.agg(F.count(F.lit(1)).alias("mutual"))))  # one row each


def component_sizes(edges: DataFrame) -> DataFrame:
    return connected_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


def reach_levels(edges: DataFrame, parent: str, child: str, limit: int = 10_000) -> DataFrame:
    """Depth of every node under its root (in-degree zero), level by level; each level is saved, and its joins are on keys."""
    hops = edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).distinct()
    roots = hops.select("p").distinct().join(hops.select(F.col("c").alias("p")).distinct(), "p", "left_anti")
    level = saved(roots.select(F.col("p").alias("node"), F.col("p").alias("root"), F.lit(0).alias("depth")), "level")
    seen = level
    for depth in range(1, limit):
        down = level.join(hops, level["node"] == hops["p"]).select(F.col("c").alias("node"), "root").distinct()
        level = saved(down.join(seen, ["node", "root"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)
    raise RuntimeError("deeper than the limit")


def pagerank(edges: DataFrame, source: str, target: str, weight: str, damping: float = 0.85, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """Weighted PageRank by power iteration; dangling mass goes to all nodes alike. With a ``tolerance`` it ends once the ranks change
    by less in sum, and fails if ``rounds`` do not get there; without, it does ``rounds``."""
    g, sends = step_grid(edges, source, target, weight)
    n = g.sizes["left"]
    if not n:
        return blocks.listed(g, blocks.filled(g, "left", 0.0)).select("node", F.col("value").alias("rank"))
    ranks, change = blocks.walk(g, blocks.filled(g, "left", 1.0 / n), sends, damping, rounds, tolerance)
    g.cells.unpersist()
    if tolerance is not None and not change < tolerance:
        raise RuntimeError(f"ranks still change by {change} after {rounds} rounds")
    return saved(blocks.listed(g, ranks).select("node", F.col("value").alias("rank")), "ranks")


def step_grid(edges: DataFrame, source: str, target: str, weight: str) -> tuple[blocks.Grid, DataFrame]:
    """The grid of each edge's part of its source's weight, and a vector that is one for the sources."""
    e = saved(edges.groupBy(F.col(source).alias("s"), F.col(target).alias("t")).agg(F.sum(weight).alias("w")), "edges")
    parts, out = parts_of(e), e.groupBy("s").agg(F.sum("w").alias("total"))
    steps = spread(e, parts, "s").join(spread(out, parts, "s").hint("merge"), "s").select("s", "t", (F.col("w") / F.col("total")).alias("p"))
    g = blocks.grid(saved(steps, "steps"), "s", "t", "p", shared=True)
    return g, blocks.placed(g, "left", out.select(F.col("s").alias("node"), F.lit(1.0).alias("value")))


def birank(edges: DataFrame, left: str, right: str, weight: str, rounds: int = 20) -> DataFrame:
    """Alternating scores of a bipartite graph, each side from the other's previous scores, scaled to sum 1."""
    e = saved(edges.groupBy(F.col(left).alias("l"), F.col(right).alias("r")).agg(F.sum(weight).cast("double").alias("w")), "edges")
    g = blocks.grid(e, "l", "r", "w")
    scores, totals = saved(blocks.filled(g, "left", 1.0).unionByName(blocks.filled(g, "right", 1.0)), "scores"), {"left": 1.0, "right": 1.0}
    for _ in range(rounds):
        last, scores = scores, saved(blocks.sums(g, scores, totals), "scores")
        totals |= blocks.side_totals(scores)
        discard(last)
    total = F.when(F.col("side") == "left", totals["left"]).otherwise(totals["right"])
    out = saved(blocks.listed(g, scores).select("side", "node", (F.col("value") / total).alias("score")), "scores")
    g.cells.unpersist()
    return out


def link_grid(edges: DataFrame, a: str, b: str) -> tuple[blocks.Grid, DataFrame, int]:
    """The shared grid of both directions of a simple undirected graph's links, these links (``u``, ``v``), and how many they are."""
    pairs = saved(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")), "pairs")
    once = spread(pairs, parts_of(pairs), "u", "v").distinct()
    links = saved(once.unionByName(once.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links")
    return blocks.grid(links, "u", "v", None, shared=True, each=blocks.EDGES_A_CELL // 2), links, links.count()


def core_numbers(edges: DataFrame, a: str, b: str, rounds: int = 10_000) -> DataFrame:
    """k-core number of each node of a simple undirected graph: from the degrees, every node takes the h-index of its neighbours'
    numbers until none changes. Numbers only fall, so an unchanged sum is the fixpoint; one round peels what takes many by degree.
    Links stay in the grid of cells, only numbers and their counts are shuffled."""
    g, _, many = link_grid(edges, a, b)
    numbers = blocks.filled(g, "left", 1.0)
    if many:
        degrees = saved(blocks.own_side(blocks.sums(g, numbers, {"left": 1.0})), "round")
        numbers = fixpoint(degrees, lambda now: blocks.h_indices(g, now), lambda now: tuple(now.agg(F.sum("total")).first()), rounds)
    out = saved(blocks.listed(g, numbers).select("node", F.col("value").cast("int").alias("core")), "cores")
    g.cells.unpersist()
    return out


def modularity(edges: DataFrame, source: str, target: str, weight: str, member: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Modularity of a partition (``node``, ``community``) of a weighted undirected graph."""
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t"), F.col(weight).cast("double").alias("w"))
    m = member.select(F.col("node").alias("s"), F.col("community").alias("cs")), member.select(F.col("node").alias("t"), F.col("community").alias("ct"))
    j = e.join(m[0], "s").join(m[1], "t")
    ends = j.select(F.col("cs").alias("c"), "w").unionByName(j.select(F.col("ct").alias("c"), "w"))
    inner = j.groupBy(F.col("cs").alias("c")).agg(F.sum(F.when(F.col("cs") == F.col("ct"), F.col("w")).otherwise(0.0)).alias("lc"))
    parts = ends.groupBy("c").agg(F.sum("w").alias("dc")).join(inner, "c", "left").withColumn("lc", F.coalesce("lc", F.lit(0.0)))
    total = e.agg(F.sum("w").alias("m"))
    return parts.crossJoin(F.broadcast(total)).agg(F.sum(F.col("lc") / F.col("m") - resolution * F.pow(F.col("dc") / (2 * F.col("m")), 2)).alias("modularity"), F.count(F.lit(1)).alias("communities"))


def participation(edges: DataFrame, source: str, target: str, weight: str, member: DataFrame) -> DataFrame:
    """1 - sum over communities of (a node's weight into it / its strength) squared."""
    both = edges.select(F.col(source).alias("node"), F.col(target).alias("o"), F.col(weight).cast("double").alias("w"))
    both = both.unionByName(both.select(F.col("o").alias("node"), F.col("node").alias("o"), "w"))
    into = both.join(member.select(F.col("node").alias("o"), "community"), "o").groupBy("node", "community").agg(F.sum("w").alias("w"))
    return into.groupBy("node").agg((1 - F.sum(F.col("w") * F.col("w")) / (F.sum("w") * F.sum("w"))).alias("participation"), F.sum("w").alias("strength"))
