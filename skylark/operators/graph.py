"""Graphs as edge tables: components, PageRank, breadth-first search, degrees. Iterations end in a checkpoint each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylark.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that the links a, b reach, for each node that has a link.

    Alternating large-star and small-star steps, so that the rounds grow with the logarithm of a path's length; a node of
    very many links is grouped by partial minima only, and each round ends in a checkpoint.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = least(large)
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = checkpointed(small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) in both directions of undirected links (a, b, weight)."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) by power iteration over weighted undirected links (a, b, weight); ranks sum to one.

    Every node has a link, so no rank is stranded. The edges are shuffled by their source once; each round moves one number per edge.
    """
    links = both_ways(edges)
    out = links.groupBy("src").agg(F.sum("weight").alias("total"))
    links = checkpointed(links.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("part")).repartition("src"))
    nodes = checkpointed(out.select(F.col("src").alias("node")))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        moved = links.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("part") * F.col("rank")).alias("got"))
        ranks = moved.select(F.col("dst").alias("node"), (F.lit((1 - damping) / max(n, 1)) + damping * F.col("got")).alias("rank"))
        if k % 4 == 3:
            ranks = checkpointed(ranks)
    return ranks


def label_communities(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, community) by label propagation over weighted undirected links (a, b, weight): a node takes the label of most weight among its neighbours; of several such its own,
    else the least.

    In each round one half of the nodes moves, by a hash of node and round, so that neighbours don't swap labels for ever. It ends when no node of either half would move, or after
    so many rounds. A community is named by its least node. Each round moves one label per edge and sums per (node, label) before anything else, so that a node of very many links
    is no group of its own.
    """
    links = checkpointed(both_ways(edges.where("a <> b")).groupBy("src", "dst").agg(F.sum("weight").alias("weight")).repartition("src"))
    labels = checkpointed(links.select("src").distinct().select(F.col("src").alias("node"), F.col("src").alias("label")))
    for turn in range(rounds):
        told = links.join(labels, F.col("src") == F.col("node")).groupBy("dst", "label").agg(F.sum("weight").alias("weight"))
        own = labels.select(F.col("node").alias("dst"), F.col("label").alias("own"))
        best = F.min_by("label", F.struct(-F.col("weight"), F.col("label") != F.col("own"), "label"))
        held = checkpointed(told.join(own, "dst").groupBy("dst", "own").agg(best.alias("new")))
        if held.where("new <> own").isEmpty():
            break
        moves = F.pmod(F.xxhash64("dst", F.lit(turn)), F.lit(2)) == 0
        labels = held.select(F.col("dst").alias("node"), F.when(moves, F.col("new")).otherwise(F.col("own")).alias("label"))
    least = labels.groupBy("label").agg(F.min("node").alias("community"))
    return labels.join(least, "label").select("node", "community")


def reach(edges: DataFrame, seeds: DataFrame, hops: int, max_degree: int | None = None) -> DataFrame:
    """(node, depth): least number of hops from any seed (a table with `node`), up to `hops`. Nodes of more than max_degree links are reached but not passed through."""
    links = both_ways(edges.withColumn("weight", F.lit(1))).select("src", "dst").distinct()
    if max_degree is not None:
        degree = links.groupBy("src").count().where(F.col("count") <= max_degree).select("src")
        start = seeds.select(F.col("node").alias("src"))
        links = links.join(degree.unionByName(start).distinct(), "src", "left_semi")
    links = checkpointed(links)
    seen = checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    edge = seen
    for depth in range(1, hops + 1):
        found = edge.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        edge = checkpointed(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(edge)
    return seen


def degrees(*tables: DataFrame) -> DataFrame:
    """(node, degree): links a, b of all tables counted at both ends."""
    ends = None
    for t in tables:
        for c in ("a", "b"):
            part = t.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias("n"))
            ends = part if ends is None else ends.unionByName(part)
    return ends.groupBy("node").agg(F.sum("n").alias("degree"))
