"""Groups from pairwise matches: connected components by seed-tree pruning.

Each round every vertex proposes the least key of its neighbourhood to all its neighbours. A vertex that nobody takes for
a minimum drops out of the graph and hangs below its least proposal in a propagation forest; only the minima go on, linked
among themselves. The graph shrinks geometrically. What is left without edges are the seeds, and their keys flow down the
forest, last round first. Keys are numbered in their order once, and all rounds work on the numbers. A hub's neighbourhood is
only ever aggregated (with partial counts) or joined, never held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import squeeze
from tesserae.workspace import Workspace

MAX_ROUNDS = 100


def numbered(edges: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(keys, links) of ``edges``(u, v): keys(key, id) numbers the distinct keys in their order, links(a, b) has each edge once, a < b.

    Ids are places in a range-partitioned sort, so they compare as the keys do, and all later rounds move and aggregate longs.
    Both sides of the joins are shuffled tables, so adaptive execution can split a key that holds most edges.
    """
    once = ws.write(edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "once")
    every = once.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    keys = ws.write(every.orderBy("key").select("key", F.monotonically_increasing_id().alias("id")), "keys")
    left = keys.select(F.col("key").alias("u"), F.col("id").alias("a"))
    right = keys.select(F.col("key").alias("v"), F.col("id").alias("b"))
    links = ws.write(once.join(left, "u").join(right, "v").select("a", "b"), "links")
    ws.drop(once)
    return keys, links


def seed_tree(links: DataFrame, ws: Workspace) -> DataFrame | None:
    """(k, g) for ``links``(a, b) of long ids: the least id of everything linked to k; seeds are left out. None without links.

    What a vertex with many neighbours needs is an aggregate of its rows. The aggregate is written before it is joined back,
    so that the join has a shuffle under each side and a hub's rows are split over tasks.
    """
    graph, levels = links, []
    while graph.head(1):
        if len(levels) >= MAX_ROUNDS:
            raise RuntimeError("the graph did not contract")
        ways = graph.select("a", "b").union(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ws.write(ways.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        # every vertex and each of its neighbours learn the minimum of the neighbourhood
        told = ways.join(least, "a").select(F.col("b").alias("a"), "m").union(least.select("a", "m")).distinct()
        told = ws.write(told, "told")
        kept = ws.write(told.groupBy("a").agg(F.min("m").alias("p"), F.max(F.col("m") == F.col("a")).alias("is_min")), "kept")
        pruned = (
            told.join(kept.select("a", "p"), "a").where(F.col("m") != F.col("p"))
            .select(F.least("m", "p").alias("a"), F.greatest("m", "p").alias("b")).distinct()
        )
        following = ws.write(pruned, "graph")
        ws.drop(graph, told, least)
        graph = following
        levels.append(kept)
    found = None
    for level in reversed(levels):
        here = level.where(~F.col("is_min")).select(F.col("a").alias("k"), F.col("p").alias("g"))
        if found is None:
            found = here
        else:
            top = found.select(F.col("k").alias("g"), F.col("g").alias("_g"))
            found = found.unionByName(ws.write(here.join(top, "g", "left").select("k", F.coalesce("_g", "g").alias("g")), "found"))
    return found


def connected_groups(edges: DataFrame) -> DataFrame:
    """(member_key, group_key) for undirected ``edges``(u, v): group_key is the least key of all linked.

    Repeated and reversed edges count once. Edges with a null end and edges of a key to itself link nothing; a key with
    no other edge is no member. An empty input gives an empty result. Keys compare by code point. Other columns are ignored.
    """
    ws = Workspace(edges.sparkSession, "groups")
    keys, links = numbered(edges, ws)
    found = seed_tree(links, ws)
    if found is None:
        return keys.select(F.col("key").alias("member_key"), F.col("key").alias("group_key"))
    # every key is a member; those that hang below no other are the seeds
    names = keys.select(F.col("id").alias("g"), F.col("key").alias("group_key"))
    whole = keys.join(found.withColumnRenamed("k", "id"), "id", "left").select(F.col("key").alias("member_key"), F.coalesce("g", "id").alias("g"))
    return whole.join(names, "g").select("member_key", "group_key")


def accepted_links(links: DataFrame) -> DataFrame:
    """(u, v): the trimmed keys of the links whose trimmed verdict is match in any case. Blank keys are none."""
    ends = links.where(F.lower(squeeze("verdict")) == "match").select(
        squeeze("left_key").alias("u"), squeeze("right_key").alias("v")
    )
    return ends.where((F.col("u") != "") & (F.col("v") != ""))


def consolidate_links(links: DataFrame) -> DataFrame:
    """One group key for every key that accepted rows of match_links name."""
    return connected_groups(accepted_links(links))


def group_sizes(groups: DataFrame) -> DataFrame:
    """(size, n_groups): how many groups have so many members."""
    sizes = groups.groupBy("group_key").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate_links(spark.read.parquet(f"{sf_dir}/match_links.parquet"))


def p7_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_sizes(p7_found(spark, sf_dir))
