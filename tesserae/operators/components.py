"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.workspace import Workspace

MAX_ROUNDS = 60


def star_edges(rows: DataFrame, key: str, id_col: str, rule: str) -> DataFrame:
    """(left, right, rule, value): each row of a key linked to the key's least row. Null keys link nothing; a key of n rows gives n - 1 edges."""
    keyed = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("value"), F.col(id_col).alias("right"))
    anchor = keyed.groupBy("value").agg(F.min("right").alias("left"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # written, so that the join has a shuffle under each side and the rows of a heavy key are split over tasks
    anchor = Workspace(rows.sparkSession, "stars").write(anchor, "anchor")
    return keyed.join(anchor, "value").where("left <> right").select("left", "right", F.lit(rule).alias("rule"), "value")


def connected_components(edges: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(member, component): component is the least member. Vertices without an edge to another are not listed.

    Large star: every vertex links its larger neighbours to the least vertex around it. Small star: every vertex links its
    smaller neighbours and itself to the least of them. Both only lower the far end of an edge, and a fixpoint is a star per
    component. A vertex's neighbourhood is aggregated and joined, never collected; aggregates are written before they are joined
    back, so that a hub's rows are split over tasks.
    """
    ws = Workspace(edges.sparkSession, "components")
    e = edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct()
    e, mark = ws.write(e, "edges"), None
    for _ in range(MAX_ROUNDS):
        ways = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.write(ways.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = ws.write(ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        down = ws.write(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        both = large.join(down, "u")
        small = both.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        step = ws.write(small, "edges")
        ws.drop(e, least, large, down)
        e = step
        found = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == tuple(found):
            break
        mark = tuple(found)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("member")).distinct().select("member", F.col("member").alias("component"))
    return e.select(F.col("u").alias("member"), F.col("v").alias("component")).unionByName(roots)


def labelled(rows: DataFrame, id_col: str, edges: DataFrame) -> DataFrame:
    """``rows`` with ``component``: that of their id, or the id itself where it has no edge."""
    found = connected_components(edges).select(F.col("member").alias(id_col), "component")
    return rows.join(found, id_col, "left").withColumn("component", F.coalesce("component", F.col(id_col)))


def component_sizes(members: DataFrame) -> DataFrame:
    """(component, size)."""
    return members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def component_statistics(sizes: DataFrame, max_size: int = 5000, max_share: float = 0.35) -> DataFrame:
    """One row: number of groups, rows, the largest and its share (6 decimals), the middle of the sizes in falling order, and how many groups are over the limits.

    Sizes are counted by value first, so the ordered part has one row per distinct size.
    """
    by_size = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(F.lit(1)).orderBy(F.desc("size"))
    everything = Window.partitionBy(F.lit(1))
    s = by_size.withColumn("upto", F.sum("n").over(run)).withColumn("groups", F.sum("n").over(everything)).withColumn(
        "rows", F.sum(F.col("n") * F.col("size")).over(everything))
    return s.agg(
        F.max("groups").alias("n_groups"), F.max("rows").alias("n_rows"), F.max("size").alias("largest"),
        F.round(F.max("size") / F.max("rows"), 6).alias("largest_share"),
        F.max(F.when(F.col("upto") > F.floor(F.col("groups") / 2), F.col("size"))).alias("middle_size"),
        F.coalesce(F.sum(F.when(F.col("size") > max_size, F.col("n"))), F.lit(0)).alias("over_size"),
        F.coalesce(F.sum(F.when(F.col("size") / F.col("rows") > max_share, F.col("n"))), F.lit(0)).alias("over_share"),
    )
