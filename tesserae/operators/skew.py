"""Operators that stay balanced when a few keys hold most rows.

Heavy keys are found exactly from partial counts. Their number is bounded by rows / threshold, so the table of heavy
keys is the one side here that may be broadcast; everything else goes by one shuffle of keys that are not heavy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is heavy from so many rows on. With it a light key never holds more rows than one task takes with ease.
HEAVY_ROWS = 20_000
#: Heavy keys are only broadcast up to this number; beyond it they are joined by shuffle.
HEAVY_LIMIT = 100_000


def heavy_keys(df: DataFrame, keys: Sequence[str], threshold: int = HEAVY_ROWS) -> DataFrame:
    """The keys of more than ``threshold`` rows with their number, counted over all rows (map-side partial counts)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > threshold)


def lookup_join(rows: DataFrame, dim: DataFrame, key: str, heavy: DataFrame, n_heavy: int, how: str = "left") -> DataFrame:
    """``rows`` joined to ``dim`` (unique by ``key``) where some keys are heavy in ``rows``.

    Rows of heavy keys meet a broadcast slice of ``dim`` (as many rows as there are heavy keys); the rest meet by shuffle.
    Null keys take the second way and, in a left join, find nothing.
    """
    if n_heavy == 0 or n_heavy > HEAVY_LIMIT:
        return rows.join(dim, key, how)
    hot = heavy.select(key)
    slice_ = dim.join(F.broadcast(hot), key, "left_semi")
    tagged = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    return (
        tagged.where(F.col("_hot")).drop("_hot").join(F.broadcast(slice_), key, how)
        .unionByName(tagged.where(F.col("_hot").isNull()).drop("_hot").join(dim, key, how))
    )


def salted(seed_col: Column, buckets: int) -> Column:
    """A salt that a recomputed task gives again: taken from the row, not from a random stream."""
    return F.pmod(F.xxhash64(seed_col), F.lit(buckets)).cast("int")


def prefix_sums(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], weight: Column, position: Column, buckets: int = 1024
) -> DataFrame:
    """Adds ``before``: the sum of ``weight`` over the rows of the group that stand before this one.

    ``position`` in [0, 1) gives the order, ties fall to ``order``. A group is cut into ``buckets`` ranges of the position:
    sums of ranges are a small table (groups x buckets), and only inside one range rows are ordered, so no task ever
    holds a whole group. Null weights count 0.
    """
    b = df.withColumn("_w", F.coalesce(weight, F.lit(0))).withColumn("_pos", position)
    b = b.withColumn("_b", F.floor(F.col("_pos") * buckets).cast("int"))
    part = b.groupBy(*groups, "_b").agg(F.sum("_w").alias("_bw"))
    up = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_off", F.coalesce(F.sum("_bw").over(up), F.lit(0))).drop("_bw")
    inner = Window.partitionBy(*groups, "_b").orderBy("_pos", *order).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_in", F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    eq = [b[g].eqNullSafe(part[g]) for g in groups] + [b["_b"] == part["_b"]]
    cond = eq[0]
    for e in eq[1:]:
        cond = cond & e
    keep = [b[c] for c in df.columns]
    return b.join(part, cond).select(*keep, (b["_in"] + part["_off"]).alias("before"))


def in_order(df: DataFrame, order: Sequence[str], ws) -> DataFrame:
    """Adds ``place``: the row's place from 0 in the order of the columns, over the whole table.

    A range-partitioned sort is written with the partition and the row within it; the offsets of the partitions are one row
    each. No task holds more than its range, whatever the groups are. ``order`` should tell rows apart, else ties are in any order.
    """
    at = ws.write(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_m", 33)
    sizes = at.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # a row per partition
    rows = at.withColumn("_p", part).join(F.broadcast(sizes), "_p")
    return rows.withColumn("place", F.col("_off") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_off", "_m")


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) from a hash of the columns: the same on every run and every executor."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1)).cast("double")) / F.lit(float(1 << 52))
