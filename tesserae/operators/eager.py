"""Eager aggregation: both inputs of a join are aggregated by the join key before they meet.

A key of m rows on one side and n on the other would make m x n joined rows in one task. Here each side becomes one compact
state per key (with map-side partial aggregation, so a key that holds a third of all rows is spread over all map tasks);
the states are joined one to one, counts multiply, sums scale by the other side's count, and a roll-up follows where the
asked grouping is coarser than the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.workspace import Workspace


def key_profile(df: DataFrame, key: str, sets: Mapping[str, Column] | None = None, counts: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, n_rows, n_<name>..., <name>...) per non-null key.

    ``counts`` are conditions, counted. ``sets`` are values of bounded domains (splits, sources, categories): their distinct
    non-null values are counted (n_<name>) and listed in order, joined by commas (<name>). The list of a key is as long as
    the domain and never as long as the key's rows. A null key has no profile; an empty table gives none.
    """
    sets, counts = sets or {}, counts or {}
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(c).alias(n) for n, c in counts.items()]
    aggs += [F.collect_set(c).alias(f"_set_{n}") for n, c in sets.items()]
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    keep = [key, "n_rows", *counts]
    for n in sets:
        out = out.withColumn(f"n_{n}", F.size(f"_set_{n}").cast("long")).withColumn(n, F.array_join(F.array_sort(f"_set_{n}"), ","))
        keep += [f"n_{n}", n]
    return out.select(*keep)


def eager_join(
    left: DataFrame, right: DataFrame, key: str, left_by: Sequence[str] = (), right_by: Sequence[str] = (),
    left_sums: Sequence[str] = (), right_sums: Sequence[str] = (),
) -> DataFrame:
    """What ``left JOIN right USING (key) GROUP BY left_by, right_by`` gives for count and sums, without the joined rows.

    Result: left_by..., right_by..., n_pairs, sum_<column>...; a sum of nulls only is null, as in SQL. Grouping columns of the
    right hold few values per key. Columns of the same name on both sides are told apart by their side: name ``left_by`` and
    ``right_by`` differently.
    """
    a = left.where(F.col(key).isNotNull()).groupBy(key, *left_by).agg(
        F.count(F.lit(1)).alias("_na"), *[F.sum(c).alias(f"_a_{c}") for c in left_sums]
    )
    b = right.where(F.col(key).isNotNull()).groupBy(key, *right_by).agg(
        F.count(F.lit(1)).alias("_nb"), *[F.sum(c).alias(f"_b_{c}") for c in right_sums]
    )
    # written, so that the join has a shuffle under each side and a key with many states of the left is split over tasks
    states = a.join(Workspace(left.sparkSession, "states").write(b, "right"), key)
    aggs = [F.sum(F.col("_na") * F.col("_nb")).alias("n_pairs")]
    aggs += [F.sum(F.col(f"_a_{c}") * F.col("_nb")).alias(f"sum_{c}") for c in left_sums]
    aggs += [F.sum(F.col(f"_b_{c}") * F.col("_na")).alias(f"sum_{c}") for c in right_sums]
    return states.groupBy(*left_by, *right_by).agg(*aggs)
