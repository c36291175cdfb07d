"""Order at random, batches, sets and maps of values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.skew import in_order
from tesserae.workspace import Workspace


def batches(df: DataFrame, id_col: str, size: int, seed: int | None = None) -> DataFrame:
    """Rows with ``place`` and ``batch`` (from 0, ``size`` rows each, the last one shorter): in order of the id, or shuffled by a seed.

    The shuffle orders by a digest of id and seed, so it is the same on every run; one sort by ranges gives the places.
    """
    if size < 1:
        raise ValueError("a batch needs a row")
    if seed is None:
        out = in_order(df, [id_col], Workspace(df.sparkSession, "batches"))
    else:
        key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
        out = in_order(df.withColumn("_key", key), ["_key", id_col], Workspace(df.sparkSession, "batches")).drop("_key")
    return out.withColumn("batch", F.floor(F.col("place") / size))


def same_set(a, b) -> Column:
    """Whether two arrays hold the same values, whatever their order and number. Null arrays are the same as each other only."""
    s = lambda x: F.array_sort(F.array_distinct(F.col(x) if isinstance(x, str) else x))
    return s(a).eqNullSafe(s(b))


def present_map(columns: Mapping[str, Column]) -> Column:
    """A map from names to the values that are there; null ones are left out."""
    pairs = [x for k, c in columns.items() for x in (F.lit(k), c)]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
