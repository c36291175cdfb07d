"""Samples with target category shares: the cube method.

A cell is one combination of the balanced categories. Every unit starts with its cell's inclusion probability. A flight
phase moves probabilities along vectors on which all category counts stand still, until each unit is 0 or 1 or no such
vector is left. Units are dealt to a fixed number of virtual partitions by a hash of their key, so the draw does not depend on how
Spark parts the table. Two units of one cell always give such a vector, so a partition flies all its cells at once by pairs
(each round settles at least one unit of every pair, so the work is linear); at most one unit per cell is left. The left
units of all partitions merge upward: first by cell, then the cells of a stratum together, where null vectors of the
category indicators are sought for further category columns. The landing settles the remainder by dropping the category
constraints and keeping the size; what imbalance is left is reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.labels import emotion_of, split_of
from tesserae.workspace import Workspace

EPS = 1e-9
#: Virtual partitions of the first flight: at most so many units per cell merge upward, whatever the size of the table.
PARTS = 16_384


def _uniform(keys: np.ndarray, salt: str) -> np.ndarray:
    """Numbers in [0, 1) that depend on the keys and the salt only, so that a task run again gives the same."""
    h = pd.util.hash_array(np.asarray(keys, dtype=object), hash_key=hashlib.md5(salt.encode()).hexdigest()[:16])
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


def _move(a: np.ndarray, b: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step for pairs of probabilities with a fixed sum: one of the two reaches 0 or 1, expectations stay."""
    s = a + b
    low = s < 1
    hi, lo = np.where(low, s, 1.0), np.where(low, 0.0, s - 1.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = np.where(low, np.where(s > 0, a / np.where(s > 0, s, 1), 0.5), np.where(s < 2, (1 - b) / np.where(s < 2, 2 - s, 1), 0.5))
    first = u < p
    return np.where(first, hi, lo), np.where(first, lo, hi)


def fly_pairs(cell: np.ndarray, pi: np.ndarray, keys: np.ndarray, salt: str) -> np.ndarray:
    """Probabilities after the flight by pairs within cells: at most one unit per cell is strictly between 0 and 1."""
    pi = pi.astype(float).copy()
    level = 0
    while True:
        open_ = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
        if open_.size < 2:
            break
        u = _uniform(keys[open_], f"{salt}/{level}")
        order = open_[np.lexsort((u, cell[open_]))]
        c = cell[order]
        start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        rank = np.arange(c.size) - np.repeat(start, np.diff(np.r_[start, c.size]))
        left = np.flatnonzero((rank % 2 == 0)[:-1] & (c[1:] == c[:-1])) if c.size > 1 else np.array([], int)
        if left.size == 0:
            break
        i, j = order[left], order[left + 1]
        pi[i], pi[j] = _move(pi[i], pi[j], _uniform(keys[i], f"{salt}/{level}/move"))
        level += 1
    pi[pi < EPS] = 0.0
    pi[pi > 1 - EPS] = 1.0
    return pi


def fly_general(a: np.ndarray, pi: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The flight for any balancing matrix ``a`` (units x constraints) of a few units: moves along null vectors."""
    pi = pi.astype(float).copy()
    for draw in u:
        open_ = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
        if open_.size == 0:
            break
        part = open_[: a.shape[1] + 1]
        m = a[part].T
        _, s, vt = np.linalg.svd(m)
        rank = int((s > 1e-9 * max(1.0, s.max(initial=0))).sum())
        if rank >= part.size:
            break
        v = vt[-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(v > EPS, (1 - pi[part]) / v, np.where(v < -EPS, -pi[part] / v, np.inf)).min()
            down = np.where(v > EPS, pi[part] / v, np.where(v < -EPS, (pi[part] - 1) / v, np.inf)).min()
        step = up if draw < down / (up + down) else -down
        pi[part] = np.clip(pi[part] + step * v, 0, 1)
        pi[(pi < EPS)] = 0.0
        pi[(pi > 1 - EPS)] = 1.0
    return pi


def _flight(cell_cols: Sequence[str], key_col: str, salt: str):
    """Flies whole cells: the rows of a cell (here: of a virtual partition and a cell) stand in one frame."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key_col, kind="stable", ignore_index=True)
        cell = f.groupby(list(cell_cols), dropna=False, sort=True).ngroup().to_numpy()
        f["pi"] = fly_pairs(cell, f["pi"].to_numpy(), f[key_col].astype(str).to_numpy(), salt)
        return f[f["pi"] > 0]

    return run


def _by_part(fly):
    """``fly`` over a partition sorted by ``_part``: whole virtual partitions at a time, never more than a batch and one of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            if not len(f):
                continue
            last = f["_part"].to_numpy() == f["_part"].iloc[-1]
            if held and not last.all() or held and held[-1]["_part"].iloc[-1] != f["_part"].iloc[-1]:
                yield fly(pd.concat([*held, f[~last]], ignore_index=True)).drop(columns="_part")
                held = [f[last]]
            elif not last.all():
                yield fly(f[~last]).drop(columns="_part")
                held = [f[last]]
            else:
                held.append(f)
        if held:
            yield fly(pd.concat(held, ignore_index=True)).drop(columns="_part")

    return run


def _landing(stratum: Sequence[str], categories: Sequence[str], key_col: str, salt: str):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([*categories, key_col], kind="stable", ignore_index=True)
        keys = f[key_col].astype(str).to_numpy()
        pi = f["pi"].to_numpy(float)
        size = np.ones((len(f), 1))
        shown = [pd.get_dummies(f[c].astype(str)).to_numpy(float) for c in categories]
        # all constraints first, then fewer and fewer categories, the size last
        for k in range(len(shown), -1, -1):
            a = np.hstack([size, *shown[:k]])
            pi = fly_general(a, pi, _uniform(keys, f"{salt}/land/{k}"))
        open_ = (pi > 0) & (pi < 1)
        pi[open_] = (_uniform(keys, f"{salt}/last")[open_] < pi[open_]).astype(float)
        f["pi"] = pi
        return f[f["pi"] > 0]

    return run


def cube_sample(
    units: DataFrame, key: str, stratum: Sequence[str], categories: Sequence[str], probability: str = "pi", seed: int = 0
) -> DataFrame:
    """The units drawn. ``units`` has one row per (stratum, key) with its inclusion probability.

    Within a stratum the number drawn from each cell (combination of ``categories``) is its sum of probabilities, rounded
    up or down. Units with a null probability or 0 are never drawn, those with 1 always. The result has the columns of
    stratum, categories and key; an empty table gives an empty one. The draw depends on the units and the seed only, not on the
    partitions of the table or of the shuffles.
    """
    cells = [*stratum, *categories]
    base = units.where(F.col(probability) > 0).select(*cells, key, F.least(F.col(probability), F.lit(1.0)).cast("double").alias("pi"))
    sure = base.where(F.col("pi") >= 1 - EPS).select(*cells, key)
    ws = Workspace(units.sparkSession, "cube")
    schema = base.schema
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(PARTS)).cast("int")
    parted = base.where(F.col("pi") < 1 - EPS).withColumn("_part", part)
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = parted.repartition(n, "_part").sortWithinPartitions("_part")
    flown = ws.write(parted.mapInPandas(_by_part(_flight(["_part", *cells], key, f"{seed}/0")), schema), "flown")
    # at most one open unit per cell and virtual partition goes on: merged by cell, then by stratum
    merged = flown.where(F.col("pi") < 1).groupBy(*cells).applyInPandas(_flight(cells, key, f"{seed}/1"), schema)
    merged = ws.write(merged, "merged")
    landed = merged.where(F.col("pi") < 1).groupBy(*stratum).applyInPandas(_landing(stratum, categories, key, f"{seed}/2"), schema)
    parts = [sure, flown.where(F.col("pi") >= 1), merged.where(F.col("pi") >= 1), landed]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*cells, key))
    return out


def distinct_samples(records: DataFrame) -> DataFrame:
    """(split, unified_emotion, sample_id): each distinct sample of each split with a category of the taxonomy.

    A redelivered sample counts once. Rows without split, category or sample_id are no units.
    """
    return (
        records.select(split_of("split").alias("split"), emotion_of("unified_emotion").alias("unified_emotion"), "sample_id")
        .dropna().distinct()
    )


def sample_to_targets(records: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of ``records`` under ``targets`` (split, unified_emotion, sample_fraction, target_share, min_rows).

    Of each split's N distinct samples, target_share x sample_fraction x N of each emotion are asked for, but no fewer than
    min_rows. Where a cell has fewer, all are drawn and the report says so. report has one row per target row: asked (the
    amount before rounding), available, drawn, share_drawn (of the split's sample), imbalance (drawn - min(asked, available))
    and falls_short. A target row with a null split or emotion meets no sample and falls short if it asks for any. A sample
    that stands in a split with two emotions is a unit of both cells and counts once in N.
    """
    ws = Workspace(records.sparkSession, "sample")
    units = ws.write(distinct_samples(records), "units")
    per_cell = units.groupBy("split", "unified_emotion").agg(F.count(F.lit(1)).alias("available"))
    n_split = units.select("split", "sample_id").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("n_split"))
    want = (
        targets.select("split", "unified_emotion", "sample_fraction", "target_share", "min_rows")
        .join(F.broadcast(n_split), "split", "left").join(F.broadcast(per_cell), ["split", "unified_emotion"], "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("asked", F.greatest(
            F.coalesce(F.col("min_rows").cast("double"), F.lit(0.0)),
            F.coalesce(F.col("target_share") * F.col("sample_fraction") * F.coalesce("n_split", F.lit(0)), F.lit(0.0))))
    )
    want = ws.write(want, "want")
    pi = F.when(F.col("asked") >= F.col("available"), 1.0).otherwise(F.col("asked") / F.col("available"))
    cells = want.where(F.col("available") > 0).groupBy("split", "unified_emotion").agg(F.max(pi).alias("pi"))
    # cells are at most splits x taxonomy
    drawn = cube_sample(units.join(F.broadcast(cells), ["split", "unified_emotion"]), "sample_id", ["split"], ["unified_emotion"], seed=seed)
    drawn = ws.write(drawn, "drawn")
    got = drawn.groupBy("split", "unified_emotion").agg(F.count(F.lit(1)).alias("drawn"))
    total = got.groupBy("split").agg(F.sum("drawn").alias("_total"))
    report = (
        want.join(got, ["split", "unified_emotion"], "left").join(total, "split", "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .withColumn("share_drawn", F.try_divide(F.col("drawn").cast("double"), F.col("_total")))
        .withColumn("imbalance", F.col("drawn") - F.least("asked", F.col("available").cast("double")))
        # a short cell has fewer than asked; a landing that gave a cell less than its whole number falls short as well
        .withColumn("falls_short", (F.col("available") < F.col("asked")) | (F.col("drawn") < F.floor("asked")))
        .select("split", "unified_emotion", "asked", "available", "drawn", "target_share", "share_drawn", "imbalance", "falls_short")
    )
    return drawn, report


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sample_to_targets(
        spark.read.parquet(f"{sf_dir}/normalized_records.parquet"), spark.read.parquet(f"{sf_dir}/sample_targets.parquet")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[1].where("falls_short").select("split", "unified_emotion")


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, unified_emotion, sample_id) of the samples drawn."""
    return _run(spark, sf_dir)[0]


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[1]


def p1_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every draw: the amounts, and that each cell gives its amount (or all it has) rounded up or down."""
    most = F.least("asked", F.col("available").cast("double"))
    whole = (F.col("drawn") >= F.floor(most)) & (F.col("drawn") <= F.ceil(most))
    return _run(spark, sf_dir)[1].select("split", "unified_emotion", F.round("asked", 6).alias("asked"), "available", "falls_short", whole.alias("drawn_whole"))
