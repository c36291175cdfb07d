"""Keys that hold half of all rows: joins with an aggregate of the same key must be cut up by adaptive execution."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import components, leakage

SMALL = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}


@pytest.fixture
def small(spark):
    """Thresholds as far below the usual ones as the tables here are."""
    before = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def executed(df):
    """The plan as it ran, and the number of rows."""
    n = len(df.collect())
    return df._jdf.queryExecution().executedPlan().toString(), n


def test_stars_of_a_hub(small):
    rows = small.range(60_000).select(F.col("id").alias("record_id"), F.when(F.col("id") % 2 == 0, "hub").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key")).repartition(16)
    plan, n = executed(components.star_edges(rows, "key", "record_id", "r"))
    assert n == 29_999 and "skew=true" in plan


def test_moves_of_a_hub(small):
    rows = small.range(60_000).select(
        F.col("id").alias("record_id"), F.when(F.col("id") % 20 == 0, "val").otherwise("train").alias("split"), F.lit(None).cast("string").alias("speaker_id"),
        F.when(F.col("id") % 2 == 0, "hub").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("identity_id"))
    plan, n = executed(leakage.remediation(rows))
    assert n == 3_000 and "skew=true" in plan


def test_components_around_a_hub(small):
    edges = small.range(1, 20_001).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") + 1).alias("left"), F.col("id").alias("right"))
    got = components.connected_components(edges).groupBy("component").count().collect()
    assert [(r.component, r["count"]) for r in got] == [(0, 20_001)]


@pytest.mark.parametrize("rows", [4096, 3])
def test_large_blocks_are_compared_in_parts(spark, monkeypatch, rows):
    from tesserae.operators import blocking

    monkeypatch.setattr(blocking, "BLOCK_ROWS", rows)
    data = [(i, "abc"[min(i % 5, 2)] if i % 7 else None, i % 4) for i in range(60)]
    df = spark.createDataFrame(data, "id long, block string, side int")
    got = blocking.blocked_pairs(df, ["block"], "id", ["side"], lambda a, b: (a("side") + b("side")) % 2 == 0, different=["side"])
    want = {(a, b) for a, x, s in data for b, y, t in data if a < b and x is not None and x == y and s != t and (s + t) % 2 == 0}
    found = [(r.left_id, r.right_id) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_segments_of_equal_groups_against_a_walk():
    import random

    from tesserae.operators.splits import reserved_segments

    for seed in range(400):
        r = random.Random(seed)
        sizes = sorted((r.choice([1, 1, 1, 2, 3, 5, 8, 40]) for _ in range(r.randint(0, 120))), reverse=True)
        goal = {"val": r.choice([0.0, 3.0, 10.5, 33.3, r.random() * 60]), "test": r.choice([3.0, 10.5, 20.0, r.random() * 60])}
        have = {"val": r.randint(0, 12), "test": r.randint(0, 12)}
        want, now = [], dict(have)
        for z in sizes:
            open_ = [s for s in now if goal[s] - now[s] > 0]
            s = max(open_, key=lambda x: (goal[x] - now[x], -now[x], x)) if open_ else "train"  # noqa: B023
            now[s] = now.get(s, 0) + z
            now.pop("train", None)
            want.append(s)
        got = ["train"] * len(sizes)
        classes = [(z, sizes.count(z)) for z in sorted(set(sizes), reverse=True)]
        for z, lo, hi, first, second in reserved_segments(classes, goal, dict(have)):
            for i in range(lo, hi):
                assert sizes[i] == z
                got[i] = second if (i - lo) % 2 else first
        assert got == want
