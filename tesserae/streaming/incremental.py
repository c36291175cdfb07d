"""Leakage and arrival statistics over a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.labels import split_of
from tesserae.functions.text import key_of


def arrivals(records: DataFrame, late: str = "1 day", window: str = "7 days") -> DataFrame:
    """(window start, source_dataset, split, n) of arriving records by event time; later ones than ``late`` are left out."""
    r = records.select("ingested_at", "source_dataset", split_of("split").alias("split"))
    w = F.window("ingested_at", window)
    if r.isStreaming:
        r = r.withWatermark("ingested_at", late)
    return r.groupBy(w, "source_dataset", "split").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "source_dataset", "split", "n")


def key_states(records: DataFrame, key: str = "identity_id") -> DataFrame:
    """(key, n_train, n_val, n_test) of one batch: states of this form add up over batches."""
    r = records.select(key_of(key).alias("key"), split_of("split").alias("split")).where("key IS NOT NULL AND split IS NOT NULL")
    return r.groupBy("key").agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")])


def merged(*states: DataFrame) -> DataFrame:
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("key").agg(*[F.sum(f"n_{s}").alias(f"n_{s}") for s in ("train", "val", "test")])


def leaking(states: DataFrame) -> DataFrame:
    """The keys that stand in more than one split."""
    n = sum(F.when(F.col(f"n_{s}") > 0, 1).otherwise(0) for s in ("train", "val", "test"))
    return states.where(n > 1)


def run_incremental(spark: SparkSession, folder: str, out: str, checkpoint: str, key: str = "identity_id", files_per_batch: int = 1) -> DataFrame:
    """Reads a folder of record files as a stream and keeps one state table per batch under ``out``; returns the leaking keys.

    A batch that is run again replaces its own table, so the result does not depend on failures.
    """
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def keep(batch: DataFrame, epoch: int) -> None:
        key_states(batch, key).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return leaking(merged(spark.read.parquet(out).drop("batch")))
