"""Written results: record tables with summaries, splits, graphs. A name is a folder of part files, written by all tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.labels import SPLITS
from tesserae.sources.manifests import write_manifest, write_report


def summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(column, value, n): how often each value of the named columns occurs, and under the column ``rows`` how many rows there are.

    One pass: every row counts once for each column. A null value is a value of its own.
    """
    cells = F.array(F.struct(F.lit("rows").alias("column"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in by])
    return df.select(F.explode(cells).alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))


def write_records(df: DataFrame, folder: str, name: str, by: Sequence[str] = ("source_dataset", "split", "unified_emotion")) -> None:
    """<name>.csv, <name>.jsonl and <name>_summary.json. Columns that CSV cannot hold are written to it as JSON."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes])
    write_manifest(flat, f"{folder}/{name}.csv", "csv")
    write_manifest(df, f"{folder}/{name}.jsonl")
    write_report(summary(df, [c for c in by if c in df.columns]).orderBy("column", "value"), f"{folder}/{name}_summary.json")


def write_splits(df: DataFrame, folder: str) -> None:
    """all, train, val and test, each as .jsonl and .csv. Rows of no split stand in ``all`` only."""
    for name in ("all", *SPLITS):
        part = df if name == "all" else df.where(F.col("split") == name)
        flat = part.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in part.dtypes])
        write_manifest(part, f"{folder}/{name}.jsonl")
        write_manifest(flat, f"{folder}/{name}.csv", "csv")


def write_graph(edges: DataFrame, vertices: DataFrame, facts: DataFrame, folder: str) -> None:
    """edges and vertices as Parquet, and the facts (one row) as JSON."""
    edges.write.mode("overwrite").parquet(f"{folder}/edges.parquet")
    vertices.write.mode("overwrite").parquet(f"{folder}/vertices.parquet")
    write_report(facts, f"{folder}/metadata.json")


def write_export(rows: DataFrame, folder: str) -> None:
    """metadata.csv, metadata.json and a list of the ids of each split, as ``manifests.read_export`` reads them."""
    flat = rows.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in rows.dtypes])
    write_manifest(flat, f"{folder}/metadata.csv", "csv")
    write_manifest(rows, f"{folder}/metadata.json")
    for s in SPLITS:
        rows.where(F.col("split") == s).select(F.col("sample_id").cast("string")).write.mode("overwrite").text(f"{folder}/{s}_split.txt")
