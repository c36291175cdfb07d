"""Manifests: CSV, JSON lines, JSON documents and Parquet, by suffix; directories of splits; export folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.functions.text import squeeze

JSON_LINES, JSON_DOCUMENT, DELIMITED, COLUMNAR = (".jsonl", ".ndjson"), (".json",), (".csv",), (".parquet", ".pq")


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _files(spark, path)
    return bool(fs.exists(where))


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order."""
    fs, where = _files(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def tolerant_path(spark: SparkSession, folder: str, name: str) -> str | None:
    """The path of ``name`` in a folder, or of the entry that differs only in case and padding; None if there is none."""
    if exists(spark, f"{folder}/{name}"):
        return f"{folder}/{name}"
    alike = [x for x in names_in(spark, folder) if x.strip().lower() == name.strip().lower()]
    return f"{folder}/{alike[0]}" if alike else None


def read_manifest(spark: SparkSession, path: str, schema: StructType | str | None = None, strict: bool = False) -> DataFrame:
    """A manifest by its suffix. Blank lines are skipped; a JSON document is a list, one object, or an object with ``records``.

    CSV columns are text unless a schema is given. ``strict`` raises an error for an empty one.
    """
    suffix = PurePosixPath(path).suffix.lower()
    reader = spark.read.schema(schema) if schema is not None and suffix not in JSON_DOCUMENT else spark.read
    if suffix in JSON_LINES:
        df = reader.json(path)
    elif suffix in JSON_DOCUMENT:
        df = spark.read.option("multiLine", True).json(path)
        if df.columns == ["records"]:
            df = df.select(F.explode("records").alias("r")).select("r.*")
        if schema is not None:
            want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
            df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields])
    elif suffix in DELIMITED:
        df = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif suffix in COLUMNAR:
        df = reader.parquet(path)
    else:
        raise ValueError(f"no reader for {path}")
    if strict and not df.head(1):
        raise ValueError(f"{path} is empty")
    return df


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Text columns trimmed; blank values become null."""
    return df.select(*[F.nullif(squeeze(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def read_splits(spark: SparkSession, folder: str, schema: StructType | str | None = None) -> DataFrame:
    """train.jsonl, val.jsonl and test.jsonl of a folder if any is there, else all its JSON lines files; a missing split is the file's stem."""
    names = [n for n in names_in(spark, folder) if n.endswith(".jsonl")]
    known = [n for n in ("train.jsonl", "val.jsonl", "test.jsonl") if n in names]
    use = known or names
    if not use:
        raise FileNotFoundError(f"no JSON lines in {folder}")
    df = (spark.read.schema(schema) if schema is not None else spark.read).json([f"{folder}/{n}" for n in use])
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1)
    return df.withColumn("split", F.coalesce(F.col("split"), stem) if "split" in df.columns else stem)


def split_path(explicit: str | None, folder: str | None, split: str, names: Mapping[str, str] | None = None, suffix: str = ".jsonl") -> str:
    """The manifest of a split: an explicit path, else the folder's file of that name."""
    if explicit:
        return explicit
    if not folder:
        raise ValueError(f"no path for split {split}")
    return f"{folder.rstrip('/')}/{(names or {}).get(split, split)}{suffix}"


def read_metric_files(spark: SparkSession, root: str, name: str = "metrics.json") -> DataFrame:
    """All metric files below a folder, one row each, with ``path``."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root).withColumn("path", F.input_file_name())


def prediction_plan(spark: SparkSession, cells: Sequence[tuple], columns: Sequence[str], patterns: Sequence[str]) -> DataFrame:
    """One row per cell with the first existing of its candidate paths and a status (found or missing). Cells are a small grid."""
    rows = []
    for cell in cells:
        values = dict(zip(columns, cell))
        path = next((p for p in (q.format(**values) for q in patterns) if exists(spark, p)), None)
        rows.append((*[str(v) for v in cell], path, "found" if path else "missing"))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in (*columns, "path", "status")))


def read_export(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Rows of an export folder that its list of a split names (metadata.csv and <split>_split.txt)."""
    ids = spark.read.text(f"{folder}/{split}_split.txt").select(squeeze("value").alias("sample_id")).where("sample_id <> ''").distinct()
    return read_manifest(spark, f"{folder}/metadata.csv").join(ids, "sample_id", "left_semi")


def availability(n_files: Column, n_expected: Column, metadata: Column) -> Column:
    """missing, metadata_only, incomplete or ready."""
    return F.when((n_files == 0) & ~metadata, "missing").when(n_files == 0, "metadata_only").when(n_files < n_expected, "incomplete").otherwise("ready")


# --- sinks ---------------------------------------------------------------------------------------------------------

def write_by_split(df: DataFrame, path: str, kind: str = "json") -> None:
    """One folder per split."""
    df.write.mode("overwrite").partitionBy("split").format(kind).save(path)


def write_manifest(df: DataFrame, path: str, kind: str = "json") -> None:
    """A manifest with its columns in order of name; CSV keeps nulls as blanks."""
    w = df.select(*sorted(df.columns)).write.mode("overwrite")
    if kind == "csv":
        w.option("header", True).option("nullValue", "").csv(path)
    else:
        w.format(kind).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)
