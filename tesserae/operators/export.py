"""Benchmarks, exports and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.hashing import anonymous_id
from tesserae.functions.text import safe_token
from tesserae.operators.skew import in_order
from tesserae.workspace import Workspace


def flattened(df: DataFrame, prefix: str = "", sep: str = "_") -> list[Column]:
    """Columns of all leaves of nested structs, named by their path."""
    from pyspark.sql.types import StructType

    def walk(schema, path):
        for f in schema.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(prefix + sep.join(here))

    return list(walk(df.schema, []))


def without_transient(df: DataFrame) -> DataFrame:
    """The table without columns whose name begins with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def examples(rows: DataFrame, order: list, limit: int = 10) -> DataFrame:
    """The first few rows in an order, for a report."""
    return rows.orderBy(*order).limit(limit)


def numbered_groups(groups: DataFrame, group: str, prefix: str = "group") -> DataFrame:
    """(group, name): names with running numbers of six digits in the order of the groups. Numbers come from one sort by ranges."""
    each = in_order(groups.select(group).where(F.col(group).isNotNull()).distinct(), [group], Workspace(groups.sparkSession, "names"))
    return each.select(group, F.format_string(f"{prefix}_%06d", F.col("place") + 1).alias("name"))


def export_ids(rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """Rows with ``export_id``: a safe form of the id, later occurrences with a number of at least three digits behind it."""
    safe = safe_token(id_col)
    w = Window.partitionBy("_safe").orderBy(order)
    out = rows.withColumn("_safe", safe).withColumn("_n", F.row_number().over(w))
    return out.withColumn("export_id", F.when(F.col("_n") == 1, F.col("_safe")).otherwise(F.format_string("%s_%03d", "_safe", "_n"))).drop("_safe", "_n")


def anonymised(rows: DataFrame) -> DataFrame:
    """Rows with hashed sample and identity, and without paths, sources, speakers and raw texts."""
    gone = [c for c in ("image_path", "reference_image_path", "audio_path", "audio_feature_path", "raw_text", "raw_label", "speaker_id", "dataset_source", "source_dataset", "dataset_sources") if c in rows.columns]
    return rows.withColumn("sample_id", anonymous_id("sample_id", "sample_")).withColumn("identity_id", anonymous_id("identity_id", "id_")).drop(*gone)


def diverse_subset(rows: DataFrame, group: str, by: str, score: str, id_col: str, limit: int = 5) -> DataFrame:
    """Up to ``limit`` rows of each group: the best of every class first (classes by name), then the best of the rest; ``place`` is the order taken."""
    first = Window.partitionBy(group, by).orderBy(F.desc(score), id_col)
    r = rows.withColumn("_c", F.row_number().over(first))
    order = Window.partitionBy(group).orderBy((F.col("_c") > 1).cast("int"), F.when(F.col("_c") == 1, F.col(by)), F.desc(score), id_col)
    return r.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("_c")


def coverage(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(flag, n, share) over all rows."""
    agg = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(k) for k, c in flags.items()])
    return agg.select("_n", F.explode(F.array(*[F.struct(F.lit(k).alias("flag"), F.col(k).alias("n")) for k in flags])).alias("x")).select(
        "x.flag", "x.n", F.round(F.try_divide(F.col("x.n"), F.col("_n")), 6).alias("share"))


def checks(rows: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """(check, n, status): structure of an export - ids missing or repeated, splits unknown, rows without any modality."""
    dup = rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("n"))
    one = rows.agg(
        F.count_if(F.coalesce(id_col, F.lit("")) == "").alias("missing_ids"),
        F.count_if(~F.coalesce(F.col("split").isin("train", "val", "test"), F.lit(False))).alias("unknown_splits"),
        F.count_if(~(F.col("has_image") | F.col("has_audio") | F.col("has_text"))).alias("no_modality"))
    long = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n")) for k in ("missing_ids", "unknown_splits", "no_modality")])).alias("x")).select("x.check", "x.n")
    out = long.unionByName(dup.select(F.lit("repeated_ids").alias("check"), "n"))
    return out.withColumn("status", F.when(F.col("n") > 0, "FAIL").otherwise("PASS"))


def synthesised_path(root: str, folder: str, split, emotion, sample_id, suffix: str = "") -> Column:
    """root/folder/split/emotion/sample_id+suffix."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.lit(folder), c(split), c(emotion), F.concat(c(sample_id), F.lit(suffix)))


def path_or_placeholder(path, prefix: str, row) -> Column:
    """The path, or ``prefix::row`` where it is missing."""
    from tesserae.functions.text import is_missing

    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(is_missing(c(path)), F.concat(F.lit(f"{prefix}::"), c(row).cast("string"))).otherwise(c(path))


def modality_letters(image="has_image", audio="has_audio", text="has_text") -> Column:
    """I, A and T where a modality is there, an underscore where not."""
    return F.concat(*[F.when(F.coalesce(F.col(c), F.lit(False)), letter).otherwise("_") for c, letter in ((image, "I"), (audio, "A"), (text, "T"))])


def bundle(spark, folder: str, name: str, facts: dict) -> dict:
    """Manifest of a benchmark folder: every file with size and SHA-256, read in parallel, and a short card in Markdown.

    One row per file comes to the driver; contents stay on the executors.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = files.select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path").collect()
    prefix = folder.rstrip("/") + "/"
    listed = [{"path": r.path.split(prefix, 1)[-1], "bytes": r.length, "sha256": r.sha256} for r in rows]
    card = "\n".join([f"# {name}", "", *[f"- {k}: {v}" for k, v in sorted(facts.items())], "", "| file | bytes |", "| --- | --- |", *[f"| {x['path']} | {x['bytes']} |" for x in listed]])
    return {"name": name, "facts": facts, "files": listed, "card": card}
