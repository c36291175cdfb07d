"""Records that differ only in how their texts are written, collapsed into one each.

The canonical key of a row is a 256-bit digest of its compared columns, the words of ``text`` and the sorted fields of
``raw_text``. Keys of more than ``hot_rows`` rows are found exactly from partial counts; their rows are salted and
aggregated in two levels. All other keys go by one shuffle. The representative of a key is its least identifier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import word_line
from tesserae.operators.skew import HEAVY_LIMIT, HEAVY_ROWS, salted
from tesserae.workspace import Workspace

SALTS = 64
#: Not compared: identifiers, arrival, and the two texts, which have rules of their own.
NOT_COMPARED = ("record_id", "sample_id", "ingested_at", "text", "raw_text")


def fields_of(c) -> Column:
    """The fields of a free text in sorted order: parted by ``;``, ``|`` or a line break, each as its words."""
    parts = F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"[;|\r\n\x0b\x0c\x85\u2028\u2029]")
    return F.array_sort(F.array_compact(F.transform(parts, lambda p: F.nullif(word_line(p), F.lit("")))))


def canonical_key(compared: Sequence[str], text: str = "text", fields: str = "raw_text") -> Column:
    """A digest that is equal for rows that are copies. Null is not blank: a null text has no words and equals null only."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("!")) for c in compared]
    parts.append(F.coalesce(F.concat(F.lit("="), word_line(text)), F.lit("!")))
    parts.append(F.when(F.col(fields).isNull(), F.lit("!")).otherwise(F.concat(F.lit("="), F.array_join(fields_of(fields), "\x1e"))))
    return F.unhex(F.sha2(F.concat_ws("\x1f", *parts), 256))


def keyed_records(records: DataFrame, id_col: str = "record_id", not_compared: Sequence[str] = NOT_COMPARED) -> DataFrame:
    """(key, id): extra columns of ``records`` are compared too; rows without an identifier are left out."""
    compared = [c for c in records.columns if c not in not_compared]
    return records.where(F.col(id_col).isNotNull()).select(canonical_key(compared).alias("key"), F.col(id_col).alias("id"))


def collapse(records: DataFrame, id_col: str = "record_id", hot_rows: int = HEAVY_ROWS) -> tuple[DataFrame, DataFrame]:
    """(kept, copies) of ``records``: kept(kept_id, n_copies) has one row per distinct record, n_copies its number of rows;
    copies(kept_id, copy_id) has one row for each row that was collapsed into another.

    Rows are told apart by ``id_col``; a repeated identifier counts as one copy each time but is never a copy of itself.
    An empty table gives two empty tables.
    """
    ws = Workspace(records.sparkSession, "collapse")
    keyed = ws.write(keyed_records(records, id_col), "keyed")
    hot = ws.write(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("key"), "hot")
    n_hot = hot.count()
    if n_hot == 0:
        light, heavy = keyed, None
    elif n_hot > HEAVY_LIMIT:
        light, heavy = keyed.join(hot, "key", "left_anti"), keyed.join(hot, "key", "left_semi")
    else:
        light, heavy = keyed.join(F.broadcast(hot), "key", "left_anti"), keyed.join(F.broadcast(hot), "key", "left_semi")

    one = light.groupBy("key").agg(F.min("id").alias("kept_id"), F.collect_list("id").alias("ids"))
    kept = one.select("kept_id", F.size("ids").cast("long").alias("n_copies"))
    copies = one.where(F.size("ids") > 1).select("kept_id", F.explode("ids").alias("copy_id"))
    if heavy is not None:
        first = heavy.groupBy("key", salted(F.col("id"), SALTS).alias("salt")).agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("n"))
        two = first.groupBy("key").agg(F.min("m").alias("kept_id"), F.sum("n").alias("n_copies"))
        kept = kept.unionByName(two.select("kept_id", "n_copies"))
        reps = two.select("key", "kept_id")
        reps = F.broadcast(reps) if n_hot <= HEAVY_LIMIT else reps
        copies = copies.unionByName(heavy.join(reps, "key").select("kept_id", F.col("id").alias("copy_id")))
    return kept, copies.where(F.col("copy_id") != F.col("kept_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(spark.read.parquet(f"{sf_dir}/normalized_records.parquet"))[1]


def p6_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kept_id, n_copies) of every distinct record."""
    return collapse(spark.read.parquet(f"{sf_dir}/normalized_records.parquet"))[0]
