"""Keys and contents that stand in more than one split, and what to do about them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import vectors as V
from tesserae.functions.labels import SPLITS
from tesserae.functions.text import token_line
from tesserae.functions.hashing import text_digest
from tesserae.operators import blocking
from tesserae.workspace import Workspace

PRIORITY = {"train": 0, "val": 1, "test": 2}


def priority(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))]), c), F.lit(99))


def leaking_keys(rows: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """(key..., n_rows, n_splits, splits, sources): keys whose rows stand in two splits or more. Null keys and splits do not count.

    Only the bounded sets of splits and sources are collected, never the rows of a key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    have = rows.where(F.col("split").isNotNull())
    for k in keys:
        have = have.where(F.col(k).isNotNull())
    out = have.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.collect_set("split").alias("s"), F.collect_set("dataset_source").alias("d"))
    return out.where(F.size("s") > 1).select(
        *keys, "n_rows", F.size("s").alias("n_splits"), F.array_join(F.array_sort("s"), ",").alias("splits"), F.array_join(F.array_sort("d"), ",").alias("sources"))


def affected(rows: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """(check, n_keys, n_rows, percent) per named check: leaking keys, their rows, and their share of all rows (4 decimals, 0 for none)."""
    total = rows.count()
    out = None
    for name, key in keys.items():
        one = leaking_keys(rows, key).agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
        one = one.select(F.lit(name).alias("check"), "n_keys", "n_rows", F.bround(100.0 * F.col("n_rows") / F.lit(max(total, 1)), 4).alias("percent"))
        out = one if out is None else out.unionByName(one)
    return out


def content_keys(samples: DataFrame) -> DataFrame:
    """Samples with the keys of their contents: paths of image, reference image and audio, the text's digest, and key-emotion pairs."""
    return samples.withColumn("text_key", text_digest("text"))


def cross_modal(samples: DataFrame) -> DataFrame:
    """(kind, key, emotion, n_rows, splits): identity, speaker, text or audio with one emotion in two splits or more."""
    kinds = {"identity": "identity_id", "speaker": "speaker_id", "text": "text_key", "audio": "audio_path"}
    long = samples.select("split", "dataset_source", F.col("unified_emotion").alias("emotion"), F.explode(F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in kinds.items()])).alias("x")).select("split", "dataset_source", "emotion", "x.kind", "x.key")
    return leaking_keys(long, ["kind", "key", "emotion"]).select("kind", "key", "emotion", "n_rows", "splits")


def image_duplicates(samples: DataFrame) -> DataFrame:
    """(path, n_rows, splits, sources): images that stand in two splits or more in either image field."""
    both = samples.select("split", "dataset_source", F.explode(F.array("image_path", "reference_image_path")).alias("path"))
    return leaking_keys(both, "path").select("path", "n_rows", "splits", "sources")


def cross_dataset(rows: DataFrame, key: str) -> DataFrame:
    """(source_a, source_b, n_keys): for each two sources, how many contents they share."""
    per = rows.where(F.col(key).isNotNull() & F.col("dataset_source").isNotNull()).select(key, "dataset_source").distinct()
    a, b = per.select(key, F.col("dataset_source").alias("source_a")), per.select(key, F.col("dataset_source").alias("source_b"))
    return a.join(b, key).where("source_a < source_b").groupBy("source_a", "source_b").agg(F.count(F.lit(1)).alias("n_keys"))


def near_matches(samples: DataFrame, id_col: str = "record_id", hash_bits: int = 4, image: float = 0.98, audio: float = 0.985, text: float = 0.96, ratio: float = 0.97) -> DataFrame:
    """(kind, left_id, right_id): pairs of rows in two splits with near-same images, near-same audio or texts that almost agree.

    Images of one hash prefix match by ``image_hash`` or ``image_vector``, audio of one sign signature by ``audio_vector``,
    for samples that have these columns. Texts (``content_keys``) match within ``blocking.text_block``; those whose exact text leaks are left out.
    """
    take = lambda pairs, kind: pairs.select(F.lit(kind).alias("kind"), "left_id", "right_id")
    ws = Workspace(samples.sparkSession, "near")
    exact = leaking_keys(samples, "text_key").select("text_key")
    rows = samples.where(F.col("split").isNotNull()).join(exact, "text_key", "left_anti").where(F.col("text_key").isNotNull())
    rows = rows.select(F.col(id_col).alias("_id"), "text_key", F.col("unified_emotion").alias("_e"), "split", token_line("text").alias("line"))
    # the copies of a text that does not leak stand in one split, so texts are compared once, whatever the number of their copies
    texts = ws.write(rows.groupBy("text_key", "_e").agg(F.min("_id").alias("class_id"), F.first("split").alias("split"), F.first("line").alias("line")), "texts")
    blocks = texts.select("class_id", "line", "split", *blocking.text_block("line", "_e")).withColumn("token2", F.coalesce("token2", F.lit("")))
    pairs = ws.write(blocking.close_lines(blocks, ["token1", "token2", "band", "emotion"], "class_id", "line", text, ratio, different="split", both=True, unit=True), "pairs")
    for side in ("left", "right"):
        pairs = pairs.join(texts.select(F.col("class_id").alias(f"{side}_id"), "text_key", "_e"), f"{side}_id").drop(f"{side}_id").join(
            rows.select(F.col("_id").alias(side), "text_key", "_e"), ["text_key", "_e"]).drop("text_key", "_e")
    # the ratio is that of the row of the smaller id against the other
    pairs = pairs.where(((F.col("left") < F.col("right")) & F.col("there")) | ((F.col("left") > F.col("right")) & F.col("back")))
    out = take(pairs.select(F.least("left", "right").alias("left_id"), F.greatest("left", "right").alias("right_id")), "text_near")
    if "image_hash" in samples.columns:
        have = samples.where(F.col("image_hash").isNotNull()).withColumn("_p", F.substring("image_hash", 1, 6))
        vector = ["image_vector"] if "image_vector" in samples.columns else []
        close = lambda a, b: F.coalesce(V.hamming(a("image_hash"), b("image_hash")) <= hash_bits, F.lit(False)) | (
            F.coalesce(V.cosine_unit(a("image_vector"), b("image_vector")) >= image, F.lit(False)) if vector else F.lit(False))
        out = out.unionByName(take(blocking.blocked_pairs(have, ["_p"], id_col, ["image_hash", *vector], close, different=["split"]), "image_near"))
    if "audio_vector" in samples.columns:
        have = samples.where(F.col("audio_vector").isNotNull()).withColumn("_p", V.sign_code("audio_vector"))
        out = out.unionByName(take(blocking.blocked_pairs(have, ["_p"], id_col, ["audio_vector"], lambda a, b: V.cosine_unit(a("audio_vector"), b("audio_vector")) >= audio, different=["split"]), "audio_near"))
    return out


def match_summary(samples: DataFrame, matches: DataFrame) -> DataFrame:
    """(check, n_keys, n_rows, percent) of near matches per kind: pairs, rows in them, and their share of all rows."""
    total = samples.count()
    one = matches.select("kind", F.explode(F.array("left_id", "right_id")).alias("id")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_rows"))
    return one.select(F.col("kind").alias("check"), (F.col("n") / 2).cast("long").alias("n_keys"), "n_rows", F.bround(100.0 * F.col("n_rows") / F.lit(max(total, 1)), 4).alias("percent"))


def cross_dataset_matches(samples: DataFrame, matches: DataFrame, id_col: str = "record_id") -> DataFrame:
    """(source_a, source_b, n_pairs): distinct pairs of rows of two sources that match nearly, or whose exact text leaks across splits."""
    names = ("source_a", "source_b")
    ordered = lambda a, b: [F.least(a, b).alias(names[0]), F.greatest(a, b).alias(names[1])]
    side = lambda s: samples.select(F.col(id_col).alias(f"{s}_id"), F.col("dataset_source").alias(f"{s}_source"), F.col("text_key").alias(f"{s}_key"))
    leaks = leaking_keys(samples, "text_key").select("text_key")
    # rows of one leaking text pair by the numbers of its rows in every source, so that many copies make no pairs of rows
    per = samples.where(F.col("dataset_source").isNotNull()).join(leaks, "text_key", "left_semi").groupBy("text_key", "dataset_source").agg(F.count(F.lit(1)).alias("n"))
    per = Workspace(samples.sparkSession, "sources").write(per, "per")
    same = per.select("text_key", F.col("dataset_source").alias(names[0]), F.col("n").alias("m")).join(
        per.select("text_key", F.col("dataset_source").alias(names[1]), "n"), "text_key").where("source_a < source_b").select(*names, (F.col("m") * F.col("n")).alias("k"))
    # near matches of other kinds may be of one leaking text as well
    near = matches.select("left_id", "right_id").distinct().join(side("left"), "left_id").join(side("right"), "right_id").where("left_source <> right_source")
    near = near.join(leaks.select(F.col("text_key").alias("left_key"), F.lit(True).alias("_leaks")), "left_key", "left")
    near = near.where(~(F.coalesce("_leaks", F.lit(False)) & F.coalesce(F.col("left_key") == F.col("right_key"), F.lit(False))))
    both = same.unionByName(near.select(*ordered("left_source", "right_source"), F.lit(1).cast("long").alias("k")))
    return both.groupBy(*names).agg(F.sum("k").alias("n_pairs"))


#: The checks by name, and what else runs with one: the cross-modal check with that of speakers, the cross-data-set one with duplicates.
CHECKS = ("identity", "speaker", "duplicates")
IMPLIED = {"speaker": ("cross_modal",), "duplicates": ("cross_dataset",)}


def selected_checks(**wanted: bool) -> list[str]:
    """The checks that run: those switched on (all if none is named), followed by what they imply."""
    unknown = set(wanted) - set(CHECKS)
    if unknown:
        raise ValueError(f"no such check: {', '.join(sorted(unknown))}")
    on = [c for c in CHECKS if wanted.get(c, not any(wanted.values()))]
    return on + [x for c in on for x in IMPLIED.get(c, ())]


def combined_share(explicit: DataFrame, fallback: DataFrame) -> DataFrame:
    """(n_rows, percent): the larger of the shares that two ways of finding a leak report, each one row (n_rows, percent)."""
    both = explicit.select("n_rows", "percent").unionByName(fallback.select("n_rows", "percent"))
    return both.agg(F.max("n_rows").alias("n_rows"), F.max("percent").alias("percent"))


def severity(percent, count, major=(1.0, 10), minor=(0.1, 1)) -> Column:
    """FAIL, WARNING or PASS by the share in percent or the number."""
    return F.when((percent >= major[0]) | (count >= major[1]), "FAIL").when((percent >= minor[0]) | (count >= minor[1]), "WARNING").otherwise("PASS")


def majority_split(rows: DataFrame, key: str) -> DataFrame:
    """(key, target_split, n_rows): the split most rows of a key stand in; ties go to train, then val, then test."""
    n = rows.where(F.col(key).isNotNull() & F.col("split").isNotNull()).groupBy(key, "split").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(
        F.max_by("split", F.struct(F.col("n"), -priority("split"))).alias("target_split"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_splits"))


def remediation(samples: DataFrame, keys: Sequence[str] = ("identity_id", "speaker_id"), id_col: str = "record_id") -> DataFrame:
    """(id, from_split, to_split, n_reasons): moves that bring every leaking key into its majority split.

    A row that two keys would move goes to the split of higher priority; its reasons are counted. Rows that stay are not listed.
    """
    moves = None
    for k in keys:
        # written: a heavy key's rows can be split over tasks where both sides of the join are shuffled
        target = Workspace(samples.sparkSession, "moves").write(majority_split(samples, k).where("n_splits > 1").select(k, "target_split"), "target")
        m = samples.where(F.col("split").isNotNull() & F.col(k).isNotNull()).join(target, k).where("split <> target_split").select(
            F.col(id_col).alias("id"), F.col("split").alias("from_split"), F.col("target_split").alias("to_split"), F.concat(F.lit(f"{k}:"), F.col(k)).alias("reason"))
        moves = m if moves is None else moves.unionByName(m)
    return moves.groupBy("id").agg(
        F.first("from_split").alias("from_split"), F.min_by("to_split", priority("to_split")).alias("to_split"), F.countDistinct("reason").alias("n_reasons"))


def apply_moves(samples: DataFrame, moves: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Samples with their split replaced by the move's, and ``remediated``."""
    m = moves.select(F.col("id").alias(id_col), "to_split")
    return samples.join(m, id_col, "left").withColumn("remediated", F.col("to_split").isNotNull()).withColumn("split", F.coalesce("to_split", "split")).drop("to_split")


def split_counts(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("split").isin(*SPLITS)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def representatives(rows: DataFrame, bucket: str, id_col: str) -> DataFrame:
    """(bucket, representative, n_rows): the first row of each bucket by split, then id."""
    return rows.where(F.col(bucket).isNotNull()).groupBy(bucket).agg(
        F.min(F.struct(F.coalesce("split", F.lit("~")), F.col(id_col).alias("id"))).alias("x"), F.count(F.lit(1)).alias("n_rows")
    ).select(bucket, F.col("x.id").alias("representative"), "n_rows")


def window_share(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, share) with the share of all rows."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))
