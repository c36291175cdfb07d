"""Readers of corpora whose labels, transcripts and media stand in separate files.

Each takes frames (label rows, lines, a listing of media files as ``media.listing`` gives it), so tables and folders serve
alike, and returns records. Media are found by a join with the listing: a row whose file is not there is left out and can be
counted with ``unresolved``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.labels import CORPUS_CODES, corpus_label, emotion_from_affect, split_of
from tesserae.functions.text import file_stem
from tesserae.operators.normalize import parse_dialogue

RECORD = (
    "source_dataset string, sample_id string, split string, image_path string, audio_path string, text string, raw_text string, raw_label string, "
    "unified_emotion string, identity_id string, speaker_id string, valence double, arousal double")
_FIELDS = [f.strip().split(" ") for f in RECORD.split(",")]


def as_records(df: DataFrame) -> DataFrame:
    """The columns of RECORD in order; those the frame does not have are null."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in _FIELDS])


def first_found(rows: DataFrame, candidates: Sequence[tuple[Column, str | None]], files: DataFrame, root: str) -> DataFrame:
    """``rows`` with ``found`` (the first candidate path below ``root`` that is listed, null if none) and ``found_split`` (its split).

    All candidates of a row are looked up in one join with the listing; the least place wins.
    """
    below = files.select(F.regexp_replace("path", r"^file:/+", "/").alias("_have")).distinct()
    ranked = F.array(*[F.struct(F.lit(i).alias("place"), F.concat(F.lit(f"{root.rstrip('/')}/"), p).alias("path"), F.lit(s).cast("string").alias("split")) for i, (p, s) in enumerate(candidates)])
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    hits = keyed.select("_row", F.explode(ranked).alias("c")).join(below, F.col("c.path") == F.col("_have")).groupBy("_row").agg(F.min("c").alias("c"))
    return keyed.join(hits, "_row", "left").withColumn("found", F.col("c.path")).withColumn("found_split", F.col("c.split")).drop("_row", "c")


def unresolved(rows: DataFrame) -> int:
    """How many rows of ``first_found`` have no file."""
    return rows.where("found IS NULL").count()


def folder_labelled(labels: DataFrame, files: DataFrame, root: str, corpus: str = "affectnet") -> DataFrame:
    """Records of a label table (pth, label) whose images stand at the path itself or below Train or Test, which then is the split."""
    rows = first_found(labels, [(F.col("pth"), None), (F.concat(F.lit("Train/"), F.col("pth")), "train"), (F.concat(F.lit("Test/"), F.col("pth")), "test")], files, root)
    return as_records(rows.where("found IS NOT NULL").select(
        F.lit(corpus).alias("source_dataset"), file_stem("found").alias("sample_id"), F.col("found_split").alias("split"), F.col("found").alias("image_path"),
        F.col("label").alias("raw_label"), corpus_label(F.lit(corpus), "label").alias("unified_emotion")))


def split_labelled(train: DataFrame, test: DataFrame, files: DataFrame, root: str, corpus: str = "rafdb") -> DataFrame:
    """Records of two label tables (image, label), one per split, whose images stand below DATASET by split and label, by split, or neither, or at the root."""
    rows = train.select("image", "label", F.lit("train").alias("split")).unionByName(test.select("image", "label", F.lit("test").alias("split")))
    j = lambda *parts: (F.concat_ws("/", *[F.lit(p) if p == "DATASET" else F.col(p).cast("string") for p in parts]), None)
    rows = first_found(rows, [j("DATASET", "split", "label", "image"), j("DATASET", "split", "image"), j("DATASET", "image"), j("image")], files, root)
    return as_records(rows.where("found IS NOT NULL").select(
        F.lit(corpus).alias("source_dataset"), file_stem("image").alias("sample_id"), "split", F.col("found").alias("image_path"),
        F.col("label").cast("string").alias("raw_label"), corpus_label(F.lit(corpus), F.col("label").cast("string")).alias("unified_emotion")))


TRANSCRIPT_LINE = r"^(\S+)\s+\[[^\]]+\]:\s*(.*)$"


def transcripts(lines: DataFrame, line: str = "value") -> DataFrame:
    """(turn, text) of transcript lines; the last line of a turn holds where ``place`` orders them, else any."""
    t = F.trim(F.col(line))
    out = lines.where(t.rlike(TRANSCRIPT_LINE)).select(F.regexp_extract(t, TRANSCRIPT_LINE, 1).alias("turn"), F.regexp_extract(t, TRANSCRIPT_LINE, 2).alias("text"), *([F.col("place")] if "place" in lines.columns else []))
    pick = F.max_by("text", "place") if "place" in lines.columns else F.max("text")
    return out.groupBy("turn").agg(pick.alias("text"))


def dialogues(evaluations: DataFrame, texts: DataFrame, sounds: DataFrame, session: str, corpus: str = "iemocap") -> DataFrame:
    """Records of evaluation lines (value) with their transcript (turn, text) and sound file, which is named by the turn.

    Lines of another form, labels that have no category and turns without a sound drop out; a turn without a transcript has no
    text. The speaker is the session and the first letter of the turn's last part.
    """
    turns = parse_dialogue(evaluations.select(F.trim("value").alias("value"))).withColumn("label", F.lower("label")).where("label <> 'xxx'")
    turns = turns.where(F.col("label").isin(*CORPUS_CODES[corpus]))
    sound = sounds.select(file_stem("path").alias("turn"), F.regexp_replace("path", r"^file:/+", "/").alias("audio_path")).groupBy("turn").agg(F.min("audio_path").alias("audio_path"))
    speaker = F.concat(F.lit(f"{session}_"), F.substring(F.element_at(F.split("turn", "_"), -1), 1, 1))
    rows = turns.join(sound, "turn").join(texts, "turn", "left")
    return as_records(rows.select(
        F.lit(corpus).alias("source_dataset"), F.col("turn").alias("sample_id"), "audio_path", "text", F.col("text").alias("raw_text"), F.col("label").alias("raw_label"),
        corpus_label(F.lit(corpus), "label").alias("unified_emotion"), speaker.alias("identity_id"), speaker.alias("speaker_id"), "valence", F.col("activation").alias("arousal")))


def affect_rated(rows: DataFrame, corpus: str = "emobank") -> DataFrame:
    """Records of a table (id, split, V, A, text): the category follows from valence and arousal, the split from its code."""
    v, a = F.col("V").cast("double"), F.col("A").cast("double")
    return as_records(rows.select(
        F.lit(corpus).alias("source_dataset"), F.col("id").cast("string").alias("sample_id"), split_of("split").alias("split"), F.trim("text").alias("text"), F.col("text").alias("raw_text"),
        F.lit("vad_heuristic").alias("raw_label"), emotion_from_affect(v, a).alias("unified_emotion"), v.alias("valence"), a.alias("arousal")))


def no_records(spark: SparkSession) -> DataFrame:
    """The records of a source of which only metadata is there: none."""
    return spark.createDataFrame([], RECORD)
