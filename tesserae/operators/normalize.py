"""Records to the declared form, and the text manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.hashing import digest_mod
from tesserae.functions.labels import emotion_of, harmonised_emotion, split_of
from tesserae.functions.text import clean_text, conditioning_text, key_of, squeeze

#: The columns of a normalised record, in order.
COLUMNS = (
    "source_dataset", "sample_id", "split", "image_path", "reference_image_path", "audio_path", "audio_feature_path", "text",
    "raw_text", "raw_label", "unified_emotion", "identity_id", "speaker_id", "valence", "arousal",
)
TEMPLATES = {e: (f"A portrait with a {e} expression.", f"A person who looks {e}.", f"The face seems {e}.") for e in
             ("neutral", "happy", "sad", "angry", "fearful", "surprised", "disgusted", "contemptuous")}


def blank_to_null(c) -> Column:
    t = squeeze(c)
    return F.when(t != "", t)


def samples(records: DataFrame) -> DataFrame:
    """Records as the curation operators read them.

    Keys lose padding and null tokens, the split its spellings, the emotion case and padding ("unknown" if it is none);
    blank paths and texts become null; modality flags are derived, a reference image counting as an image.
    """
    cols = [c for c in ("record_id", "ingested_at") if c in records.columns]
    image, ref, audio, text = (blank_to_null(c) for c in ("image_path", "reference_image_path", "audio_path", "text"))
    return records.select(
        *cols, squeeze("sample_id").alias("sample_id"), F.col("source_dataset").alias("dataset_source"), split_of("split").alias("split"),
        image.alias("image_path"), ref.alias("reference_image_path"), audio.alias("audio_path"), text.alias("text"), "raw_text", "raw_label",
        F.coalesce(emotion_of("unified_emotion"), F.lit("unknown")).alias("unified_emotion"), key_of("identity_id").alias("identity_id"),
        key_of("speaker_id").alias("speaker_id"), "valence", "arousal",
        (image.isNotNull() | ref.isNotNull()).alias("has_image"), audio.isNotNull().alias("has_audio"), text.isNotNull().alias("has_text"),
        ref.isNotNull().alias("has_reference"),
    )


def joined_source(*sources: str) -> Column:
    """The distinct non-null sources in order, joined by a plus sign; null where there is none."""
    have = F.array_sort(F.array_distinct(F.array_compact(F.array(*sources))))
    return F.when(F.size(have) > 0, F.array_join(have, "+"))


def template_of(emotion: Column, sample_id: Column, templates: Mapping[str, Sequence[str]] = TEMPLATES) -> Column:
    """The template that the digest of ``emotion:sample_id`` picks; an emotion without templates takes those of neutral."""
    table = F.create_map(*[x for k, v in templates.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    fallback = F.array(F.concat(F.lit("A portrait with a "), emotion, F.lit(" expression.")))
    choices = F.coalesce(F.try_element_at(table, emotion), F.try_element_at(table, F.lit("neutral")), fallback)
    return F.element_at(choices, (digest_mod(F.concat_ws(":", emotion, sample_id), F.size(choices)) + 1).cast("int"))


def text_manifest(records: DataFrame, mode: str = "emotion_template_hybrid", templates: Mapping[str, Sequence[str]] = TEMPLATES) -> DataFrame:
    """One row per record with its harmonised emotion, plain and conditioning text, and where the latter came from."""
    r = records.withColumn("_emotion", harmonised_emotion("source_dataset", "raw_label", "valence", "arousal", "unified_emotion"))
    raw = F.coalesce(F.when(F.col("text") != "", F.col("text")), F.col("raw_text"))
    r = r.withColumn("_clean", clean_text(raw)).withColumn("_template", template_of(F.col("_emotion"), F.col("sample_id"), templates))
    text, origin = conditioning_text("_clean", "_emotion", "_template", mode)
    extra = [c for c in ("record_id",) if c in records.columns]
    return r.select(
        *extra, "source_dataset", "sample_id", "split", "image_path", "audio_path", "identity_id", "speaker_id", "raw_label",
        F.col("unified_emotion").alias("original_unified_emotion"), F.col("_emotion").alias("unified_emotion"),
        F.coalesce("_clean", "_template").alias("text"), text.alias("conditioning_text"), clean_text("raw_text").alias("raw_text"),
        origin.alias("text_origin"), "valence", "arousal",
    )


def with_latest_text(records: DataFrame, manifest: DataFrame, ordinal: str) -> DataFrame:
    """Records left-joined to the last manifest row (by ``ordinal``) of their sample_id; their own values where there is none."""
    last = Window.partitionBy("sample_id").orderBy(F.desc(ordinal))
    one = manifest.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(
        "sample_id", F.col("conditioning_text").alias("_text"), F.col("unified_emotion").alias("_emotion"))
    out = records.join(one, "sample_id", "left")
    return out.withColumn("text", F.coalesce("_text", "text")).withColumn("unified_emotion", F.coalesce("_emotion", "unified_emotion")).drop("_text", "_emotion")


def rejects(records: DataFrame) -> DataFrame:
    """Rows that break the schema, with the reason: no sample_id, no category of the taxonomy, or no modality at all."""
    reason = (
        F.when(F.coalesce(squeeze("sample_id"), F.lit("")) == "", "missing_sample_id")
        .when(emotion_of("unified_emotion").isNull(), "unknown_emotion")
        .when(F.coalesce(blank_to_null("image_path"), blank_to_null("audio_path"), blank_to_null("text")).isNull(), "no_modality")
    )
    return records.withColumn("reason", reason).where("reason IS NOT NULL")


# --- parsers of corpora whose file names or lines carry the fields ------------------------------------------------

def parse_underscored(path) -> list[Column]:
    """speaker, sentence, emotion, intensity from a file name of four fields joined by underscores; others give nulls."""
    from tesserae.functions.text import file_stem

    f = F.split(file_stem(path), "_")
    return [F.when(F.size(f) == 4, F.get(f, i)).alias(n) for i, n in enumerate(("speaker", "sentence", "emotion_code", "intensity"))]


def parse_hyphenated(path) -> list[Column]:
    """The seven fields of a file name joined by hyphens and the actor's key; others give nulls."""
    from tesserae.functions.text import file_stem

    f = F.split(file_stem(path), "-")
    names = ("modality", "channel", "emotion_code", "intensity", "statement", "repetition", "actor")
    cols = [F.when(F.size(f) == 7, F.get(f, i)).alias(n) for i, n in enumerate(names)]
    return [*cols, F.when(F.size(f) == 7, F.concat(F.lit("actor_"), F.get(f, 6))).alias("identity_id")]


DIALOGUE_LINE = r"^\[\s*([0-9.]+)\s*-\s*([0-9.]+)\s*\]\s+(\S+)\s+(\w+)\s+\[\s*([0-9.]+)\s*,\s*([0-9.]+)\s*,\s*([0-9.]+)\s*\]"


def parse_dialogue(lines: DataFrame, line: str = "value") -> DataFrame:
    """start, end, turn, label, valence, activation, dominance, speaker from evaluation lines; other lines and label xxx drop out."""
    g = lambda i: F.regexp_extract(line, DIALOGUE_LINE, i)
    out = lines.where(F.col(line).rlike(DIALOGUE_LINE)).select(
        g(1).cast("double").alias("start"), g(2).cast("double").alias("end"), g(3).alias("turn"), g(4).alias("label"),
        g(5).cast("double").alias("valence"), g(6).cast("double").alias("activation"), g(7).cast("double").alias("dominance"))
    last = F.element_at(F.split("turn", "_"), -1)
    return out.where("label <> 'xxx'").withColumn("speaker", F.concat(F.element_at(F.split("turn", "_"), 1), F.lit("_"), F.substring(last, 1, 1)))


TIMED_LINE = r"(?s)^\[\s*([0-9]+\.[0-9]+)\s*-\s*([0-9]+\.[0-9]+)\s*\]\s*(.*)$"


def timed_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, start, end, utterance) of the lines of transcripts that begin with a time range."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).where(F.col("line").rlike(TIMED_LINE))
    g = lambda i: F.regexp_extract("line", TIMED_LINE, i)
    return rows.select("doc_id", "line_no", g(1).cast("double").alias("start"), g(2).cast("double").alias("end"), g(3).alias("utterance"))
