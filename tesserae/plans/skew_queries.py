"""Per-key results over keys of which a few hold most rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.labels import emotion_of, split_of
from tesserae.functions.text import key_of, squeeze
from tesserae.operators.eager import eager_join, key_profile
from tesserae.plans.catalog import query, table
from tesserae.plans.sqltext import EMOTION as SQL_EMOTION
from tesserae.plans.sqltext import SPLIT as SQL_SPLIT
from tesserae.plans.sqltext import key as sql_key
from tesserae.plans.sqltext import trim as sql_trim

_PROFILE = """WITH r AS (SELECT {key} AS k, {split} AS split, source_dataset, {emotion} AS emotion FROM normalized_records)
SELECT k AS {name}, count(*) AS n_rows,
 count(*) FILTER (split='train') AS n_train, count(*) FILTER (split='val') AS n_val, count(*) FILTER (split='test') AS n_test,
 count(DISTINCT split) AS n_splits, coalesce(array_to_string(list_sort(list(DISTINCT split) FILTER (split IS NOT NULL)),','),'') AS splits,
 count(DISTINCT source_dataset) AS n_sources, coalesce(array_to_string(list_sort(list(DISTINCT source_dataset) FILTER (source_dataset IS NOT NULL)),','),'') AS sources,
 count(DISTINCT emotion) AS n_emotions, coalesce(array_to_string(list_sort(list(DISTINCT emotion) FILTER (emotion IS NOT NULL)),','),'') AS emotions
FROM r WHERE k IS NOT NULL GROUP BY k"""


def _profile(spark, sf_dir, name, key):
    r = table(spark, sf_dir, "normalized_records").select(
        key.alias(name), split_of("split").alias("split"), "source_dataset", emotion_of("unified_emotion").alias("emotion")
    )
    return key_profile(
        r, name,
        sets={"splits": F.col("split"), "sources": F.col("source_dataset"), "emotions": F.col("emotion")},
        counts={f"n_{s}": F.col("split") == s for s in ("train", "val", "test")},
    )


@query("p4_identity_media", f"""WITH r AS (SELECT {sql_trim('audio_path')} AS k, {sql_key('identity_id')} AS identity_id FROM normalized_records),
 a AS (SELECT {sql_trim('audio_path')} AS k, CAST(round(duration_sec*1000) AS BIGINT) AS ms FROM audio_features)
SELECT identity_id, CAST(count(*) AS BIGINT) AS n_pairs, CAST(sum(ms) AS BIGINT) AS sum_ms FROM r JOIN a ON r.k=a.k WHERE r.k<>'' AND identity_id IS NOT NULL GROUP BY identity_id""")
def p4_identity_media(spark, sf_dir):
    """Audio features that each identity's records meet by audio path: both sides have keys that hold a tenth of all rows."""
    k = squeeze("audio_path")
    r = table(spark, sf_dir, "normalized_records").select(F.when(k != "", k).alias("k"), key_of("identity_id").alias("identity_id")).where("identity_id IS NOT NULL")
    a = table(spark, sf_dir, "audio_features").select(F.when(k != "", k).alias("k"), F.round(F.col("duration_sec") * 1000).cast("long").alias("ms"))
    return eager_join(r, a, "k", ["identity_id"], right_sums=["ms"])


@query("p4_audio_join", f"""WITH r AS (SELECT {sql_trim('audio_path')} AS k, source_dataset AS record_source, {SQL_SPLIT} AS split FROM normalized_records),
 a AS (SELECT {sql_trim('audio_path')} AS k, sample_rate, CAST(round(duration_sec*1000) AS BIGINT) AS ms FROM audio_features)
SELECT record_source, split, sample_rate, CAST(count(*) AS BIGINT) AS n_pairs, CAST(sum(ms) AS BIGINT) AS sum_ms
FROM r JOIN a ON r.k=a.k WHERE r.k<>'' GROUP BY record_source, split, sample_rate""")
def p4_audio_join(spark, sf_dir):
    """Records joined to audio features by audio path, rolled up: the stock clips alone would make billions of joined rows."""
    k = squeeze("audio_path")
    r = table(spark, sf_dir, "normalized_records").select(
        F.when(k != "", k).alias("k"), F.col("source_dataset").alias("record_source"), split_of("split").alias("split")
    )
    a = table(spark, sf_dir, "audio_features").select(
        F.when(k != "", k).alias("k"), "sample_rate", F.round(F.col("duration_sec") * 1000).cast("long").alias("ms")
    )
    return eager_join(r, a, "k", ["record_source", "split"], ["sample_rate"], right_sums=["ms"])


@query("p4_identity_profile", _PROFILE.format(key=sql_key("identity_id"), split=SQL_SPLIT, emotion=SQL_EMOTION, name="identity_id"))
def p4_identity_profile(spark, sf_dir):
    """Rows, splits, sources and emotions per identity."""
    return _profile(spark, sf_dir, "identity_id", key_of("identity_id"))


@query("p4_audio_profile", _PROFILE.format(
    key=f"CASE WHEN {sql_trim('audio_path')}<>'' THEN {sql_trim('audio_path')} END", split=SQL_SPLIT, emotion=SQL_EMOTION, name="audio_path"))
def p4_audio_profile(spark, sf_dir):
    """Rows, splits, sources and emotions per audio path."""
    p = squeeze("audio_path")
    return _profile(spark, sf_dir, "audio_path", F.when(p != "", p))
