"""Queries over single records: normalisation, scalar functions, aggregates, windows and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import hashing as H
from tesserae.functions import labels as L
from tesserae.functions import text as T
from tesserae.functions import vectors as V
from tesserae.operators import export as X
from tesserae.operators import leakage, metrics
from tesserae.operators import normalize as N
from tesserae.operators.align import best_per_class
from tesserae.plans import sqltext as S
from tesserae.plans.catalog import query, table


def samples(spark, sf_dir):
    return N.samples(table(spark, sf_dir, "normalized_records"))


@query("q_split_code", f"SELECT record_id, {S.SPLIT} AS split FROM normalized_records")
def q_split_code(spark, sf_dir):
    return table(spark, sf_dir, "normalized_records").select("record_id", L.split_of("split").alias("split"))


@query("q_emotion_harmonised", f"WITH {S.HARMONISED} SELECT record_id, emotion FROM harmonised")
def q_emotion_harmonised(spark, sf_dir):
    r = table(spark, sf_dir, "normalized_records")
    return r.select("record_id", L.harmonised_emotion("source_dataset", "raw_label", "valence", "arousal", "unified_emotion").alias("emotion"))


@query("q_affect_emotion", f"SELECT record_id, {S.AFFECT} AS emotion FROM normalized_records WHERE valence IS NOT NULL AND arousal IS NOT NULL")
def q_affect_emotion(spark, sf_dir):
    r = table(spark, sf_dir, "normalized_records").where("valence IS NOT NULL AND arousal IS NOT NULL")
    return r.select("record_id", L.emotion_from_affect("valence", "arousal").alias("emotion"))


@query("q_rejects", f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce({S.trim('sample_id')}, '') = '' THEN 'missing_sample_id'
 WHEN ({S.EMOTION}) IS NULL THEN 'unknown_emotion'
 WHEN coalesce({S.filled('image_path')}, {S.filled('audio_path')}, {S.filled('text')}) IS NULL THEN 'no_modality' END AS reason FROM normalized_records)
WHERE reason IS NOT NULL GROUP BY reason""")
def q_rejects(spark, sf_dir):
    return N.rejects(table(spark, sf_dir, "normalized_records")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_TEMPLATE = "CASE e " + " ".join(
    f"WHEN '{e}' THEN [{', '.join(chr(39) + t + chr(39) for t in ts)}]" for e, ts in N.TEMPLATES.items()) + (
    " ELSE [" + ", ".join(f"'{t}'" for t in N.TEMPLATES["neutral"]) + "] END")


@query("q_text_manifest", f"""WITH {S.HARMONISED}, m AS (SELECT record_id, emotion AS e, raw_text, {S.clean("coalesce(nullif(text, ''), raw_text)")} AS t,
  sample_id FROM harmonised), p AS (SELECT *, ({_TEMPLATE})[CAST({S.digest_mod("concat_ws(':', e, sample_id)", f'len({_TEMPLATE})')} AS INT) + 1] AS template,
  coalesce(length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 3, false) AS ok FROM m)
SELECT record_id, e AS unified_emotion, coalesce(t, template) AS text,
 CASE WHEN ok THEN CASE WHEN right(t, 1) IN ('.', '!', '?') THEN t ELSE t || '.' END || ' Emotional tone: ' || e || '.' ELSE template END AS conditioning_text,
 CASE WHEN ok THEN 'hybrid' ELSE 'template' END AS text_origin FROM p""")
def q_text_manifest(spark, sf_dir):
    m = N.text_manifest(table(spark, sf_dir, "normalized_records"))
    return m.select("record_id", "unified_emotion", "text", "conditioning_text", "text_origin")


_STEM = "regexp_replace(list_extract(string_split(audio_path, '/'), -1), '(.)\\.[^.]*$', '\\1')"


@query("q_parse_underscored", f"""SELECT record_id, f[1] AS speaker, f[2] AS sentence, f[3] AS emotion_code, f[4] AS intensity FROM (
 SELECT record_id, CASE WHEN len(string_split({_STEM}, '_')) = 4 THEN string_split({_STEM}, '_') END AS f FROM normalized_records WHERE source_dataset = 'stagetakes')""")
def q_parse_underscored(spark, sf_dir):
    return table(spark, sf_dir, "normalized_records").where("source_dataset = 'stagetakes'").select("record_id", *N.parse_underscored("audio_path"))


@query("q_parse_hyphenated", f"""SELECT record_id, f[1] AS modality, f[2] AS channel, f[3] AS emotion_code, f[4] AS intensity, f[5] AS statement, f[6] AS repetition,
 f[7] AS actor, 'actor_' || f[7] AS identity_id FROM (
 SELECT record_id, CASE WHEN len(string_split({_STEM}, '-')) = 7 THEN string_split({_STEM}, '-') END AS f FROM normalized_records WHERE source_dataset = 'echobooth')""")
def q_parse_hyphenated(spark, sf_dir):
    return table(spark, sf_dir, "normalized_records").where("source_dataset = 'echobooth'").select("record_id", *N.parse_hyphenated("audio_path"))


_TIMED = "(?s)^\\[\\s*([0-9]+\\.[0-9]+)\\s*-\\s*([0-9]+\\.[0-9]+)\\s*\\]\\s*(.*)$"


@query("q_timed_lines", f"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line,
  unnest(range(len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))))) AS line_no FROM documents)
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(regexp_extract(line, '{_TIMED}', 1) AS DOUBLE) AS start, CAST(regexp_extract(line, '{_TIMED}', 2) AS DOUBLE) AS "end",
 regexp_extract(line, '{_TIMED}', 3) AS utterance FROM l WHERE regexp_matches(line, '{_TIMED}')""")
def q_timed_lines(spark, sf_dir):
    return N.timed_lines(table(spark, sf_dir, "documents"))


@query("q_hash_split", f"""SELECT record_id, CASE WHEN v < 0.7 THEN 'train' WHEN v < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM (
 SELECT record_id, CAST({S.digest_mod('sample_id', '10000')} AS DOUBLE) / 10000 AS v FROM normalized_records)""")
def q_hash_split(spark, sf_dir):
    return table(spark, sf_dir, "normalized_records").select("record_id", H.hash_split("sample_id").alias("split"))


@query("q_text_digest", f"SELECT record_id, CASE WHEN {S.token_line('text')} <> '' THEN sha256({S.token_line('text')}) END AS digest FROM normalized_records")
def q_text_digest(spark, sf_dir):
    return table(spark, sf_dir, "normalized_records").select("record_id", H.text_digest("text").alias("digest"))


@query("q_anonymous_ids", "SELECT record_id, 'sample_' || substr(md5(sample_id), 1, 8) AS sample_id, 'id_' || substr(md5(identity_id), 1, 8) AS identity_id FROM normalized_records")
def q_anonymous_ids(spark, sf_dir):
    return table(spark, sf_dir, "normalized_records").select(
        "record_id", H.anonymous_id("sample_id", "sample_").alias("sample_id"), H.anonymous_id("identity_id").alias("identity_id"))


_PLACES = f"""t AS (SELECT doc_id, unnest({S.tokens('text')}) AS w FROM documents),
 p AS (SELECT doc_id, list_sum(list_transform(string_split(w, ''), lambda c, i: i * unicode(c))) % 64 AS place FROM t),
 n AS (SELECT doc_id, place, count(*) AS n FROM p GROUP BY ALL)"""


@query("q_token_vector", f"""WITH {_PLACES} SELECT doc_id, CAST(place AS INT) AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM n""")
def q_token_vector(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(V.token_vector("text")).alias("place", "value"))
    return d.where("value > 0").select("doc_id", "place", F.round("value", 6).alias("value"))


_TOKEN_ID = "1 + (((CAST(CAST('0x'||substr(md5(w),1,8) AS UBIGINT) AS HUGEINT)*4294967296 + CAST('0x'||substr(md5(w),9,8) AS UBIGINT)) % 32767 * 4294967296 + CAST('0x'||substr(md5(w),17,8) AS UBIGINT)) % 32767 * 4294967296 + CAST('0x'||substr(md5(w),25,8) AS UBIGINT)) % 32767"


@query("q_word_ids", f"""SELECT CAST({_TOKEN_ID} AS BIGINT) AS word_id, count(*) AS n FROM (
 SELECT unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS w FROM normalized_records) GROUP BY 1""")
def q_word_ids(spark, sf_dir):
    w = table(spark, sf_dir, "normalized_records").select(F.explode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("w"))
    n = w.groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    return n.groupBy(H.word_id("w", 32768).alias("word_id")).agg(F.sum("k").alias("n"))


@query("q_resampled", """SELECT vec_id, CAST(i AS INT) AS i, round(v[CAST(floor(pos) AS INT)+1]*(1-(pos-floor(pos))) + v[least(CAST(floor(pos) AS INT)+2, len(v))]*(pos-floor(pos)), 6) AS value
 FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, i, i*(len(embedding)-1)/47.0::DOUBLE AS pos FROM embeddings, range(48) t(i))""")
def q_resampled(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.resample("embedding", 48)).alias("i", "value"))
    return e.select("vec_id", "i", F.round("value", 6).alias("value"))


@query("q_vector_codes", """SELECT vec_id, array_to_string(list_transform(embedding[1:8], lambda x: CASE WHEN x>=0 THEN '1' ELSE '0' END), '') AS sign_code,
 array_to_string(list_transform(range(16), lambda k: substr('0123456789abcdef', 1 + CAST(list_sum(list_transform(range(4), lambda j:
  CASE WHEN CAST(embedding[4*k+j+1] AS DOUBLE) >= m THEN CAST(power(2, 3-j) AS INT) ELSE 0 END)) AS INT), 1)), '') AS average_hash
 FROM (SELECT *, list_sum(CAST(embedding AS DOUBLE[]))/len(embedding) AS m FROM embeddings)""")
def q_vector_codes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.sign_code("embedding").alias("sign_code"), V.average_hash("embedding").alias("average_hash"))


@query("q_parsed_vectors", """SELECT sample_id, len(v) AS size, round(list_sum(v), 6) AS total FROM (SELECT sample_id,
 CASE WHEN regexp_full_match(trim(z_attr), '\\[\\s*-?[0-9.eE+-]+(\\s*,\\s*-?[0-9.eE+-]+)*\\s*\\]') THEN TRY_CAST(string_split(regexp_replace(trim(z_attr), '^\\[|\\]$', '', 'g'), ',') AS DOUBLE[]) END AS v FROM predictions)""")
def q_parsed_vectors(spark, sf_dir):
    p = table(spark, sf_dir, "predictions").withColumn("v", V.parse_vector("z_attr"))
    total = F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6)
    return p.select("sample_id", F.when(F.col("v").isNotNull(), F.size("v").cast("long")).alias("size"), total.alias("total"))


@query("q_encoded_label", f"""SELECT record_id, CASE WHEN unified_emotion IS NULL OR {S.trim('unified_emotion')} = '' THEN 0
 ELSE nullif(list_position([{S.NAMES}], lower({S.trim('unified_emotion')})), 0) - 1 END AS label FROM normalized_records""")
def q_encoded_label(spark, sf_dir):
    return table(spark, sf_dir, "normalized_records").select("record_id", L.encoded_label("unified_emotion").alias("label"))


@query("q_source_union", """SELECT sample_id, nullif(array_to_string(list_sort(list_distinct(list_filter([dataset_sources.image_source, dataset_sources.audio_source, dataset_sources.text_source],
 lambda x: x IS NOT NULL))), '+'), '') AS dataset_source FROM aligned_samples""")
def q_source_union(spark, sf_dir):
    a = table(spark, sf_dir, "aligned_samples")
    return a.select("sample_id", N.joined_source(*[f"dataset_sources.{m}_source" for m in ("image", "audio", "text")]).alias("dataset_source"))


# --- aggregates ----------------------------------------------------------------------------------------------------

_FLAGS = ("has_image", "has_audio", "has_text", "has_reference")


@query("q_modality_coverage", f"WITH {S.SAMPLES} " + " UNION ALL ".join(
    f"SELECT '{f}' AS flag, count(*) FILTER ({f}) AS n, round(count(*) FILTER ({f}) / count(*), 6) AS share FROM samples" for f in _FLAGS))
def q_modality_coverage(spark, sf_dir):
    return X.coverage(samples(spark, sf_dir), {f: F.col(f) for f in _FLAGS})


@query("q_split_emotion_wide", f"""WITH {S.SAMPLES} SELECT unified_emotion, count(*) FILTER (split='train') AS train, count(*) FILTER (split='val') AS val,
 count(*) FILTER (split='test') AS test FROM samples GROUP BY unified_emotion""")
def q_split_emotion_wide(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("unified_emotion").pivot("split", ["train", "val", "test"]).agg(F.count(F.lit(1))).na.fill(0, ["train", "val", "test"])


@query("q_entities_per_split", f"""WITH {S.SAMPLES} SELECT split, count(*) AS n_rows, count(DISTINCT identity_id) AS n_identities, count(DISTINCT speaker_id) AS n_speakers,
 count(DISTINCT sample_id) AS n_samples FROM samples GROUP BY split""")
def q_entities_per_split(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("identity_id").alias("n_identities"), F.countDistinct("speaker_id").alias("n_speakers"),
        F.countDistinct("sample_id").alias("n_samples"))


@query("q_emotion_shares", f"WITH {S.SAMPLES} SELECT unified_emotion, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM samples GROUP BY unified_emotion")
def q_emotion_shares(spark, sf_dir):
    return leakage.window_share(samples(spark, sf_dir), "unified_emotion")


_SCORES = ("final_score", "emotion_match_score", "identity_similarity", "clip_similarity", "imagebind_similarity")


@query("q_score_statistics", " UNION ALL ".join(
    f"SELECT '{s}' AS score, count(alignment_scores.{s}) AS n, min(alignment_scores.{s}) AS low, round(avg(alignment_scores.{s}), 6) AS mean, max(alignment_scores.{s}) AS high, round(stddev_pop(alignment_scores.{s}), 6) AS deviation FROM aligned_samples" for s in _SCORES))
def q_score_statistics(spark, sf_dir):
    a = table(spark, sf_dir, "aligned_samples").select(F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(f"alignment_scores.{s}").alias("v")) for s in _SCORES])).alias("x")).select("x.*")
    return a.groupBy("score").agg(
        F.count("v").alias("n"), F.min("v").alias("low"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("high"), F.round(F.stddev_pop("v"), 6).alias("deviation"))


@query("q_duration_statistics", """SELECT sample_rate, count(duration_sec) AS n, round(avg(duration_sec), 6) AS mean, round(quantile_cont(CAST(duration_sec AS DOUBLE), 0.5), 6) AS median,
 round(quantile_cont(CAST(duration_sec AS DOUBLE), 0.95), 6) AS p95, round(avg(duration_sec) / 2.5, 6) AS ratio FROM audio_features GROUP BY sample_rate""")
def q_duration_statistics(spark, sf_dir):
    d = metrics.latency(table(spark, sf_dir, "audio_features"), "duration_sec", ["sample_rate"], baseline=2.5)
    return d.select("sample_rate", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "ratio")])


@query("q_majority_split", f"""WITH {S.SAMPLES}, n AS (SELECT identity_id, split, count(*) AS n FROM samples WHERE identity_id IS NOT NULL AND split IS NOT NULL GROUP BY ALL)
SELECT identity_id, arg_max(split, n * 10 - CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS target_split, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_splits FROM n GROUP BY identity_id""")
def q_majority_split(spark, sf_dir):
    return leakage.majority_split(samples(spark, sf_dir), "identity_id")


# --- windows and exports -------------------------------------------------------------------------------------------

@query("q_top_per_class", """SELECT DISTINCT unified_emotion, sample_id, final_score FROM (SELECT unified_emotion, sample_id, alignment_scores.final_score AS final_score,
 row_number() OVER (PARTITION BY unified_emotion ORDER BY alignment_scores.final_score DESC, sample_id DESC) AS k FROM (SELECT DISTINCT * FROM aligned_samples) WHERE alignment_scores.final_score IS NOT NULL) WHERE k <= 20""")
def q_top_per_class(spark, sf_dir):
    a = table(spark, sf_dir, "aligned_samples").distinct().withColumn("final_score", F.col("alignment_scores.final_score")).where("final_score IS NOT NULL")
    top = best_per_class(a, "unified_emotion", [F.desc("final_score"), F.desc("sample_id")], 20)
    return top.select("unified_emotion", "sample_id", "final_score").distinct()


@query("q_eval_bench", """SELECT DISTINCT unified_emotion, sample_id, final_score FROM (SELECT unified_emotion, sample_id, alignment_scores.final_score AS final_score,
 dense_rank() OVER (PARTITION BY unified_emotion ORDER BY alignment_scores.final_score DESC, sample_id DESC) AS k FROM aligned_samples
 WHERE split = 'test' AND modality_mask.has_image AND modality_mask.has_audio AND modality_mask.has_text AND modality_mask.has_reference_image AND alignment_scores.final_score IS NOT NULL) WHERE k <= 10""")
def q_eval_bench(spark, sf_dir):
    a = table(spark, sf_dir, "aligned_samples").where("split = 'test' AND modality_mask.has_image AND modality_mask.has_audio AND modality_mask.has_text AND modality_mask.has_reference_image")
    a = a.select("unified_emotion", "sample_id", F.col("alignment_scores.final_score").alias("final_score")).where("final_score IS NOT NULL").distinct()
    return best_per_class(a, "unified_emotion", [F.desc("final_score"), F.desc("sample_id")], 10).drop("rank_in_class")


@query("q_export_ids", """SELECT record_id, CASE WHEN k = 1 THEN s ELSE s || '_' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INT), '0') END AS export_id FROM (
 SELECT record_id, s, row_number() OVER (PARTITION BY s ORDER BY record_id) AS k FROM (SELECT record_id,
  CASE WHEN trim(regexp_replace(coalesce(sample_id, ''), '[^A-Za-z0-9\\-_.]', '_', 'g'), '._') = '' THEN 'unknown' ELSE trim(regexp_replace(coalesce(sample_id, ''), '[^A-Za-z0-9\\-_.]', '_', 'g'), '._') END AS s FROM normalized_records))""")
def q_export_ids(spark, sf_dir):
    return X.export_ids(table(spark, sf_dir, "normalized_records"), "sample_id", "record_id").select("record_id", "export_id")


@query("q_diverse_subset", """WITH a AS (SELECT DISTINCT identity_id, unified_emotion, sample_id, alignment_scores.final_score AS score FROM aligned_samples WHERE identity_id IS NOT NULL AND alignment_scores.final_score IS NOT NULL AND unified_emotion IS NOT NULL),
 c AS (SELECT *, row_number() OVER (PARTITION BY identity_id, unified_emotion ORDER BY score DESC, sample_id) AS c FROM a),
 o AS (SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY CASE WHEN c > 1 THEN 1 ELSE 0 END, CASE WHEN c = 1 THEN unified_emotion END NULLS FIRST, score DESC, sample_id) AS place FROM c)
SELECT identity_id, sample_id, unified_emotion, CAST(place AS INT) AS place FROM o WHERE place <= 5""")
def q_diverse_subset(spark, sf_dir):
    a = table(spark, sf_dir, "aligned_samples").select("identity_id", "unified_emotion", "sample_id", F.col("alignment_scores.final_score").alias("score"))
    return X.diverse_subset(a.dropna().distinct(), "identity_id", "unified_emotion", "score", "sample_id").select("identity_id", "sample_id", "unified_emotion", "place")


@query("q_representatives", f"""WITH {S.SAMPLES} SELECT audio_path, min({{'s': coalesce(split, '~'), 'id': record_id}}).id AS representative, count(*) AS n_rows FROM samples WHERE audio_path IS NOT NULL GROUP BY audio_path""")
def q_representatives(spark, sf_dir):
    return leakage.representatives(samples(spark, sf_dir), "audio_path", "record_id")


@query("q_flattened", """SELECT sample_id, dataset_sources.image_source AS dataset_sources_image_source, modality_mask.has_image AS modality_mask_has_image,
 modality_mask.has_audio AS modality_mask_has_audio, alignment_scores.final_score AS alignment_scores_final_score FROM aligned_samples""")
def q_flattened(spark, sf_dir):
    a = table(spark, sf_dir, "aligned_samples")
    flat = a.select(*X.flattened(a))
    return flat.select("sample_id", "dataset_sources_image_source", "modality_mask_has_image", "modality_mask_has_audio", "alignment_scores_final_score")


@query("q_export_checks", f"""WITH {S.SAMPLES}, c AS (SELECT 'missing_ids' AS "check", count(*) FILTER (coalesce(sample_id, '') = '') AS n FROM samples
 UNION ALL SELECT 'unknown_splits', count(*) FILTER (split IS NULL) FROM samples
 UNION ALL SELECT 'no_modality', count(*) FILTER (NOT (has_image OR has_audio OR has_text)) FROM samples
 UNION ALL SELECT 'repeated_ids', CAST(coalesce(sum(k - 1), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM samples WHERE sample_id IS NOT NULL GROUP BY sample_id))
SELECT "check", n, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM c""")
def q_export_checks(spark, sf_dir):
    return X.checks(samples(spark, sf_dir))


@query("q_anonymised_manifest", f"""WITH {S.SAMPLES} SELECT record_id, 'sample_' || substr(md5(sample_id), 1, 8) AS sample_id, split, unified_emotion, 'id_' || substr(md5(identity_id), 1, 8) AS identity_id, has_image, has_audio, has_text FROM samples""")
def q_anonymised_manifest(spark, sf_dir):
    return X.anonymised(samples(spark, sf_dir)).select("record_id", "sample_id", "split", "unified_emotion", "identity_id", "has_image", "has_audio", "has_text")


@query("q_latest_delivery", f"""WITH {S.SAMPLES} SELECT sample_id, record_id, CAST(k AS BIGINT) AS deliveries FROM (SELECT sample_id, record_id, count(*) OVER (PARTITION BY sample_id) AS k,
 row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC NULLS LAST, record_id DESC) AS n FROM samples WHERE sample_id IS NOT NULL) WHERE n = 1""")
def q_latest_delivery(spark, sf_dir):
    """The last delivery of every sample, by a maximum over (time, id) with partial aggregation instead of a window."""
    s = samples(spark, sf_dir).where("sample_id IS NOT NULL")
    return s.groupBy("sample_id").agg(F.max(F.struct("ingested_at", "record_id")).alias("x"), F.count(F.lit(1)).alias("deliveries")).select("sample_id", "x.record_id", "deliveries")


@query("q_reference_chain", f"""WITH {S.SAMPLES} SELECT identity_id, unified_emotion, count(*) AS n, CAST(row_number() OVER (PARTITION BY identity_id ORDER BY count(*) DESC, unified_emotion) AS INT) AS place
 FROM samples WHERE identity_id IS NOT NULL GROUP BY identity_id, unified_emotion""")
def q_reference_chain(spark, sf_dir):
    n = samples(spark, sf_dir).where("identity_id IS NOT NULL").groupBy("identity_id", "unified_emotion").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("identity_id").orderBy(F.desc("n"), "unified_emotion")))


@query("q_clean_text", f"SELECT record_id, {S.clean('text')} AS text FROM normalized_records")
def q_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "normalized_records").select("record_id", T.clean_text("text").alias("text"))


@query("q_quality", """SELECT split, count(*) AS n FROM aligned_samples WHERE alignment_scores.final_score >= 0.7 AND coalesce(modality_mask.has_audio, false) AND coalesce(modality_mask.has_text, false) GROUP BY split""")
def q_quality(spark, sf_dir):
    from tesserae.operators.align import quality

    return quality(table(spark, sf_dir, "aligned_samples"), 0.7, ("audio", "text")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("q_numbered_groups", f"WITH {S.SAMPLES} SELECT identity_id, printf('group_%06d', row_number() OVER (ORDER BY identity_id)) AS name FROM (SELECT DISTINCT identity_id FROM samples WHERE identity_id IS NOT NULL)")
def q_numbered_groups(spark, sf_dir):
    """Groups of one identity, named by a running number."""
    return X.numbered_groups(samples(spark, sf_dir), "identity_id")


@query("q_affect_records", f"""SELECT CAST(record_id AS VARCHAR) AS sample_id, {S.SPLIT} AS split, trim(text) AS text, text AS raw_text, {S.AFFECT} AS unified_emotion, valence, arousal FROM normalized_records WHERE valence IS NOT NULL""")
def q_affect_records(spark, sf_dir):
    """Rated texts read as a corpus of their own."""
    from tesserae.sources.corpora import affect_rated

    r = table(spark, sf_dir, "normalized_records").where("valence IS NOT NULL").select(F.col("record_id").alias("id"), "split", F.col("valence").alias("V"), F.col("arousal").alias("A"), "text")
    return affect_rated(r).select("sample_id", "split", "text", "raw_text", "unified_emotion", "valence", "arousal")


@query("q_combined_leakage", f"""WITH {S.SAMPLES}, a AS (SELECT count(*) AS k FROM samples WHERE identity_id IS NOT NULL AND split IS NOT NULL GROUP BY identity_id HAVING count(DISTINCT split) > 1),
 b AS (SELECT count(*) AS k FROM samples WHERE image_path IS NOT NULL AND split IS NOT NULL GROUP BY image_path HAVING count(DISTINCT split) > 1)
SELECT CAST(greatest((SELECT coalesce(sum(k), 0) FROM a), (SELECT coalesce(sum(k), 0) FROM b)) AS BIGINT) AS n_rows,
 round_even(100.0 * greatest((SELECT coalesce(sum(k), 0) FROM a), (SELECT coalesce(sum(k), 0) FROM b)) / (SELECT count(*) FROM samples), 4) AS percent""")
def q_combined_leakage(spark, sf_dir):
    """The larger of the leaks by identity and by its fallback, the image."""
    from tesserae.operators import leakage

    s = samples(spark, sf_dir)
    return leakage.combined_share(leakage.affected(s, {"identity": "identity_id"}), leakage.affected(s, {"image": "image_path"}))


@query("q_batches", "SELECT record_id, CAST(floor((row_number() OVER (ORDER BY record_id) - 1) / 64) AS BIGINT) AS batch FROM normalized_records")
def q_batches(spark, sf_dir):
    """Batches of 64 records in order."""
    from tesserae.operators.sampling import batches

    return batches(table(spark, sf_dir, "normalized_records").select("record_id"), "record_id", 64).select("record_id", "batch")


@query("q_shuffled_batches", "SELECT record_id, CAST(floor((row_number() OVER (ORDER BY md5(record_id || ':7'), record_id) - 1) / 64) AS BIGINT) AS batch FROM normalized_records")
def q_shuffled_batches(spark, sf_dir):
    """Batches of 64 records, shuffled by a seed."""
    from tesserae.operators.sampling import batches

    return batches(table(spark, sf_dir, "normalized_records").select("record_id"), "record_id", 64, seed=7).select("record_id", "batch")


@query("q_same_sources", f"""WITH {S.SAMPLES}, s AS (SELECT identity_id, list_sort(list(DISTINCT dataset_source) FILTER (split = 'train' AND dataset_source IS NOT NULL)) AS a,
 list_sort(list(DISTINCT dataset_source) FILTER (split = 'test' AND dataset_source IS NOT NULL)) AS b FROM samples WHERE identity_id IS NOT NULL GROUP BY identity_id)
SELECT identity_id, coalesce(a, []) = coalesce(b, []) AS same FROM s""")
def q_same_sources(spark, sf_dir):
    """Whether an identity's train and test rows come from the same sources."""
    from tesserae.operators.sampling import same_set

    of = lambda s: F.collect_set(F.when(F.col("split") == s, F.col("dataset_source")))
    s = samples(spark, sf_dir).where("identity_id IS NOT NULL").groupBy("identity_id").agg(of("train").alias("a"), of("test").alias("b"))
    return s.select("identity_id", same_set("a", "b").alias("same"))


@query("q_label_maps", """WITH m AS (SELECT sample_id, list_filter([CASE WHEN dataset_sources.image_source IS NOT NULL THEN 'image=' || dataset_sources.image_source END,
 CASE WHEN dataset_sources.audio_source IS NOT NULL THEN 'audio=' || dataset_sources.audio_source END, CASE WHEN dataset_sources.text_source IS NOT NULL THEN 'text=' || dataset_sources.text_source END], lambda x: x IS NOT NULL) AS l FROM aligned_samples)
SELECT sample_id, array_to_string(l, ',') AS sources FROM m""")
def q_label_maps(spark, sf_dir):
    """The sources of each aligned sample as a map of what is there, written as text."""
    from tesserae.operators.sampling import present_map

    m = present_map({k: F.col(f"dataset_sources.{k}_source") for k in ("image", "audio", "text")})
    a = table(spark, sf_dir, "aligned_samples").select("sample_id", m.alias("m"))
    return a.select("sample_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("sources"))


@query("q_value_summary", """SELECT 'rows' AS "column", CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM normalized_records UNION ALL SELECT 'source_dataset', source_dataset, count(*) FROM normalized_records GROUP BY source_dataset
 UNION ALL SELECT 'split', split, count(*) FROM normalized_records GROUP BY split""")
def q_value_summary(spark, sf_dir):
    """The summary that is written beside a table of records."""
    from tesserae.sources.exports import summary

    return summary(table(spark, sf_dir, "normalized_records"), ["source_dataset", "split"])
