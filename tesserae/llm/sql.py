"""SQL of the queries that SQL can state on whole tables."""

from __future__ import annotations

from tesserae.plans import sqltext as S

_UNITS = f"""units AS (SELECT DISTINCT {S.SPLIT} AS split, {S.EMOTION} AS unified_emotion, sample_id FROM normalized_records WHERE sample_id IS NOT NULL),
 valid AS (SELECT * FROM units WHERE split IS NOT NULL AND unified_emotion IS NOT NULL), total AS (SELECT split, count(DISTINCT sample_id) AS n FROM valid GROUP BY split),
 cell AS (SELECT split, unified_emotion, count(*) AS n FROM valid GROUP BY ALL)"""

_KEYS = " UNION ALL ".join(f"SELECT '{c}' AS entity_field, {S.key(c)} AS entity_key, {S.SPLIT} AS split FROM normalized_records" for c in ("identity_id", "speaker_id"))

_WORDS = "array_to_string(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), ' ')"
_FIELDS = "list_sort(list_filter(list_transform(regexp_split_to_array(raw_text, '[;|\\r\\n]'), lambda p: array_to_string(regexp_extract_all(lower(p), '[\\p{L}\\p{N}]+'), ' ')), lambda x: x <> ''))"
_COMPARED = ("source_dataset", "split", "image_path", "reference_image_path", "audio_path", "audio_feature_path", "raw_label", "unified_emotion", "identity_id", "speaker_id", "valence", "arousal")
_COPIES = f"""keyed AS (SELECT record_id, min(record_id) OVER (PARTITION BY {', '.join(_COMPARED)}, {_WORDS.format('text')}, text IS NULL, {_FIELDS}, raw_text IS NULL) AS kept_id FROM normalized_records)"""

_ENDS = f"""ends AS (SELECT {S.trim('left_key')} AS u, {S.trim('right_key')} AS v FROM match_links WHERE lower({S.trim('verdict')}) = 'match'),
 ways AS (SELECT DISTINCT u, v FROM (SELECT u, v FROM ends UNION ALL SELECT v, u FROM ends) WHERE u <> v AND u <> '' AND v <> '')"""

_REACH = f"""WITH RECURSIVE {_ENDS}, reach(member_key, group_key) USING KEY (member_key) AS (
 SELECT u, least(u, min(v)) FROM ways GROUP BY u
 UNION SELECT w.v, min(r.group_key) FROM reach r JOIN ways w ON w.u = r.member_key JOIN recurring.reach o ON o.member_key = w.v WHERE r.group_key < o.group_key GROUP BY w.v)"""

SQL: dict[str, str] = {
    "p1_found": f"""WITH {_UNITS} SELECT t.split, t.unified_emotion FROM sample_targets t LEFT JOIN total USING (split) LEFT JOIN cell c ON c.split = t.split AND c.unified_emotion = t.unified_emotion
 WHERE coalesce(c.n, 0) < greatest(t.min_rows, t.target_share * t.sample_fraction * coalesce(total.n, 0))""",
    "p2_found": f"SELECT entity_field, entity_key FROM ({_KEYS}) WHERE entity_key IS NOT NULL GROUP BY ALL HAVING count(DISTINCT split) > 1",
    "p6_found": f"WITH {_COPIES} SELECT kept_id, record_id AS copy_id FROM keyed WHERE record_id <> kept_id",
    "p6_copies": f"WITH {_COPIES} SELECT kept_id, count(*) AS n_copies FROM keyed GROUP BY kept_id",
    "p1_check": f"""WITH {_UNITS}, asked AS (SELECT t.split, t.unified_emotion, CAST(greatest(t.min_rows, t.target_share * t.sample_fraction * coalesce(total.n, 0)) AS DOUBLE) AS asked, coalesce(c.n, 0) AS available
 FROM sample_targets t LEFT JOIN total USING (split) LEFT JOIN cell c ON c.split = t.split AND c.unified_emotion = t.unified_emotion)
SELECT split, unified_emotion, round(asked, 6) AS asked, available, available < asked AS falls_short, true AS drawn_whole FROM asked""",
    "p2_check": f"SELECT entity_field, count(DISTINCT entity_key) AS n_keys, CAST(0 AS BIGINT) AS n_torn FROM ({_KEYS}) WHERE entity_key IS NOT NULL GROUP BY entity_field",
    "p7_found": f"{_REACH} SELECT member_key, group_key FROM reach",
    "p7_group_sizes": f"{_REACH} SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM reach GROUP BY group_key) GROUP BY size",
}
