"""Fragments of SQL shared by the statements of several queries."""

from __future__ import annotations

from tesserae.functions.labels import SYNONYMS, TABLE_CODES, TAXONOMY

WHITE = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)"


def trim(c: str) -> str:
    return f"trim({c}, {WHITE})"


def filled(c: str) -> str:
    return f"CASE WHEN {trim(c)} <> '' THEN {trim(c)} END"


def key(c: str) -> str:
    return f"CASE WHEN lower({trim(c)}) NOT IN ('','null','none','nan') THEN {trim(c)} END"


_S = "lower(regexp_replace(split, '\\s', '', 'g'))"
SPLIT = (
    f"CASE WHEN {_S} IN ('train','training','1') THEN 'train' WHEN {_S} IN ('val','valid','validation','dev','2') THEN 'val' "
    f"WHEN {_S} IN ('test','testing','3') THEN 'test' END"
)
NAMES = ",".join(f"'{x}'" for x in TAXONOMY)
EMOTION = f"CASE WHEN lower({trim('unified_emotion')}) IN ({NAMES}) THEN lower({trim('unified_emotion')}) END"

SAMPLES = f"""samples AS (
 SELECT record_id, ingested_at, {trim('sample_id')} AS sample_id, source_dataset AS dataset_source, {SPLIT} AS split,
  {filled('image_path')} AS image_path, {filled('reference_image_path')} AS reference_image_path, {filled('audio_path')} AS audio_path,
  {filled('text')} AS text, raw_text, raw_label, coalesce({EMOTION}, 'unknown') AS unified_emotion,
  {key('identity_id')} AS identity_id, {key('speaker_id')} AS speaker_id, valence, arousal,
  ({filled('image_path')}) IS NOT NULL OR ({filled('reference_image_path')}) IS NOT NULL AS has_image, ({filled('audio_path')}) IS NOT NULL AS has_audio,
  ({filled('text')}) IS NOT NULL AS has_text, ({filled('reference_image_path')}) IS NOT NULL AS has_reference
 FROM normalized_records)"""

CODES = "codes(corpus, code, emotion) AS (VALUES " + ",".join(
    f"('{c}','{k}','{e}')" for c, t in TABLE_CODES.items() for k, e in t.items()) + ")"
FREE = "free(label, emotion) AS (VALUES " + ",".join(f"('{k}','{e}')" for k, e in SYNONYMS.items()) + ")"
AFFECT = (
    "CASE WHEN valence IS NULL OR arousal IS NULL THEN NULL WHEN valence <= 2.4 AND arousal >= 3.2 THEN 'angry' WHEN valence <= 2.4 THEN 'sad' "
    "WHEN valence >= 3.4 THEN 'happy' WHEN arousal >= 3.6 THEN 'surprised' ELSE 'neutral' END"
)
#: harmonised(record_id, emotion, and the columns of the record)
HARMONISED = f"""{CODES}, {FREE}, harmonised AS (
 SELECT r.*, coalesce(CASE WHEN {trim('r.raw_label')} NOT IN ('','unlabeled','vad_heuristic') THEN
   CASE WHEN r.source_dataset IN (SELECT corpus FROM codes) AND NOT (r.source_dataset = 'faceloom' AND NOT regexp_full_match({trim('r.raw_label')}, '[0-9]+')) THEN c.emotion ELSE f.emotion END END,
   {AFFECT}, unified_emotion) AS emotion
 FROM normalized_records r
 LEFT JOIN codes c ON c.corpus = r.source_dataset AND c.code = CASE WHEN r.source_dataset = 'echobooth' THEN lpad({trim('r.raw_label')}, 2, '0')
   WHEN r.source_dataset = 'stagetakes' THEN upper({trim('r.raw_label')}) WHEN r.source_dataset = 'parlordialog' THEN lower({trim('r.raw_label')}) ELSE {trim('r.raw_label')} END
 LEFT JOIN free f ON f.label = trim(regexp_replace(replace(lower({trim('r.raw_label')}), '_', ' '), '\\s+', ' ', 'g')))"""


def digest_mod(text: str, n: str) -> str:
    """The SHA-256 of a text, read as a number, modulo n."""
    parts = ",".join(f"CAST(CAST('0x' || substr(sha256({text}), {8 * i + 1}, 8) AS UBIGINT) AS HUGEINT)" for i in range(8))
    return f"list_reduce([CAST(0 AS HUGEINT), {parts}], lambda a, x: (a * 4294967296 + x) % CAST({n} AS HUGEINT))"


TOKENS = "regexp_extract_all(lower({c}), '[a-z0-9'']+')"


def tokens(c: str) -> str:
    return TOKENS.format(c=f"coalesce({c}, '')")


def token_line(c: str) -> str:
    return f"array_to_string({tokens(c)}, ' ')"


_RUN = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def clean(c: str) -> str:
    return f"nullif(trim(regexp_replace(replace(regexp_replace({c}, '[\\r\\n]', ' ', 'g'), '\"\"', '\"'), '{_RUN}', ' ', 'g'), ' '), '')"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda z: z[1] * z[2]))"


def unit_cosine(a: str, b: str) -> str:
    return f"greatest(0, least(1, ({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) + 1) / 2))"
