"""Queries of leakage checks, near duplicates, split building and alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tesserae.functions import vectors as V
from tesserae.functions.hashing import text_digest
from tesserae.functions.labels import TAXONOMY
from tesserae.functions.text import token_line
from tesserae.operators import align, blocking, leakage, splits
from tesserae.operators.components import component_sizes, component_statistics
from tesserae.plans import sqltext as S
from tesserae.plans.catalog import query, table
from tesserae.plans.record_queries import samples
from tesserae.workspace import Workspace

_LIST = "array_to_string(list_sort(list(DISTINCT {0}) FILTER ({0} IS NOT NULL)), ',')"


def _leak_sql(key: str, name: str, source: str = "samples") -> str:
    return f"""SELECT {key} AS {name}, count(*) AS n_rows, count(DISTINCT split) AS n_splits, {_LIST.format('split')} AS splits, {_LIST.format('dataset_source')} AS sources
 FROM {source} WHERE {key} IS NOT NULL AND split IS NOT NULL GROUP BY {key} HAVING count(DISTINCT split) > 1"""


@query("q_identity_leakage", f"WITH {S.SAMPLES} {_leak_sql('identity_id', 'identity_id')}")
def q_identity_leakage(spark, sf_dir):
    return leakage.leaking_keys(samples(spark, sf_dir), "identity_id")


@query("q_speaker_leakage", f"WITH {S.SAMPLES} {_leak_sql('speaker_id', 'speaker_id')}")
def q_speaker_leakage(spark, sf_dir):
    return leakage.leaking_keys(samples(spark, sf_dir), "speaker_id")


@query("q_audio_duplicates", f"WITH {S.SAMPLES} {_leak_sql('audio_path', 'audio_path')}")
def q_audio_duplicates(spark, sf_dir):
    return leakage.leaking_keys(samples(spark, sf_dir), "audio_path")


_TEXTED = f"texted AS (SELECT *, CASE WHEN {S.token_line('text')} <> '' THEN sha256({S.token_line('text')}) END AS text_key FROM samples)"


@query("q_text_duplicates", f"WITH {S.SAMPLES}, {_TEXTED} {_leak_sql('text_key', 'text_key', 'texted')}")
def q_text_duplicates(spark, sf_dir):
    return leakage.leaking_keys(leakage.content_keys(samples(spark, sf_dir)), "text_key")


@query("q_image_duplicates", f"""WITH {S.SAMPLES}, fields AS (SELECT split, dataset_source, unnest([image_path, reference_image_path]) AS path FROM samples)
 SELECT path, n_rows, splits, sources FROM ({_leak_sql('path', 'path', 'fields')})""")
def q_image_duplicates(spark, sf_dir):
    return leakage.image_duplicates(samples(spark, sf_dir))


@query("q_cross_modal", f"""WITH {S.SAMPLES}, {_TEXTED}, l AS (
 SELECT 'identity' AS kind, identity_id AS key, unified_emotion AS emotion, split FROM texted UNION ALL SELECT 'speaker', speaker_id, unified_emotion, split FROM texted
 UNION ALL SELECT 'text', text_key, unified_emotion, split FROM texted UNION ALL SELECT 'audio', audio_path, unified_emotion, split FROM texted)
SELECT kind, key, emotion, count(*) AS n_rows, {_LIST.format('split')} AS splits FROM l WHERE key IS NOT NULL AND split IS NOT NULL GROUP BY ALL HAVING count(DISTINCT split) > 1""")
def q_cross_modal(spark, sf_dir):
    return leakage.cross_modal(leakage.content_keys(samples(spark, sf_dir)))


_CHECKS = {"identity": "identity_id", "speaker": "speaker_id", "image": "image_path", "audio": "audio_path", "text": "text_key"}


@query("q_leakage_summary", f"WITH {S.SAMPLES}, {_TEXTED}, c AS (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS "check", count(*) AS n_keys, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_rows FROM (SELECT count(*) AS k FROM texted
 WHERE {c} IS NOT NULL AND split IS NOT NULL GROUP BY {c} HAVING count(DISTINCT split) > 1)""" for n, c in _CHECKS.items()) + """)
SELECT "check", n_keys, n_rows, round_even(100.0 * n_rows / (SELECT count(*) FROM samples), 4) AS percent,
 CASE WHEN 100.0 * n_rows / (SELECT count(*) FROM samples) >= 1.0 OR n_keys >= 10 THEN 'FAIL' WHEN 100.0 * n_rows / (SELECT count(*) FROM samples) >= 0.1 OR n_keys >= 1 THEN 'WARNING' ELSE 'PASS' END AS status FROM c""")
def q_leakage_summary(spark, sf_dir):
    s = leakage.content_keys(samples(spark, sf_dir))
    return leakage.affected(s, _CHECKS).withColumn("status", leakage.severity(F.col("percent"), F.col("n_keys")))


@query("q_cross_dataset", f"""WITH {S.SAMPLES}, {_TEXTED}, d AS (SELECT DISTINCT text_key, dataset_source FROM texted WHERE text_key IS NOT NULL AND dataset_source IS NOT NULL)
SELECT a.dataset_source AS source_a, b.dataset_source AS source_b, count(*) AS n_keys FROM d a JOIN d b USING (text_key) WHERE a.dataset_source < b.dataset_source GROUP BY ALL""")
def q_cross_dataset(spark, sf_dir):
    return leakage.cross_dataset(leakage.content_keys(samples(spark, sf_dir)), "text_key")


@query("q_near_summary")
def q_near_summary(spark, sf_dir):
    """Near matches across splits. Records have no hashes or vectors of media, so over this table they are matches of texts."""
    s = leakage.content_keys(samples(spark, sf_dir))
    return leakage.match_summary(s, leakage.near_matches(s)).withColumn("status", leakage.severity(F.col("percent"), F.col("n_keys")))


@query("q_cross_dataset_matches")
def q_cross_dataset_matches(spark, sf_dir):
    s = leakage.content_keys(samples(spark, sf_dir))
    return leakage.cross_dataset_matches(s, leakage.near_matches(s))


_PRIO = "CASE {0} WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END"
_MOVES = S.SAMPLES + "".join(f""", n_{k} AS (SELECT {k}, split, count(*) AS n FROM samples WHERE {k} IS NOT NULL AND split IS NOT NULL GROUP BY ALL),
 t_{k} AS (SELECT {k}, arg_max(split, n * 10 - {_PRIO.format('split')}) AS target FROM n_{k} GROUP BY {k} HAVING count(*) > 1),
 m_{k} AS (SELECT record_id AS id, split AS from_split, target AS to_split, '{k}:' || {k} AS reason FROM samples JOIN t_{k} USING ({k}) WHERE split IS NOT NULL AND split <> target)"""
    for k in ("identity_id", "speaker_id")) + f""", moves AS (SELECT id, any_value(from_split) AS from_split, arg_min(to_split, {_PRIO.format('to_split')}) AS to_split, count(DISTINCT reason) AS n_reasons
 FROM (SELECT * FROM m_identity_id UNION ALL SELECT * FROM m_speaker_id) GROUP BY id)"""


@query("q_remediation_moves", f"WITH {_MOVES} SELECT * FROM moves")
def q_remediation_moves(spark, sf_dir):
    return leakage.remediation(samples(spark, sf_dir))


@query("q_remediated_counts", f"WITH {_MOVES} SELECT coalesce(to_split, split) AS split, count(*) AS n FROM samples LEFT JOIN moves ON id = record_id WHERE coalesce(to_split, split) IS NOT NULL GROUP BY 1")
def q_remediated_counts(spark, sf_dir):
    s = samples(spark, sf_dir)
    return leakage.split_counts(leakage.apply_moves(s, leakage.remediation(s)))


# --- near duplicates -----------------------------------------------------------------------------------------------

_HASHES = """h AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) >= m) AS b, embedding FROM (SELECT *, list_sum(CAST(embedding AS DOUBLE[]))/len(embedding) AS m FROM embeddings))"""


@query("q_hash_pairs", f"""WITH {_HASHES}, p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, len(list_filter(list_zip(a.b, b.b), lambda z: z[1] <> z[2])) AS distance
 FROM h a JOIN h b ON a.b[1:8] = b.b[1:8] AND a.vec_id < b.vec_id) SELECT left_id, right_id, distance FROM p WHERE distance <= 24""")
def q_hash_pairs(spark, sf_dir):
    """Vectors whose average hashes begin alike and differ in at most 24 bits."""
    h = table(spark, sf_dir, "embeddings").select("vec_id", V.average_hash("embedding").alias("h")).withColumn("prefix", F.substring("h", 1, 2))
    pairs = blocking.blocked_pairs(h, ["prefix"], "vec_id", ["h"], lambda a, b: V.hamming(a("h"), b("h")) <= 24)
    return pairs.select("left_id", "right_id", V.hamming("left_h", "right_h").cast("long").alias("distance"))


@query("q_signature_pairs", f"""WITH s AS (SELECT vec_id, embedding, list_transform(embedding[1:8], lambda x: x >= 0) AS s FROM embeddings), p AS (
 SELECT a.vec_id AS left_id, b.vec_id AS right_id, {S.unit_cosine('a.embedding', 'b.embedding')} AS similarity FROM s a JOIN s b ON a.s = b.s AND a.vec_id < b.vec_id)
SELECT left_id, right_id, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.62""")
def q_signature_pairs(spark, sf_dir):
    """Vectors of one sign signature with a unit cosine of at least .62."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.normalised("embedding").alias("v"), V.sign_code("embedding").alias("code"))
    sim = lambda a, b: V.clamp01((V.dot(a, b) + 1) / 2)
    pairs = blocking.blocked_pairs(e, ["code"], "vec_id", ["v"], lambda a, b: sim(a("v"), b("v")) >= 0.62)
    return pairs.select("left_id", "right_id", F.round(sim("left_v", "right_v"), 6).alias("similarity"))


def _text_classes(spark, sf_dir):
    """(record_id, line, emotion) of the least record of every distinct normalised text and emotion."""
    s = samples(spark, sf_dir).select("record_id", F.col("unified_emotion").alias("emotion"), token_line("text").alias("line")).where("line <> ''")
    return s.groupBy("line", "emotion").agg(F.min("record_id").alias("record_id"))


def _text_pairs(spark, sf_dir, least: float):
    c = _text_classes(spark, sf_dir)
    c = c.select("record_id", "line", *blocking.text_block("line", "emotion"), V.token_vector("line").alias("v"))
    c = Workspace(spark, "texts").write(c, "vectors")  # vectors are computed once, not once per side of the join
    sim = lambda a, b: V.clamp01((V.dot(a, b) + 1) / 2)
    pairs = blocking.blocked_pairs(c, ["token1", "token2", "band", "emotion"], "record_id", ["v", "line"], lambda a, b: sim(a("v"), b("v")) >= least)
    return pairs.withColumn("similarity", sim("left_v", "right_v"))


_BLOCKED = f"""{S.SAMPLES}, c AS (SELECT min(record_id) AS id, line, emotion FROM (SELECT record_id, unified_emotion AS emotion, {S.token_line('text')} AS line FROM samples) WHERE line <> '' GROUP BY line, emotion),
 w AS (SELECT id, unnest(string_split(line, ' ')) AS w FROM c), pl AS (SELECT id, list_sum(list_transform(string_split(w, ''), lambda c, i: i * unicode(c))) % 64 AS place FROM w),
 n AS (SELECT id, place, count(*) AS n FROM pl GROUP BY ALL), l AS (SELECT id, sqrt(sum(n * n)) AS len FROM n GROUP BY id),
 k AS (SELECT id, emotion, string_split(line, ' ') AS t FROM c), b AS (SELECT id, emotion, t[1] AS t1, t[2] AS t2, least(len(t) // 8, 20) AS band FROM k),
 q AS (SELECT a.id AS x, b.id AS y FROM b a JOIN b b ON a.emotion = b.emotion AND a.t1 = b.t1 AND a.t2 = b.t2 AND a.band = b.band AND a.id < b.id)"""


@query("q_text_block_pairs", f"""WITH {_BLOCKED}, d AS (SELECT x, y, sum(a.n * b.n) AS d FROM q JOIN n a ON a.id = x JOIN n b ON b.id = y AND a.place = b.place GROUP BY x, y)
SELECT x AS left_id, y AS right_id, round((d / (a.len * b.len) + 1) / 2, 6) AS similarity FROM d JOIN l a ON a.id = x JOIN l b ON b.id = y WHERE (d / (a.len * b.len) + 1) / 2 >= 0.96""")
def q_text_block_pairs(spark, sf_dir):
    """Distinct texts of one block (first two tokens, length band, emotion) with a unit cosine of at least .96, as pairs of their least records."""
    return _text_pairs(spark, sf_dir, 0.96).select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


@query("q_fuzzy_texts")
def q_fuzzy_texts(spark, sf_dir):
    """The same blocks by the matching-blocks ratio of at least .97 or the cosine of at least .96."""
    c = _text_classes(spark, sf_dir)
    p = blocking.close_lines(c.select("record_id", "line", *blocking.text_block("line", "emotion")), ["token1", "token2", "band", "emotion"], "record_id", "line", 0.96, 0.97)
    return p.select("left_id", "right_id", F.round("similarity", 6).alias("similarity"), F.round("ratio", 6).alias("ratio"))


@query("q_leader_clusters")
def q_leader_clusters(spark, sf_dir):
    """Greedy leader clusters of vectors within sign signatures."""
    e = table(spark, sf_dir, "embeddings").withColumn("code", V.sign_code("embedding"))
    return blocking.leader_clusters(e, "code", "vec_id", "embedding", 0.6)


_NEAR = f"""SELECT query_id, neighbour_id, similarity, rank FROM (SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, round({S.unit_cosine('q.embedding', 'b.embedding')}, 12) AS s,
 round({S.unit_cosine('q.embedding', 'b.embedding')}, 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({S.unit_cosine('q.embedding', 'b.embedding')}, 12) DESC, b.vec_id) AS rank
 FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 10"""


@query("q_nearest", _NEAR)
def q_nearest(spark, sf_dir):
    """The stated query set (ids divisible by 50) against all rows: ten nearest each."""
    e = table(spark, sf_dir, "embeddings")
    n = blocking.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 10)
    return n.select("query_id", "neighbour_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


# --- splits --------------------------------------------------------------------------------------------------------

_BUCKETS = f"""buckets AS (SELECT audio_path, count(*) AS n_rows, count(DISTINCT identity_id) AS n_identities, count(DISTINCT speaker_id) AS n_speakers,
 count(DISTINCT nullif({S.token_line('text')}, '')) AS n_texts FROM samples WHERE audio_path IS NOT NULL GROUP BY audio_path),
 guarded AS (SELECT *, CASE WHEN n_rows > 32 THEN 'group_size' WHEN n_identities > 8 THEN 'distinct_identities' WHEN n_texts > 32 THEN 'distinct_texts' END AS refusal FROM buckets)"""


@query("q_audio_buckets", f"WITH {S.SAMPLES}, {_BUCKETS} SELECT * FROM guarded")
def q_audio_buckets(spark, sf_dir):
    return splits.audio_buckets(samples(spark, sf_dir))


def _star(key: str, rule: str, where: str = "true") -> str:
    return f"""SELECT "left", record_id AS "right", '{rule}' AS rule, {key} AS value FROM (SELECT record_id, {key}, min(record_id) OVER (PARTITION BY {key}) AS "left" FROM samples WHERE {key} IS NOT NULL AND {where}) WHERE "left" <> record_id"""


_HARD = " UNION ALL ".join([
    _star("sample_id", "sample_id"), _star("identity_id", "identity_id"), _star("speaker_id", "speaker_id"), _star("image_path", "image_hash"),
    _star("audio_path", "audio_hash", "audio_path IN (SELECT audio_path FROM guarded WHERE refusal IS NULL)")])


@query("q_hard_edges", f"WITH {S.SAMPLES}, {_BUCKETS} {_HARD}")
def q_hard_edges(spark, sf_dir):
    return splits.hard_edges(samples(spark, sf_dir))


def _members(spark, sf_dir):
    s = samples(spark, sf_dir)
    return Workspace(spark, "members").write(splits.grouped(s, splits.hard_edges(s)), "members")


_GROUPS = f"""WITH RECURSIVE {S.SAMPLES}, {_BUCKETS}, hard AS ({_HARD}), ways AS (SELECT DISTINCT u, v FROM (SELECT "left" AS u, "right" AS v FROM hard UNION ALL SELECT "right", "left" FROM hard)),
 reach(member, root) USING KEY (member) AS (SELECT u, least(u, min(v)) FROM ways GROUP BY u
 UNION SELECT w.v, min(r.root) FROM reach r JOIN ways w ON w.u = r.member JOIN recurring.reach o ON o.member = w.v WHERE r.root < o.root GROUP BY w.v),
 groups AS (SELECT record_id, coalesce(root, record_id) AS group_id FROM samples LEFT JOIN reach ON member = record_id)"""


@query("q_hard_groups", f"{_GROUPS} SELECT * FROM groups")
def q_hard_groups(spark, sf_dir):
    """(record_id, group_id) of all records: connected by any hard rule."""
    return _members(spark, sf_dir).select("record_id", "group_id")


@query("q_group_statistics", f"""{_GROUPS}, sizes AS (SELECT count(*) AS size FROM groups GROUP BY group_id), placed AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS k, count(*) OVER () AS n, sum(size) OVER () AS rows FROM sizes)
SELECT any_value(n) AS n_groups, CAST(any_value(rows) AS BIGINT) AS n_rows, max(size) AS largest, round(max(size) / any_value(rows), 6) AS largest_share, max(CASE WHEN k = n // 2 + 1 THEN size END) AS middle_size,
 count(*) FILTER (size > 5000) AS over_size, count(*) FILTER (size / rows > 0.35) AS over_share FROM placed""")
def q_group_statistics(spark, sf_dir):
    return component_statistics(component_sizes(_members(spark, sf_dir).withColumnRenamed("group_id", "component")))


_STRICT = splits.Policy(quarantine_oversized=True, drop_ambiguous=True, max_group_size=20)


@query("q_dropped_groups", f"""{_GROUPS}, g AS (SELECT group_id, count(*) AS size, count(DISTINCT split) AS n_splits FROM groups JOIN samples USING (record_id) GROUP BY group_id), t AS (SELECT sum(size) AS total FROM g),
 r AS (SELECT group_id, size, CASE WHEN size > 20 OR (total >= 1000 AND size / total > 0.35) THEN 'oversized_hard_group' WHEN n_splits > 2 THEN 'ambiguous_existing_split_links' END AS reason FROM g, t)
SELECT * FROM r WHERE reason IS NOT NULL""")
def q_dropped_groups(spark, sf_dir):
    """Groups that a strict policy leaves out of the assignment, with the reason."""
    g = splits.with_drop_reason(splits.group_table(_members(spark, sf_dir), maps=False), _STRICT)
    return g.where("reason IS NOT NULL").select("group_id", "size", "reason")


@query("q_assign_reserved")
def q_assign_reserved(spark, sf_dir):
    return splits.assign_reserved(splits.group_table(_members(spark, sf_dir), maps=False))


@query("q_assign_balanced")
def q_assign_balanced(spark, sf_dir):
    return splits.assign_balanced(splits.group_table(_members(spark, sf_dir)))


@query("q_assign_by_deficit", f"""WITH RECURSIVE {S.SAMPLES}, g AS (SELECT identity_id AS group_id, count(*) AS size FROM samples WHERE identity_id IS NOT NULL GROUP BY 1),
 o AS (SELECT *, row_number() OVER (ORDER BY sha256(group_id), group_id) AS k, CAST(sum(size) OVER () AS DOUBLE) AS total FROM g),
 fold(k, group_id, size, split, tr, va, te) AS (SELECT 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
 UNION ALL SELECT k, group_id, size, s, tr + CASE s WHEN 'train' THEN size ELSE 0 END, va + CASE s WHEN 'val' THEN size ELSE 0 END, te + CASE s WHEN 'test' THEN size ELSE 0 END FROM (
  SELECT o.k, o.group_id, o.size, tr, va, te, CASE WHEN total * 0.7 - tr >= greatest(total * 0.15 - va, total * 0.15 - te) THEN 'train' WHEN total * 0.15 - va >= total * 0.15 - te THEN 'val' ELSE 'test' END AS s FROM fold f JOIN o ON o.k = f.k + 1))
SELECT group_id, size, split FROM fold WHERE k > 0""")
def q_assign_by_deficit(spark, sf_dir):
    m = samples(spark, sf_dir).where("identity_id IS NOT NULL")
    return splits.assign_by_deficit(m.groupBy(F.col("identity_id").alias("group_id")).agg(F.count(F.lit(1)).alias("size")))


@query("q_disjoint_splits", f"""WITH {S.SAMPLES}, v AS (SELECT record_id, CAST({S.digest_mod("coalesce(identity_id, CAST(record_id AS VARCHAR))", '10000')} AS DOUBLE) / 10000 AS v FROM samples)
SELECT record_id, CASE WHEN v < 0.7 THEN 'train' WHEN v < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM v""")
def q_disjoint_splits(spark, sf_dir):
    return splits.disjoint_splits(samples(spark, sf_dir))


def _conflict(bucket: str, kind: str, where: str = "true") -> str:
    return f"""SELECT '{kind}' AS kind, g AS group_id, m.split, o.split AS other_split, count(*) AS n FROM
 (SELECT DISTINCT {bucket} AS b, g, split FROM keyed WHERE {bucket} IS NOT NULL AND split IS NOT NULL AND {where}) m JOIN
 (SELECT DISTINCT {bucket} AS b, split FROM keyed WHERE {bucket} IS NOT NULL AND split IS NOT NULL AND {where}) o ON m.b = o.b AND m.split <> o.split GROUP BY ALL"""


@query("q_soft_conflicts", f"""WITH {S.SAMPLES}, {_TEXTED}, {_BUCKETS}, keyed AS (SELECT t.*, coalesce(identity_id, 'record ' || record_id) AS g, refusal FROM texted t LEFT JOIN guarded USING (audio_path)) """ + " UNION ALL ".join([
    _conflict("text_key", "text_duplicate"), _conflict("audio_path", "exact_audio_duplicate", "refusal IS NULL"), _conflict("audio_path", "ambiguous_audio_reuse", "refusal IS NOT NULL")]))
def q_soft_conflicts(spark, sf_dir):
    """Warnings between the groups of identities (a record without one is a group of its own)."""
    m = leakage.content_keys(samples(spark, sf_dir)).withColumn("group_id", F.coalesce("identity_id", F.concat(F.lit("record "), F.col("record_id").cast("string"))))
    return splits.soft_conflicts(m)


@query("q_repaired_counts")
def q_repaired_counts(spark, sf_dir):
    """(split, n) after the balanced assignment of hard groups and its repair."""
    m = _members(spark, sf_dir).drop("split").withColumn("text_key", text_digest("text"))
    g = splits.kept(splits.group_table(m.withColumn("split", F.lit(None).cast("string"))), splits.Policy())
    a = splits.assign_balanced(g).select("group_id", "split")
    keyed = Workspace(spark, "repair").write(m.join(a, "group_id"), "assigned")
    return leakage.split_counts(splits.repair(keyed))


@query("q_split_validation", f"""WITH {S.SAMPLES}, {_BUCKETS.replace('FROM samples', 'FROM (SELECT * FROM samples WHERE split IS NOT NULL)')}, c AS (
 SELECT 'identity_overlap' AS "check", count(*) AS n FROM ({_leak_sql('identity_id', 'k')}) UNION ALL SELECT 'speaker_overlap', count(*) FROM ({_leak_sql('speaker_id', 'k')})
 UNION ALL SELECT 'exact_image_overlap', count(*) FROM ({_leak_sql('image_path', 'k')}) UNION ALL SELECT 'audio_overlap_raw', count(*) FROM ({_leak_sql('audio_path', 'k')})
 UNION ALL SELECT 'audio_overlap_actionable', count(*) FROM ({_leak_sql('audio_path', 'k')}) JOIN guarded ON k = audio_path WHERE refusal IS NULL
 UNION ALL SELECT 'audio_overlap_ambiguous', count(*) FROM ({_leak_sql('audio_path', 'k')}) JOIN guarded ON k = audio_path WHERE refusal IS NOT NULL
 UNION ALL SELECT 'missing_splits', 3 - count(DISTINCT split) FROM samples)
SELECT "check", n, CASE WHEN n > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM c""")
def q_split_validation(spark, sf_dir):
    return splits.validation(samples(spark, sf_dir))


# --- alignment -----------------------------------------------------------------------------------------------------

_PARTS = {"emotion_match_score": 0.40, "identity_similarity": 0.20, "clip_similarity": 0.18, "imagebind_similarity": 0.12}
_C = {k: f"greatest(0, least(1, alignment_scores.{k}))" for k in _PARTS}
_FUSED = "(" + " + ".join(f"{w} * {_C[k]}" for k, w in _PARTS.items()) + f" + 0.10 * ({_C['clip_similarity']} + {_C['imagebind_similarity']}) / 2) / 1.0"


@query("q_fused_scores", f"""SELECT sample_id, round({_FUSED}, 6) AS fused, {_FUSED} >= 0.55 AND alignment_scores.emotion_match_score >= 0.5
 AND (NOT modality_mask.has_reference_image OR alignment_scores.identity_similarity >= 0.4) AS passes FROM aligned_samples""")
def q_fused_scores(spark, sf_dir):
    a = table(spark, sf_dir, "aligned_samples").select("sample_id", "alignment_scores.*", F.col("modality_mask.has_reference_image").alias("ref"))
    fused = align.fused_score("emotion_match_score", "identity_similarity", "clip_similarity", "imagebind_similarity")
    return a.select("sample_id", F.round(fused, 6).alias("fused"), align.passes(fused, "emotion_match_score", "identity_similarity", "ref").alias("passes"))


_M = "coalesce(modality_mask.has_{0}, false)"
_MODES = {"full_multimodal": ("image", "audio", "text"), "image_text": ("image", "text"), "image_audio": ("image", "audio"), "text_audio_image_reference": ("image", "audio", "text", "reference_image")}


@query("q_mode_views", " UNION ALL ".join(f"SELECT '{m}' AS mode, split, count(*) AS n FROM aligned_samples WHERE {' AND '.join(_M.format(x) for x in xs)} GROUP BY split" for m, xs in _MODES.items()))
def q_mode_views(spark, sf_dir):
    """Rows of each view by split; the table is read once."""
    flags = align.mode_flags()
    a = table(spark, sf_dir, "aligned_samples").select("split", F.explode(F.array(*[F.struct(F.lit(k).alias("mode"), c.alias("ok")) for k, c in flags.items()])).alias("x"))
    return a.where("x.ok").groupBy("x.mode", "split").agg(F.count(F.lit(1)).alias("n"))


def _anchors_and_texts(spark, sf_dir):
    """Image records with a stand-in vector, and text records with the vector of their tokens. Written once: both are used twice."""
    ws = Workspace(spark, "align")
    s = samples(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    v = e.select(F.col("vec_id").alias("slot"), V.doubles("embedding").alias("anchor_vec"))
    a = s.where("image_path IS NOT NULL").withColumn("slot", F.col("record_id") % n).join(v, "slot")
    a = a.where(F.col("unified_emotion").isin(*TAXONOMY)).select(F.col("record_id").alias("anchor_id"), F.col("unified_emotion").alias("anchor_emotion"), "anchor_vec", "sample_id", "split", "identity_id", "dataset_source")
    t = s.where("text IS NOT NULL").select("record_id", "sample_id", "dataset_source", "unified_emotion", V.token_vector("text").alias("vec"))
    return ws, ws.write(a, "anchors"), ws.write(t, "texts")


_REL = " OR ".join(f"(a IN ({','.join(repr(x) for x in g)}) AND b IN ({','.join(repr(x) for x in g)}))" for g in (("happy", "surprised"), ("sad", "fearful"), ("angry", "disgusted", "contemptuous")))


@query("q_text_candidates", f"""WITH {S.SAMPLES}, tax AS (SELECT unnest([{S.NAMES}]) AS e, unnest(range(8)) AS i),
 rel AS (SELECT x.e AS a, y.e AS b, y.i FROM tax x, tax y), kin AS (SELECT * FROM rel WHERE a = b OR {_REL}),
 txt AS (SELECT record_id, dataset_source, unified_emotion, text FROM samples WHERE text IS NOT NULL AND unified_emotion IN ({S.NAMES})),
 pool AS (SELECT a AS anchor_emotion, b AS emotion, record_id, row_number() OVER (PARTITION BY a ORDER BY i, dataset_source, record_id) - 1 AS place, count(*) OVER (PARTITION BY a) AS n FROM kin JOIN txt ON b = unified_emotion),
 anc AS (SELECT record_id AS anchor_id, unified_emotion AS anchor_emotion, embedding FROM samples JOIN embeddings ON vec_id = record_id % (SELECT count(*) FROM embeddings) WHERE image_path IS NOT NULL AND unified_emotion IN ({S.NAMES})),
 sized AS (SELECT anc.*, n, CASE WHEN n <= 24 THEN 0 ELSE {S.digest_mod("'text:' || anchor_id", 'n')} END AS start, CASE WHEN n <= 24 THEN 1 ELSE greatest(1, n // 24) END AS step
  FROM anc JOIN (SELECT DISTINCT anchor_emotion, n FROM pool) USING (anchor_emotion)),
 picks AS (SELECT anchor_id, anchor_emotion, embedding, k AS ordinal, (start + k * step) % n AS place FROM sized, range(24) r(k) WHERE k < n),
 seen AS (SELECT anchor_id, anchor_emotion, emotion, record_id, ordinal, embedding FROM picks JOIN pool USING (anchor_emotion, place)),
 used AS (SELECT DISTINCT record_id FROM seen), w AS (SELECT record_id, unnest({S.tokens('text')}) AS w FROM txt JOIN used USING (record_id)),
 pl AS (SELECT record_id, list_sum(list_transform(string_split(w, ''), lambda c, i: i * unicode(c))) % 64 AS place FROM w), n AS (SELECT record_id, place, count(*) AS n FROM pl GROUP BY ALL),
 l AS (SELECT record_id, sqrt(sum(n * n)) AS len FROM n GROUP BY record_id),
 d AS (SELECT anchor_id, record_id, ordinal, sum(n * CAST(embedding[CAST(place AS INT) + 1] AS DOUBLE)) AS d FROM seen JOIN n USING (record_id) GROUP BY ALL),
 sim AS (SELECT s.anchor_id, s.record_id, s.ordinal, CASE WHEN anchor_emotion = emotion THEN 1.0 ELSE 0.72 END AS emotion_score,
  CASE WHEN len IS NULL THEN 0.0 ELSE round(greatest(0, least(1, (d / (len * sqrt({S.dot('embedding', 'embedding')})) + 1) / 2)), 9) END AS similarity
  FROM seen s LEFT JOIN d USING (anchor_id, record_id, ordinal) LEFT JOIN l USING (record_id))
SELECT anchor_id, record_id, round(similarity, 4) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY similarity DESC, emotion_score DESC, ordinal) AS rank FROM sim) WHERE rank <= 8""")
def q_text_candidates(spark, sf_dir):
    """For every image record, the eight most similar of a strided sample of 24 texts of related emotions."""
    _, a, t = _anchors_and_texts(spark, sf_dir)
    c = align.candidates(a.select("anchor_id", "anchor_emotion", "anchor_vec"), t, "record_id", "vec", "text")
    return c.select("anchor_id", "record_id", F.round("similarity", 4).alias("similarity"), F.col("rank"))


def _vectors_by_slot(spark, sf_dir, rows, slot, name: str):
    """``rows`` with a stand-in vector of the table of vectors, by a number taken from the row."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("_slot"), V.doubles("embedding").alias(name))
    return rows.withColumn("_slot", slot % e.count()).join(v, "_slot").drop("_slot")


@query("q_aligned_tuples")
def q_aligned_tuples(spark, sf_dir):
    """Image records aligned with a text and, where there are any, a sound and a reference image: scores fused, thresholds applied.

    The sound is the best of its looked-at pool by .7 of the emotion score and .3 of its similarity to the image; image and sound,
    and text and sound, agree by the unit cosine of their vectors (0 without a sound).
    """
    e = table(spark, sf_dir, "embeddings")
    return _aligned_by_groups(spark, sf_dir, e) if e.count() <= align.SHARED_VECTORS else _aligned_by_rows(spark, sf_dir)


def _aligned_by_groups(spark, sf_dir, e):
    """The tuples where the stand-in vectors are few enough to be sent to all workers: rows carry a vector's number only."""
    ws, s = Workspace(spark, "align"), samples(spark, sf_dir)
    stored = e.select("vec_id", V.doubles("embedding").alias("v")).orderBy("vec_id").toPandas()
    n, have = len(stored), stored["vec_id"].tolist()
    if not n or stored["v"].isna().any() or len(set(map(len, stored["v"]))) > 1 or len(stored["v"][0]) != 64 or have != list(range(have[0], have[0] + n)):
        return _aligned_by_rows(spark, sf_dir)  # vectors of several sizes, or numbers with gaps
    shared, first = np.stack(stored["v"].to_numpy()), have[0]
    kind = F.col("unified_emotion").isin(*TAXONOMY)
    slot = lambda c: (c % n - first).cast("int")
    a = s.where("image_path IS NOT NULL").where(kind).where(F.col("record_id") % n >= first).select(
        F.col("record_id").alias("anchor_id"), F.col("unified_emotion").alias("anchor_emotion"), slot(F.col("record_id")).alias("anchor_slot"), "sample_id", "split", "identity_id", "dataset_source")
    a = ws.write(a, "anchors")
    slim = a.select("anchor_id", "anchor_emotion", "anchor_slot")
    t = s.where("text IS NOT NULL").select("record_id", F.col("sample_id").alias("text_id"), "dataset_source", "unified_emotion", align.token_places("text").alias("places"))
    text = align.picked(slim, t, "record_id", shared, "text", lambda e, x, a, p, i: e * 0.8 + x * 0.2, ["text_id", "places"])
    text = text.select("anchor_id", "text_id", "places", F.col("emotion_score").alias("text_emotion"), F.col("similarity").alias("clip"))
    heard = F.col("record_id") * 7 + 3
    sounds = s.where("audio_path IS NOT NULL").where(heard % n >= first).select("record_id", "dataset_source", "unified_emotion", F.col("sample_id").alias("audio_id"), slot(heard).alias("slot"))
    audio = align.picked(slim, sounds, "record_id", shared, "audio", lambda e, x, a, p, i: e * 0.7 + x * 0.3, ["audio_id", "slot"])
    audio = audio.select("anchor_id", "audio_id", F.col("slot").alias("audio_slot"), F.col("emotion_score").alias("audio_emotion"), F.col("similarity").alias("imagebind"))
    pool = a.select(F.col("anchor_id").alias("record_id"), "dataset_source", F.col("anchor_emotion").alias("unified_emotion"), F.col("anchor_slot").alias("slot"), F.col("identity_id").alias("ref_identity"), F.col("sample_id").alias("ref_id"))

    def resemblance(e, x, a, p, i):
        ref, own, who, mine = p["ref_id"].to_numpy()[i], a["own_id"].to_numpy()[:, None], p["ref_identity"].to_numpy()[i], a["identity_id"].to_numpy()[:, None]
        there = p["ref_id"].notna().to_numpy()[i] & a["own_id"].notna().to_numpy()[:, None] & (ref != own)
        return np.where(there, np.where(a["identity_id"].notna().to_numpy()[:, None] & (who == mine), 1.0, x), np.nan)

    ref = align.picked(a.select("anchor_id", "anchor_emotion", "anchor_slot", "identity_id", F.col("sample_id").alias("own_id")), pool, "record_id", shared, "ref", resemblance, ["ref_id", "ref_identity"], related=False)
    ref = ref.select("anchor_id", "ref_id", F.col("composite").alias("identity_similarity"))
    vectors = F.broadcast(e.select((F.col("vec_id") - first).cast("int").alias("audio_slot"), V.doubles("embedding").alias("_v")))
    unit = lambda v: V.let(v, lambda x: F.when(V.norm(x) > 0, V.normalised(x)))
    counts = V.let(F.transform(F.split("places", ""), lambda ch: F.ascii(ch) - 48), lambda p: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.size(F.filter(p, lambda q: q == k)).cast("double")))
    j = a.join(text, "anchor_id").join(audio, "anchor_id", "left").join(vectors, "audio_slot", "left").join(ref, "anchor_id", "left")
    return _tuples(j.withColumn("text_vec", unit(V.normalised(counts))).withColumn("audio_vec", unit(F.col("_v"))))


def _aligned_by_rows(spark, sf_dir):
    """The tuples with vectors carried by the rows themselves."""
    ws, a, t = _anchors_and_texts(spark, sf_dir)
    slim = a.select("anchor_id", "anchor_emotion", "anchor_vec")
    text = align.chosen(align.candidates(slim, t, "record_id", "vec", "text", keep="text_vec"), F.col("emotion_score") * 0.8 + F.col("similarity") * 0.2)
    text = text.select("anchor_id", F.col("sample_id").alias("text_id"), F.col("emotion_score").alias("text_emotion"), F.col("similarity").alias("clip"), "text_vec")
    s = samples(spark, sf_dir).where("audio_path IS NOT NULL").select("record_id", "dataset_source", "unified_emotion", F.col("sample_id").alias("audio_id"))
    sounds = ws.write(_vectors_by_slot(spark, sf_dir, s, F.col("record_id") * 7 + 3, "vec"), "sounds")
    audio = align.chosen(align.candidates(slim, sounds, "record_id", "vec", "audio", keep="audio_vec"), F.col("emotion_score") * 0.7 + F.col("similarity") * 0.3)
    audio = audio.select("anchor_id", "audio_id", F.col("emotion_score").alias("audio_emotion"), F.col("similarity").alias("imagebind"), "audio_vec")
    pool = a.select(F.col("anchor_id").alias("record_id"), "dataset_source", F.col("anchor_emotion").alias("unified_emotion"), F.col("anchor_vec").alias("vec"), F.col("identity_id").alias("ref_identity"), F.col("sample_id").alias("ref_id"))
    own = a.select("anchor_id", "identity_id", F.col("sample_id").alias("own_id"))
    ref = align.candidates(slim, pool, "record_id", "vec", "ref", related=False).join(own, "anchor_id").where("ref_id <> own_id")
    ref = align.chosen(ref, F.when(F.col("identity_id") == F.col("ref_identity"), F.lit(1.0)).otherwise(F.col("similarity")))
    ref = ref.select("anchor_id", "ref_id", F.col("composite").alias("identity_similarity"))
    return _tuples(a.drop("anchor_vec").join(text, "anchor_id").join(audio, "anchor_id", "left").join(ref, "anchor_id", "left"))


def _tuples(j):
    feeling = F.when(F.col("audio_id").isNull(), F.col("text_emotion")).otherwise((F.col("text_emotion") + F.col("audio_emotion")) / 2)
    heard = F.when(F.col("text_vec").isNotNull() & F.col("audio_vec").isNotNull(), V.clamp01((V.dot("text_vec", "audio_vec") + 1) / 2)).otherwise(0.0)
    j = j.withColumn("emotion_score", feeling)
    fused = align.fused_score("emotion_score", F.coalesce("identity_similarity", F.lit(0.0)), "clip", F.coalesce("imagebind", F.lit(0.0)), heard)
    j = j.withColumn("final_score", F.round(fused, 6)).where(align.passes("final_score", "emotion_score", "identity_similarity", F.col("ref_id").isNotNull()))
    return j.select(align.tuple_id("sample_id", "text_id", "audio_id", "ref_id").alias("sample_id"), align.resolved_split("split", "sample_id").alias("split"), F.col("anchor_emotion").alias("unified_emotion"), "identity_id", "final_score")
