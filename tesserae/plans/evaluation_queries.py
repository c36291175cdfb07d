"""Queries of metrics, graphs, reports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import vectors as V
from tesserae.functions.labels import TAXONOMY, TRAJECTORY
from tesserae.operators import consistency, graphs, metrics, reporting
from tesserae.plans import sqltext as S
from tesserae.plans.catalog import query, table
from tesserae.plans.curation_queries import _NEAR
from tesserae.streaming import incremental

_PARSED = """parsed AS (SELECT *, row_number() OVER () AS rn, CASE WHEN regexp_full_match(trim(z_attr), '\\[\\s*-?[0-9.]+(\\s*,\\s*-?[0-9.]+)*\\s*\\]') THEN TRY_CAST(string_split(regexp_replace(trim(z_attr), '^\\[|\\]$', '', 'g'), ',') AS DOUBLE[]) END AS a,
 CASE WHEN regexp_full_match(trim(z_id), '\\[\\s*-?[0-9.]+(\\s*,\\s*-?[0-9.]+)*\\s*\\]') THEN TRY_CAST(string_split(regexp_replace(trim(z_id), '^\\[|\\]$', '', 'g'), ',') AS DOUBLE[]) END AS b FROM predictions)"""


def _predictions(spark, sf_dir):
    return table(spark, sf_dir, "predictions").withColumn("a", V.parse_vector("z_attr")).withColumn("b", V.parse_vector("z_id"))


@query("q_accuracy", "SELECT split, count(*) AS n, round(avg(CASE WHEN coalesce(target_emotion, '') <> '' AND coalesce(predicted_emotion, '') <> '' THEN CAST(lower(target_emotion) = lower(predicted_emotion) AS INT) END), 6) AS acc FROM predictions GROUP BY split")
def q_accuracy(spark, sf_dir):
    return metrics.accuracy(table(spark, sf_dir, "predictions"), ["split"]).withColumn("acc", F.round("acc", 6))


@query("q_disentanglement", f"""WITH {_PARSED}, k AS (SELECT least(min(len(a)), min(len(b))) AS k FROM parsed),
 v AS (SELECT split, coalesce(a[1:k], list_transform(range(k), lambda x: 0.0)) AS a, coalesce(b[1:k], list_transform(range(k), lambda x: 0.0)) AS b FROM parsed, k)
SELECT split, round(greatest(0, least(1, 1 - avg(abs({S.dot('a', 'b')} / ((sqrt({S.dot('a', 'a')}) + 1e-8) * (sqrt({S.dot('b', 'b')}) + 1e-8)))))), 6) AS lds FROM v GROUP BY split""")
def q_disentanglement(spark, sf_dir):
    return metrics.disentanglement(_predictions(spark, sf_dir), "a", "b", ["split"]).withColumn("lds", F.round("lds", 6))


_ORDER = "CASE lower(target_emotion) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TRAJECTORY.items()) + " ELSE 999 END"


def _step(x: str, y: str) -> str:
    return f"list_transform(list_zip({x}, {y}), lambda z: z[1] - z[2])"


@query("q_trajectory", f"""WITH {_PARSED}, k AS (SELECT least(min(len(a)), min(len(b))) AS k FROM parsed WHERE identity_id <> '' AND a IS NOT NULL AND b IS NOT NULL),
 o AS (SELECT identity_id, a[1:k] AS a, b[1:k] AS b, {_ORDER} AS o, generated_image_path AS g, CAST(a AS VARCHAR) AS t FROM parsed, k WHERE identity_id <> '' AND a IS NOT NULL AND b IS NOT NULL),
 l AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, lag(a, 2) OVER w AS ppa FROM o WINDOW w AS (PARTITION BY identity_id ORDER BY o, g, t)),
 s AS (SELECT CASE WHEN pa IS NOT NULL THEN {_step('a', 'pa')} END AS di, CASE WHEN pb IS NOT NULL THEN {_step('b', 'pb')} END AS df, CASE WHEN ppa IS NOT NULL THEN {_step('pa', 'ppa')} END AS pi FROM l),
 n AS (SELECT *, sqrt({S.dot('di', 'di')}) AS ndi, sqrt({S.dot('df', 'df')}) AS ndf, sqrt({S.dot('pi', 'pi')}) AS npi FROM s)
SELECT round(avg(CASE WHEN ndi > 1e-8 AND ndf > 1e-8 THEN ({S.dot('di', 'df')} / ((ndi + 1e-8) * (ndf + 1e-8)) + 1) / 2 END), 4) AS ts,
 round(avg(CASE WHEN ndi > 1e-8 AND npi > 1e-8 THEN (1 - {S.dot('pi', 'di')} / ((npi + 1e-8) * (ndi + 1e-8))) / 2 END), 4) AS gc FROM n""")
def q_trajectory(spark, sf_dir):
    """Smoothness and curvature of attribute vectors against identity vectors along each identity's predictions."""
    p = _predictions(spark, sf_dir).where("a IS NOT NULL AND b IS NOT NULL").withColumn("o", F.struct("generated_image_path", F.array_join("a", ",")))
    return metrics.trajectory(p, "identity_id", "target_emotion", "o", "a", "b").select(F.round("ts", 4).alias("ts"), F.round("gc", 4).alias("gc"))


@query("q_vector_silhouette", f"""WITH e AS (SELECT vec_id, label, embedding FROM embeddings), d AS (SELECT a.vec_id, a.label AS own, b.label AS other, avg(1 - {S.dot('a.embedding', 'b.embedding')} / (sqrt({S.dot('a.embedding', 'a.embedding')}) * sqrt({S.dot('b.embedding', 'b.embedding')}))) AS d
 FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL), s AS (SELECT vec_id, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM d GROUP BY vec_id)
SELECT round(greatest(0, avg((b - a) / greatest(a, b))), 6) AS silhouette, count(*) AS n FROM s""")
def q_vector_silhouette(spark, sf_dir):
    return metrics.silhouette(table(spark, sf_dir, "embeddings"), "embedding", "label").select(F.round("silhouette", 6).alias("silhouette"), "n")


@query("q_linear_probe")
def q_linear_probe(spark, sf_dir):
    return metrics.linear_probe(table(spark, sf_dir, "embeddings"), "embedding", "label", "vec_id")


@query("q_recall", f"""WITH r AS ({_NEAR}), q AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 50 = 0),
 m AS (SELECT q.query_id, min(rank) AS first FROM q LEFT JOIN (SELECT r.query_id, r.rank, e.label FROM r JOIN embeddings e ON e.vec_id = neighbour_id) x ON x.query_id = q.query_id AND x.label = q.label GROUP BY q.query_id)
SELECT k, count(*) AS n, round(avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM m, (VALUES (1), (5), (10)) t(k) GROUP BY k""")
def q_recall(spark, sf_dir):
    """Share of the stated queries with a row of their own label among the nearest 1, 5 and 10."""
    from tesserae.operators.blocking import nearest

    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0")
    near = nearest(q, e, "vec_id", "embedding", 10)
    hit = near.join(e.select(F.col("vec_id").alias("neighbour_id"), F.col("label").alias("found")), "neighbour_id").join(q.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    first = hit.where("found = label").groupBy("query_id").agg(F.min("rank").alias("rank_of_match"))
    every = q.select(F.col("vec_id").alias("query_id")).join(first, "query_id", "left")
    return metrics.recall_at(every, [1, 5, 10]).withColumn("recall", F.round("recall", 6))


# --- graphs --------------------------------------------------------------------------------------------------------

_KNN = f"""near AS (SELECT q.vec_id AS s, b.vec_id AS d, round({S.unit_cosine('q.embedding', 'b.embedding')}, 12) AS w FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id),
 top AS (SELECT s, d, w FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY w DESC, d) AS k FROM near) WHERE k <= 5),
 graph AS (SELECT src, dst, max(weight) AS weight FROM (SELECT s AS src, d AS dst, w AS weight FROM top UNION ALL SELECT d, s, w FROM top) WHERE weight > 0 GROUP BY src, dst)"""


@query("q_knn_graph", f"WITH {_KNN} SELECT src, dst, round(weight, 6) AS weight FROM graph")
def q_knn_graph(spark, sf_dir):
    return graphs.knn_graph(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5).withColumn("weight", F.round("weight", 6))


@query("q_knn_edges", f"WITH {_KNN} SELECT src, dst, round(weight, 6) AS weight FROM graph WHERE src < dst")
def q_knn_edges(spark, sf_dir):
    return graphs.edge_list(graphs.knn_graph(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)).withColumn("weight", F.round("weight", 6))


_PROTO = f"""proto AS (SELECT lower({S.trim('unified_emotion')}) AS name, avg(valence) AS v, avg(arousal) AS a FROM normalized_records
 WHERE lower({S.trim('unified_emotion')}) IN ({S.NAMES}) AND valence IS NOT NULL AND arousal IS NOT NULL GROUP BY 1)"""
_CLASS = f"""{_PROTO}, near AS (SELECT p.name AS s, q.name AS d, 1 / (1 + sqrt((p.v - q.v) * (p.v - q.v) + (p.a - q.a) * (p.a - q.a))) AS w FROM proto p JOIN proto q ON p.name <> q.name),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY w DESC, d) AS k FROM near) WHERE k <= 3),
 graph AS (SELECT src, dst, max(weight) AS weight FROM (SELECT s AS src, d AS dst, w AS weight FROM top UNION ALL SELECT d, s, w FROM top) GROUP BY src, dst)"""


def _class_graph(spark, sf_dir):
    r = table(spark, sf_dir, "normalized_records").where("valence IS NOT NULL AND arousal IS NOT NULL")
    p = r.groupBy(F.lower(F.trim("unified_emotion")).alias("name")).agg(F.avg("valence").alias("valence"), F.avg("arousal").alias("arousal"))
    return graphs.class_graph(p.where(F.col("name").isin(*TAXONOMY)))


@query("q_class_graph", f"WITH {_CLASS} SELECT src, dst, round(weight, 6) AS weight FROM graph")
def q_class_graph(spark, sf_dir):
    return _class_graph(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query("q_class_paths", f"""WITH RECURSIVE {_CLASS}, names AS (SELECT name FROM proto), walk(src, dst, len, hops) AS (
 SELECT name, name, 0.0::DOUBLE, 0 FROM names UNION ALL SELECT w.src, g.dst, w.len + 1 / (g.weight + 1e-6), w.hops + 1 FROM walk w JOIN graph g ON g.src = w.dst WHERE w.hops < 5),
 best AS (SELECT src, dst, min(len) AS len FROM walk GROUP BY src, dst), top AS (SELECT greatest(1, max(len)) AS t FROM best)
SELECT a.name AS src, b.name AS dst, round(coalesce(len / t, 1.0), 6) AS distance FROM names a CROSS JOIN names b LEFT JOIN best ON src = a.name AND dst = b.name CROSS JOIN top""".replace("top AS (SELECT * FROM (SELECT *, row_number", "near3 AS (SELECT * FROM (SELECT *, row_number").replace("FROM top UNION ALL SELECT d, s, w FROM top", "FROM near3 UNION ALL SELECT d, s, w FROM near3"))
def q_class_paths(spark, sf_dir):
    return graphs.shortest_paths(_class_graph(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query("q_class_graph_thinned", f"""WITH {_CLASS}, t2 AS (SELECT src AS s, dst AS d, weight AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM graph) WHERE k <= 2)
SELECT src, dst, round(max(weight), 6) AS weight FROM (SELECT s AS src, d AS dst, w AS weight FROM t2 UNION ALL SELECT d, s, w FROM t2) GROUP BY src, dst""")
def q_class_graph_thinned(spark, sf_dir):
    return graphs.thinned(_class_graph(spark, sf_dir), 2).withColumn("weight", F.round("weight", 6))


@query("q_class_graph_full", f"WITH {_CLASS} SELECT a.name AS src, b.name AS dst, round((SELECT quantile_cont(weight, 0.5) FROM graph), 6) AS weight FROM proto a JOIN proto b ON a.name <> b.name")
def q_class_graph_full(spark, sf_dir):
    g = _class_graph(spark, sf_dir)
    return graphs.fully_connected(g, g.select(F.col("src").alias("name")).distinct()).withColumn("weight", F.round("weight", 6))


@query("q_graph_facts", f"WITH {_KNN} SELECT count(DISTINCT src) AS n_vertices, count(*) FILTER (src < dst) AS n_edges, coalesce(bool_or(src = dst), false) AS has_loops FROM graph")
def q_graph_facts(spark, sf_dir):
    return graphs.graph_facts(graphs.knn_graph(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5))


@query("q_graph_perturbed")
def q_graph_perturbed(spark, sf_dir):
    """The class graph without a quarter of its edges."""
    return graphs.perturbed(_class_graph(spark, sf_dir), 0.25).withColumn("weight", F.round("weight", 6))


# --- reports -------------------------------------------------------------------------------------------------------

_RUNS = "runs AS (SELECT event_type AS method, CASE WHEN user_id % 2 = 0 THEN 'val' ELSE 'test' END AS split, user_id % 3 AS seed, avg(value) AS acc, count(*) AS num_samples FROM events GROUP BY ALL)"


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("method"), F.when(F.col("user_id") % 2 == 0, "val").otherwise("test").alias("split"), (F.col("user_id") % 3).alias("seed")).agg(
        F.avg("value").alias("acc"), F.count(F.lit(1)).alias("num_samples"))


@query("q_seed_aggregate", f"WITH {_RUNS} SELECT method, split, round(avg(acc), 6) AS acc_mean, round(stddev_pop(acc), 6) AS acc_std, count(acc) AS acc_n FROM runs GROUP BY method, split")
def q_seed_aggregate(spark, sf_dir):
    a = reporting.seed_aggregate(_runs(spark, sf_dir), ["acc"])
    return a.select("method", "split", F.round("acc_mean", 6).alias("acc_mean"), F.round("acc_std", 6).alias("acc_std"), "acc_n")


@query("q_wide_table", f"WITH {_RUNS} SELECT method, round(avg(acc) FILTER (split = 'val'), 6) AS val_acc, round(avg(acc) FILTER (split = 'test'), 6) AS test_acc FROM runs GROUP BY method")
def q_wide_table(spark, sf_dir):
    w = reporting.wide(_runs(spark, sf_dir), "method", "split", ["acc"])
    return w.select("method", F.round("val_acc", 6).alias("val_acc"), F.round("test_acc", 6).alias("test_acc"))


@query("q_missing_cells", f"""WITH {_RUNS} SELECT m.method, s.split, d.seed FROM (VALUES ('view'), ('click'), ('purchase'), ('absent')) m(method), (VALUES ('val'), ('test')) s(split), (VALUES (0), (1), (2), (3)) d(seed)
 WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.method = m.method AND r.split = s.split AND r.seed = d.seed)""")
def q_missing_cells(spark, sf_dir):
    plan = spark.createDataFrame(reporting.plan_grid(method=["view", "click", "purchase", "absent"], split=["val", "test"], seed=[0, 1, 2, 3]), "method string, split string, seed int")
    return reporting.missing(plan, _runs(spark, sf_dir).withColumn("seed", F.col("seed").cast("int")), ["method", "split", "seed"])


@query("q_report_table", f"""WITH {_RUNS}, a AS (SELECT method, avg(acc) AS m, stddev_pop(acc) AS s FROM runs GROUP BY method)
SELECT CASE method WHEN 'view' THEN 'Views' ELSE upper(method[1]) || method[2:] END AS method, printf('%.2f ± %.2f', m, s) AS acc FROM a""")
def q_report_table(spark, sf_dir):
    a = reporting.seed_aggregate(_runs(spark, sf_dir), ["acc"], ["method"])
    return a.select(reporting.display_name("method", {"view": "Views"}).alias("method"), reporting.mean_std("acc_mean", "acc_std", 2).alias("acc"))


@query("q_label_f1", """WITH p AS (SELECT lower(target_emotion) AS t, lower(predicted_emotion) AS g FROM predictions WHERE coalesce(target_emotion, '') <> '' AND coalesce(predicted_emotion, '') <> '')
SELECT t AS target, g AS predicted, count(*) AS n FROM p GROUP BY ALL""")
def q_label_f1(spark, sf_dir):
    """The confusion counts behind accuracy."""
    p = metrics.with_aliases(table(spark, sf_dir, "predictions")).select(F.lower("target_emotion").alias("target"), F.lower("predicted_emotion").alias("predicted"))
    return p.where("target <> '' AND predicted <> ''").groupBy("target", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query("q_seed_rows", f"""WITH {_RUNS}, k AS (SELECT *, CASE WHEN num_samples > 20 THEN 'ok' ELSE 'few' END AS status FROM runs)
SELECT method, split, array_to_string(list_sort(list(DISTINCT status)), ',') AS status, max(num_samples) AS num_samples, printf('%.3f ± %.3f', avg(acc), stddev_pop(acc)) AS acc FROM k GROUP BY method, split""")
def q_seed_rows(spark, sf_dir):
    """The seeds of a method and split in one row, with their statuses and the largest number of samples."""
    r = _runs(spark, sf_dir).withColumn("status", F.when(F.col("num_samples") > 20, "ok").otherwise("few"))
    return reporting.seed_rows(r, ["method", "split"], ["acc"])


@query("q_cross_dataset_table", f"""WITH {_RUNS} SELECT method AS name, round(avg(acc) FILTER (split = 'val'), 6) AS val, round(CAST(avg(num_samples) FILTER (split = 'test') AS DOUBLE), 6) AS test FROM runs GROUP BY method""")
def q_cross_dataset_table(spark, sf_dir):
    """One metric for one data set and another for the other, side by side (here the two halves of the events)."""
    r = _runs(spark, sf_dir).select(F.col("method").alias("name"), F.col("split").alias("dataset"), "acc", "num_samples")
    t = reporting.cross_dataset_table(r, {"val": "acc"}, "num_samples")
    return t.select("name", F.round("val", 6).alias("val"), F.round("test", 6).alias("test"))


@query("q_sensitivity_curve", f"WITH {_RUNS} SELECT method AS curve, seed AS x, round(avg(acc), 6) AS y FROM runs GROUP BY ALL")
def q_sensitivity_curve(spark, sf_dir):
    r = _runs(spark, sf_dir).groupBy("method", F.col("seed").alias("k")).agg(F.avg("acc").alias("acc_mean"))
    return reporting.sensitivity_curve(r, "Acc").withColumn("y", F.round("y", 6))


@query("q_top_labels", "SELECT raw_label, count(*) AS n FROM normalized_records WHERE raw_label IS NOT NULL GROUP BY 1 ORDER BY n DESC, raw_label LIMIT 5")
def q_top_labels(spark, sf_dir):
    return reporting.top_counts(table(spark, sf_dir, "normalized_records"), "raw_label")


# --- agreement of modalities ---------------------------------------------------------------------------------------

_COS = lambda x, y: f"({S.dot(x, y)} / ((sqrt({S.dot(x, x)}) + 1e-8) * (sqrt({S.dot(y, y)}) + 1e-8)))"


@query("q_agreement", f"""WITH {_PARSED}, v AS (SELECT split, a, b, list_reverse(a) AS c FROM parsed WHERE a IS NOT NULL AND b IS NOT NULL AND len(a) = len(b)),
 s AS (SELECT split, {_COS('b', 'a')} AS ti, {_COS('a', 'c')} AS ia, {_COS('b', 'c')} AS ta FROM v)
SELECT split, count(*) AS n, round(avg(ti), 6) AS clip, round(avg(0.5 * ti + 0.5 * ia), 6) AS ib, round(avg((ti + 1) / 2), 6) AS identity, CAST(NULL AS DOUBLE) AS human, round(avg((ti + ta + ia) / 3), 6) AS consistency FROM s GROUP BY split""")
def q_agreement(spark, sf_dir):
    """The agreement scores, with the two stored vectors for image and prompt and the first one reversed for the sound."""
    p = _predictions(spark, sf_dir).where("a IS NOT NULL AND b IS NOT NULL AND size(a) = size(b)").withColumn("c", F.reverse("a"))
    out = consistency.agreement(p, "b", "a", "c", "b", ["split"])
    return out.select("split", "n", *[F.round(c, 6).alias(c) for c in ("clip", "ib", "identity", "human", "consistency")])


@query("q_prompts", """SELECT CASE WHEN trim(coalesce(prompt, '')) <> '' THEN prompt ELSE 'a ' || coalesce(target_emotion, '') || ' face' END AS prompt, count(*) AS n FROM predictions GROUP BY 1""")
def q_prompts(spark, sf_dir):
    p = table(spark, sf_dir, "predictions").select(consistency.prompt_of("prompt", "target_emotion").alias("prompt"))
    return p.groupBy("prompt").agg(F.count(F.lit(1)).alias("n"))


@query("q_prepared_predictions", "SELECT sample_id FROM predictions WHERE split = 'test' ORDER BY sample_id LIMIT 200")
def q_prepared_predictions(spark, sf_dir):
    """The rows of one split up to a cap, by sample_id: the cap is the feature."""
    return consistency.prepared(table(spark, sf_dir, "predictions"), "test", 200).select("sample_id")


@query("q_stored_scores", "SELECT sample_id, " + ", ".join(f"alignment_scores.{k} AS {c}" for k, c in consistency.SCORE_COLUMNS.items()) + " FROM aligned_samples")
def q_stored_scores(spark, sf_dir):
    """Scores written as JSON and read again."""
    a = table(spark, sf_dir, "aligned_samples").select("sample_id", F.to_json("alignment_scores").alias("alignment_scores"))
    return consistency.with_stored_scores(a).drop("alignment_scores")


_SHIFTED = "list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + 0.25 * (i % 3))"


@query("q_retrieval", f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q, {_SHIFTED} AS t, list_reverse(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS s FROM embeddings),
 sims AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.q, b.t), 12) AS t, round(list_cosine_similarity(a.q, b.s), 12) AS s FROM e a JOIN e b ON a.vec_id % 50 = 0),
 gold AS (SELECT i, t AS gt, s AS gs FROM sims WHERE i = j),
 r AS (SELECT i, 1 + count(*) FILTER (t > gt OR (t = gt AND j < i)) AS t, 1 + count(*) FILTER (s > gs OR (s = gs AND j < i)) AS s FROM sims JOIN gold USING (i) GROUP BY i)
SELECT direction, k, count(*) AS n, round(avg(CASE WHEN CASE direction WHEN 'I2T' THEN t ELSE s END <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM r, (VALUES ('I2T'), ('I2A')) d(direction), (VALUES (1), (5)) c(k) GROUP BY direction, k""")
def q_retrieval(spark, sf_dir):
    """Recall of a stated query set (ids divisible by 50) against all rows, with stand-ins for the vectors of text and sound."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles("embedding").alias("image"))
    e = e.withColumn("text", F.transform("image", lambda x, i: x + 0.25 * ((i + 1) % 3))).withColumn("sound", F.reverse("image"))
    return consistency.retrieval_table(e.where("vec_id % 50 = 0"), e, "vec_id", "image", {"I2T": "text", "I2A": "sound"}).withColumn("recall", F.round("recall", 6))


@query("q_node_masks", """SELECT [1.0, CASE WHEN modality_mask.has_reference_image THEN 1.0 ELSE 0.0 END, 1.0, 1.0, 0.0]::DOUBLE[] AS mask, count(*) AS n FROM aligned_samples GROUP BY 1""")
def q_node_masks(spark, sf_dir):
    """How often each node mask of the modality graph occurs where sounds are switched off."""
    m = graphs.node_mask("modality_mask.has_reference_image", "modality_mask.has_audio", ["no_audio"])
    return table(spark, sf_dir, "aligned_samples").select(m.alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


# --- arriving records ----------------------------------------------------------------------------------------------

@query("q_arrivals", f"""SELECT make_timestamp(604800000000 * (epoch_us(ingested_at) // 604800000000)) AS start, source_dataset, {S.SPLIT} AS split, count(*) AS n FROM normalized_records
 WHERE ingested_at IS NOT NULL GROUP BY ALL""")
def q_arrivals(spark, sf_dir):
    """Records per week of arrival, source and split; the same function serves a stream."""
    return incremental.arrivals(table(spark, sf_dir, "normalized_records"))


@query("q_incremental_leakage", f"""WITH {S.SAMPLES} SELECT identity_id AS key, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test
 FROM samples WHERE identity_id IS NOT NULL AND split IS NOT NULL GROUP BY identity_id HAVING count(DISTINCT split) > 1""")
def q_incremental_leakage(spark, sf_dir):
    """Leaking identities from states that add up over batches of arrival (here by quarter)."""
    r = table(spark, sf_dir, "normalized_records")
    part = F.coalesce(F.quarter("ingested_at"), F.lit(0))
    return incremental.leaking(incremental.merged(*[incremental.key_states(r.where(part == q)) for q in range(5)]))
