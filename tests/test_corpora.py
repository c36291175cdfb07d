"""Readers of corpora whose labels, transcripts and media stand in separate files, and the agreement of modalities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import consistency, export, graphs, leakage, reporting
from tesserae.operators.align import quality
from tesserae.operators.skew import in_order
from tesserae.sources import corpora, media
from tesserae.workspace import Workspace


def touch(root, *names):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")


def test_labels_beside_images(spark, tmp_path):
    touch(tmp_path, "a/1.png", "Train/a/2.png", "Test/a/2.png", "Test/3.jpg")
    labels = spark.createDataFrame([("a/1.png", "1"), ("a/2.png", "2"), ("3.jpg", "happy"), ("gone.png", "0"), (None, "0")], "pth string, label string")
    files = media.listing(spark, str(tmp_path))
    got = {r.sample_id: (r.split, r.unified_emotion, r.image_path) for r in corpora.folder_labelled(labels, files, str(tmp_path)).collect()}
    assert got == {"1": (None, "happy", f"{tmp_path}/a/1.png"), "2": ("train", "sad", f"{tmp_path}/Train/a/2.png"), "3": ("test", "happy", f"{tmp_path}/Test/3.jpg")}
    rows = corpora.first_found(labels, [(F.col("pth"), None)], files, str(tmp_path))
    assert corpora.unresolved(rows) == 4
    assert corpora.folder_labelled(labels.limit(0), files, str(tmp_path)).count() == 0


def test_labels_by_split(spark, tmp_path):
    touch(tmp_path, "DATASET/train/4/x.jpg", "DATASET/train/y.jpg", "DATASET/z.jpg", "w.jpg", "DATASET/test/5/x.jpg")
    train = spark.createDataFrame([("x.jpg", "4"), ("y.jpg", "5"), ("z.jpg", "7"), ("w.jpg", "9"), ("none.jpg", "1")], "image string, label string")
    test = spark.createDataFrame([("x.jpg", "5")], "image string, label string")
    got = {(r.split, r.sample_id): (r.unified_emotion, r.image_path[len(str(tmp_path)):]) for r in corpora.split_labelled(train, test, media.listing(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert got == {
        ("train", "x"): ("happy", "/DATASET/train/4/x.jpg"), ("train", "y"): ("sad", "/DATASET/train/y.jpg"), ("train", "z"): ("neutral", "/DATASET/z.jpg"),
        ("train", "w"): (None, "/w.jpg"), ("test", "x"): ("sad", "/DATASET/test/5/x.jpg")}


def test_dialogues_with_transcripts(spark, tmp_path):
    touch(tmp_path, "wav/Ses01F_impro01_F000.wav", "wav/Ses01F_impro01_M001.wav", "wav/Ses01F_impro01_F003.wav")
    lines = ["% header", "[6.29 - 8.23]\tSes01F_impro01_F000\tNEU\t[2.5000, 2.5000, 2.5000]", "[10.0 - 11.3] Ses01F_impro01_M001 exc [4.0, 3.5, 3.0]",
             "[12.0 - 13.0] Ses01F_impro01_F002 ang [2.0, 3.5, 3.0]", "[12.0 - 13.0] Ses01F_impro01_F003 xxx [2.0, 3.5, 3.0]", "[1 - 2] Ses01F_impro01_F003 oth [1, 2, 3]"]
    said = ["Ses01F_impro01_F000 [006.29-008.23]: Excuse me.", "noise", "Ses01F_impro01_M001 no bracket"]
    texts = corpora.transcripts(spark.createDataFrame([(x,) for x in said], "value string"))
    rows = corpora.dialogues(spark.createDataFrame([(x,) for x in lines], "value string"), texts, media.listing(spark, str(tmp_path), media.SOUNDS), "Session1").collect()
    got = {r.sample_id: (r.raw_label, r.unified_emotion, r.text, r.speaker_id, r.valence, r.arousal) for r in rows}
    assert got == {
        "Ses01F_impro01_F000": ("neu", "neutral", "Excuse me.", "Session1_F", 2.5, 2.5), "Ses01F_impro01_M001": ("exc", "happy", None, "Session1_M", 4.0, 3.5)}


def test_rated_texts_and_sources_without_records(spark):
    rows = spark.createDataFrame([("t1", "dev", "2.0", "3.5", " Oh no. "), ("t2", "train", "3.0", "3.0", "Well."), ("t3", "x", "4", None, None)], "id string, split string, V string, A string, text string")
    got = {r.sample_id: (r.split, r.unified_emotion, r.text, r.raw_text) for r in corpora.affect_rated(rows).collect()}
    assert got == {"t1": ("val", "angry", "Oh no.", " Oh no. "), "t2": ("train", "neutral", "Well.", "Well."), "t3": (None, None, None, None)}
    none = corpora.no_records(spark)
    assert none.count() == 0 and none.columns == corpora.affect_rated(rows).columns


def test_prompts_and_stored_scores(spark):
    df = spark.createDataFrame([("smile", "happy", '{"final_score": 0.5, "clip_similarity": "x"}'), (" ", "sad", "{broken"), (None, None, None)], "prompt string, e string, alignment_scores string")
    assert [r.p for r in df.select(consistency.prompt_of("prompt", "e").alias("p")).collect()] == ["smile", "a sad face", "a  face"]
    got = consistency.with_stored_scores(df.withColumn("alignment_final_score", F.lit(9.0)))
    assert [(r.alignment_final_score, r.alignment_clip_similarity) for r in got.collect()] == [(9.0, None)] * 3
    assert [r.alignment_final_score for r in consistency.with_stored_scores(df).collect()] == [0.5, None, None]


def test_agreement_takes_the_first_human_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 1.0], "3"), ([1.0, 0.0], [0.0, 1.0], None, "nan")], "p array<double>, i array<double>, a array<double>, preference_score string")
    r = consistency.agreement(df, "p", "i", "a", "p").first()
    assert (r.n, r.human) == (2, 3.0) and r.clip == pytest.approx(0.5, abs=1e-6) and r.ib == pytest.approx(0.5, abs=1e-6) and r.identity == pytest.approx(0.75, abs=1e-6) and r.consistency == pytest.approx(1 / 3, abs=1e-6)
    assert consistency.agreement(df.limit(0), "p", "i", "a").first().clip is None


@pytest.mark.parametrize("block", [4096, 3])
def test_ranks_of_matches_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(consistency, "QUERY_BLOCK", block)
    rng = np.random.default_rng(0)
    q, b = rng.normal(size=(25, 4)), rng.normal(size=(25, 4))
    b[7] = b[6]
    df = spark.createDataFrame([(i, q[i].tolist(), b[i].tolist()) for i in range(25)] + [(30, None, [1.0] * 4), (31, [1.0] * 4, None)], "id long, q array<double>, b array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = (unit(q) @ unit(np.vstack([b, np.ones((1, 4))])).T).round(12)
    ids = [*range(25), 30]
    want = {i: 1 + sum((sim[i, k] > sim[i, i]) or (sim[i, k] == sim[i, i] and j < i) for k, j in enumerate(ids)) for i in range(25)} | {30: None, 31: None}
    assert {r.query_id: r["rank"] for r in consistency.match_ranks(df, df.repartition(5), "id", "q", "b").collect()} == want


def test_report_rows(spark):
    rows = spark.createDataFrame([("b", "ok", 3, 0.5, "MAIN"), ("a", "ok", 5, 0.25, "main_table"), ("b", "few", 4, 1.5, "other"), ("a", "ok", None, None, None)], "name string, status string, num_samples long, acc double, section string").withColumn("at", F.monotonically_increasing_id())
    got = reporting.seed_rows(rows, ["name"], ["acc"], order="at").collect()
    assert [tuple(r) for r in got] == [("b", "few,ok", 4, "1.000 ± 0.500"), ("a", "ok", 5, "0.250 ± 0.000")]
    assert reporting.section_rows(rows, "main_results").count() == 2 and reporting.section_rows(rows.drop("section"), "main_results").count() == 4
    curve = reporting.sensitivity_curve(rows.select(F.col("num_samples").alias("k"), F.col("acc").alias("acc_mean"), F.col("name").alias("method")), "ACC")
    assert [tuple(r) for r in curve.collect()] == [("a", None, None), ("a", 5, 0.25), ("b", 3, 0.5), ("b", 4, 1.5)]
    with pytest.raises(KeyError):
        reporting.sensitivity_curve(rows, "acc")
    assert [tuple(r) for r in reporting.top_counts(rows, "name", 1).collect()] == [("a", 2)]


def test_cross_dataset_table(spark):
    rows = spark.createDataFrame([("m", "one", 0.5, 9.0), ("m", "two", 9.0, 0.25), ("n", "two", 9.0, 0.75)], "name string, dataset string, acc double, id double")
    assert {tuple(r) for r in reporting.cross_dataset_table(rows, {"one": "acc"}, "id").collect()} == {("m", 0.5, 0.25), ("n", None, 0.75)}


def test_node_masks(spark):
    df = spark.createDataFrame([(True, True), (False, None)], "r boolean, a boolean")
    mask = lambda *x: [r.m for r in df.select(graphs.node_mask("r", "a", x).alias("m")).collect()]
    assert mask() == [[1.0] * 5, [1.0, 0.0, 1.0, 1.0, 0.0]] and mask("text_only") == [[1.0, 0.0, 0.0, 0.0, 0.0]] * 2 and mask("image_text")[0] == [1.0, 1.0, 0.0, 1.0, 0.0]
    assert set(graphs.ABLATIONS) == {"no_identity_branch", "no_audio", "text_only", "image_text", "text_audio"}


def test_checks_that_run_and_combined_shares(spark):
    assert leakage.selected_checks() == ["identity", "speaker", "duplicates", "cross_modal", "cross_dataset"]
    assert leakage.selected_checks(duplicates=True) == ["duplicates", "cross_dataset"] and leakage.selected_checks(speaker=False) == ["identity", "duplicates", "cross_dataset"]
    with pytest.raises(ValueError):
        leakage.selected_checks(colour=True)
    one = lambda n, p: spark.createDataFrame([(n, p)], "n_rows long, percent double")
    assert tuple(leakage.combined_share(one(3, 1.5), one(5, 1.0)).first()) == (5, 1.5)


def test_quality_names_and_places(spark):
    df = spark.createDataFrame([(0.8, True, None), (0.8, None, True), (None, True, True), (0.6, True, True)], "s double, has_audio boolean, has_text boolean").select(
        F.struct(F.col("s").alias("final_score")).alias("alignment_scores"), F.struct("has_audio", "has_text").alias("modality_mask"))
    assert quality(df, 0.7).count() == 2 and quality(df, 0.7, ("audio",)).count() == 1 and quality(df, 0.5, ("audio", "text")).count() == 1
    g = spark.createDataFrame([(k,) for k in ("b", "a", None, "c", "a")], "g string")
    assert {tuple(r) for r in export.numbered_groups(g, "g").collect()} == {("a", "group_000001"), ("b", "group_000002"), ("c", "group_000003")}
    assert export.without_transient(g.withColumn("_x", F.lit(1))).columns == ["g"] and [r.g for r in export.examples(g, [F.desc_nulls_last("g")], 2).collect()] == ["c", "b"]
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"), (F.col("id") % 3).alias("g")).repartition(5)
    placed = in_order(rows, ["g", "v"], Workspace(spark, "t")).collect()
    assert [(r.g, r.v) for r in sorted(placed, key=lambda r: r.place)] == sorted((r.g, r.v) for r in placed) and sorted(r.place for r in placed) == list(range(1000))
    assert in_order(rows.limit(0), ["g", "v"], Workspace(spark, "t")).count() == 0
