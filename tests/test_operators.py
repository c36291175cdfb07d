"""Behaviour of the operators on small tables worked out by hand."""

import itertools
import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import align, blocking, eager, export, graphs, leakage, metrics, normalize, reporting, skew, splits
from tesserae.operators.components import component_statistics, connected_components, star_edges
from tesserae.sources import manifests, media
from tesserae.streaming import incremental


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (110, 2))] + [(i, i + 1) for i in range(200, 240)] + [(300, k) for k in range(301, 330)] + [(5, 5), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "left long, right long"))
    assert dict(rows(got)) == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "left long, right long")).count() == 0


def test_component_statistics(spark):
    s = component_statistics(spark.createDataFrame([(1, 5), (2, 3), (3, 1), (4, 1)], "component long, size long")).first()
    assert (s.n_groups, s.n_rows, s.largest, s.largest_share, s.middle_size, s.over_size, s.over_share) == (4, 10, 5, 0.5, 1, 0, 1)


def test_groups_of_linked_records(spark, records):
    base = dict(source_dataset="a", unified_emotion="happy", split="train")
    r = records(dict(base, record_id=1, sample_id="s1", identity_id="id1", speaker_id="sp1", text="same text"),
                dict(base, record_id=2, sample_id="s2", identity_id="id1", speaker_id="sp1", text="same text"),
                dict(base, record_id=3, sample_id="s3", text="different"))
    s = normalize.samples(r)
    edges = splits.hard_edges(s)
    assert rows(edges.groupBy("rule").count()) == [("identity_id", 1), ("speaker_id", 1)]
    sizes = splits.grouped(s, edges).groupBy("group_id").count()
    assert rows(sizes) == [(1, 2), (3, 1)]


def test_audio_fan_out_is_refused(spark, records):
    r = records(*[dict(record_id=i, sample_id=f"s{i}", source_dataset="a", audio_path="x.wav", identity_id=f"i{i}", text=f"text {i}", unified_emotion="sad") for i in range(3)])
    p = splits.Policy(audio_rows=2, audio_identities=1, audio_texts=1)
    s = normalize.samples(r)
    b = splits.audio_buckets(s, p).first()
    assert (b.n_rows, b.refusal) == (3, "group_size")
    assert splits.hard_edges(s, p).where("rule = 'audio_hash'").count() == 0


def test_reserved_assignment_of_ten_singles(spark):
    g = spark.createDataFrame([(i, 1, 0, 1) for i in range(10)], "group_id long, size long, n_splits long, n_sources long")
    got = rows(splits.assign_reserved(g).groupBy("split").count())
    assert got == [("test", 2), ("train", 6), ("val", 2)]


def test_balanced_assignment_keeps_all_groups(spark, records):
    r = records(*[dict(record_id=i, sample_id=f"s{i}", source_dataset="ab"[i % 2], unified_emotion=("happy", "sad")[i % 2], identity_id=f"i{i % 20}", text="t") for i in range(60)])
    s = normalize.samples(r)
    g = splits.group_table(splits.grouped(s, splits.hard_edges(s)))
    a = splits.assign_balanced(g)
    assert a.count() == g.count() and {x.split for x in a.collect()} == {"train", "val", "test"}


def test_soft_conflicts_and_repair(spark, records):
    base = dict(source_dataset="a", unified_emotion="happy", text="one and the same text")
    r = records(dict(base, record_id=1, sample_id="a", identity_id="g1", split="train"), dict(base, record_id=2, sample_id="b", identity_id="g1", split="train"),
                dict(base, record_id=3, sample_id="c", identity_id="g2", split="val"))
    m = leakage.content_keys(normalize.samples(r)).withColumn("group_id", F.col("identity_id"))
    c = splits.soft_conflicts(m)
    assert rows(c.select("kind", "group_id", "split", "other_split", "n")) == [("text_duplicate", "g1", "train", "val", 1), ("text_duplicate", "g2", "val", "train", 1)]
    fixed = splits.repair(m, splits.Policy(deviation=5.0))
    assert leakage.leaking_keys(fixed, "text_key").count() == 0


def test_near_images_faces_and_audio_are_warned_of_repaired_and_validated(spark):
    v = [0.5, -0.2, 0.1, 0.4, 0.3, -0.6, 0.2, 0.1]
    near = [0.5, -0.2, 0.1, 0.4, 0.3, -0.6, 0.2, 0.11]
    far = [-x for x in v]
    m = spark.createDataFrame([
        (1, "g1", "train", "a", "ffffffffffffff00", None, v, v), (2, "g2", "val", "b", "ffffffffffffff01", None, near, near), (3, "g3", "test", "b", "0000000000000000", None, far, far),
        (4, "g4", "train", "a", "1234560000000000", v, None, None), (5, "g5", "test", "a", "1234560000000001", near, None, None)],
        "record_id long, group_id string, split string, dataset_source string, image_hash string, image_vector array<double>, face_vector array<double>, audio_vector array<double>").selectExpr(
        "*", "CAST(NULL AS string) AS text_key", "CAST(NULL AS string) AS audio_path", "CAST(NULL AS string) AS identity_id", "CAST(NULL AS string) AS speaker_id", "CAST(NULL AS string) AS image_path", "CAST(NULL AS string) AS text")
    got = rows(splits.soft_conflicts(m).where("group_id IN ('g1', 'g4')").select("kind", "group_id", "other_split", "n"))
    assert got == [("audio_similarity", "g1", "val", 1), ("cross_dataset_similarity", "g1", "val", 1), ("face_similarity", "g1", "val", 1), ("face_similarity", "g4", "test", 1),
                   ("image_similarity", "g1", "val", 1), ("image_similarity", "g4", "test", 1), ("proxy_identity_cluster", "g1", "val", 1), ("proxy_speaker_cluster", "g1", "val", 1)]
    comps = splits.repair_components(m, pairs=splits.near_pairs(m))
    assert rows(comps) == [("g1", "cross_dataset_similarity", "g1"), ("g1", "image_similarity", "g1"), ("g2", "cross_dataset_similarity", "g1"),
                           ("g2", "image_similarity", "g1"), ("g4", "image_similarity", "g4"), ("g5", "image_similarity", "g4")]
    found = {x.check: x.n for x in splits.validation(m).collect()}
    assert found["near_duplicate_overlap"] == 2 and found["cross_dataset_overlap"] == 1
    fixed = splits.repair(m, splits.Policy(deviation=5.0))
    assert splits.soft_conflicts(fixed).count() == 0 and fixed.where("group_id = 'g3'").count() == 1


def test_leakage_checks(spark, records):
    base = dict(image_path="i.jpg", audio_path="a.wav", text="same words", identity_id="id", speaker_id="sp", unified_emotion="happy")
    r = records(dict(base, record_id=1, sample_id="x", split="train", source_dataset="a"), dict(base, record_id=2, sample_id="y", split="test", source_dataset="b"),
                dict(record_id=3, sample_id="z", split="val", source_dataset="a", text="else", unified_emotion="sad"))
    s = leakage.content_keys(normalize.samples(r))
    got = {x.check: (x.n_keys, x.n_rows) for x in leakage.affected(s, {"identity": "identity_id", "speaker": "speaker_id", "audio": "audio_path", "text": "text_key"}).collect()}
    assert got == dict.fromkeys(("identity", "speaker", "audio", "text"), (1, 2))
    assert rows(leakage.cross_dataset(s, "text_key")) == [("a", "b", 1)]
    assert leakage.cross_modal(s).count() == 4
    assert leakage.affected(s.limit(0), {"identity": "identity_id"}).first().percent == 0.0


def test_near_contents_of_two_sources_are_overlap(spark, records):
    r = records(*[dict(record_id=i, sample_id=f"s{i}", split=sp, source_dataset=d, unified_emotion="happy", text=t) for i, sp, d, t in (
        (1, "train", "a", "the small boat came home before the storm"), (2, "test", "b", "the small boat came home before the storms"),
        (3, "train", "a", "something else"), (4, "val", "c", "something else"), (5, "train", "a", "alone"), (6, "val", "c", None))])
    v = [0.5, -0.2, 0.1, 0.4, 0.3, -0.6, 0.2, 0.1]
    media = spark.createDataFrame([(5, "ffffffffffffff00", v), (6, "ffffffffffffff0f", [2 * x for x in v]), (3, None, [-x for x in v])], "record_id long, image_hash string, audio_vector array<double>")
    s = leakage.content_keys(normalize.samples(r)).join(media, "record_id", "left")
    m = leakage.near_matches(s)
    assert rows(m) == [("audio_near", 5, 6), ("image_near", 5, 6), ("text_near", 1, 2)]
    assert rows(leakage.cross_dataset_matches(s, m)) == [("a", "b", 1), ("a", "c", 2)]
    assert rows(leakage.match_summary(s, m).select("check", "n_keys", "n_rows")) == [("audio_near", 1, 2), ("image_near", 1, 2), ("text_near", 1, 2)]


def test_remediation_moves_to_the_majority_and_train_wins_ties(spark, records):
    r = records(dict(record_id=1, sample_id="a", split="train", identity_id="id1", speaker_id="sp1"), dict(record_id=2, sample_id="b", split="test", identity_id="id1", speaker_id="sp1"),
                dict(record_id=3, sample_id="c", split="val", identity_id="id2"))
    s = normalize.samples(r)
    moves = leakage.remediation(s)
    assert rows(moves) == [(2, "test", "train", 2)]
    assert rows(leakage.split_counts(leakage.apply_moves(s, moves))) == [("train", 2), ("val", 1)]


def test_bounded_and_whole_blocks(spark):
    n = 9
    df = spark.createDataFrame([(1, i, "ab"[i % 2]) for i in range(n)], "b int, id long, s string")
    every = blocking.blocked_pairs(df, ["b"], "id", ["s"], lambda a, b: F.lit(True))
    assert every.count() == n * (n - 1) // 2
    cross = blocking.blocked_pairs(df, ["b"], "id", ["s"], lambda a, b: F.lit(True), different=["s"])
    assert cross.count() == 20
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    some = blocking.blocked_pairs(df, ["b"], "id", ["s"], lambda a, b: F.lit(True), max_rows=4, max_visits=5)
    assert rows(some.select("left_id", "right_id")) == pairs[:5]


def test_leader_clusters(spark):
    v = [("k", 1, [1.0, 0.0]), ("k", 2, [0.99, 0.01]), ("k", 3, [0.0, 1.0]), ("k", 4, None), ("j", 5, [0.0, 0.0])]
    got = blocking.leader_clusters(spark.createDataFrame(v, "b string, id long, v array<double>"), "b", "id", "v", 0.95)
    assert rows(got) == [(1, 1), (2, 1), (3, 3), (5, 5)]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    got = blocking.nearest(df.where("id < 7"), df, "id", "v", 4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(7):
        s = u @ u[q]
        s[q] = -9
        assert [r.neighbour_id for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == np.argsort(-s)[:4].tolist()
    assert blocking.nearest(df.limit(0), df, "id", "v", 4).count() == 0


def test_fuzzy_ratio(spark):
    df = spark.createDataFrame([("The map.", "the map"), ("abcd", "bcde"), (None, "a")], "a string, b string")
    assert [round(r.ratio, 3) for r in blocking.with_ratio(df, "a", "b").collect()] == [1.0, 0.75, 0.0]


def test_close_lines_are_those_of_all_pairs(spark, monkeypatch):
    from tesserae.functions import vectors as V

    rng = np.random.default_rng(5)
    words_ = ["red", "boat", "storm", "quiet", "evening", "rain", "o'clock", "7", "harbour", "came"]
    base = [" ".join(rng.choice(words_, 40 if k % 2 else 12)) for k in range(6)]
    lines = [" ".join(w if rng.random() > 0.04 else rng.choice(words_) for w in base[k % 6].split(" ")) for k in range(60)]
    df = spark.createDataFrame([(k // 40, 100 - k, x, "ab"[k % 2]) for k, x in enumerate(lines)] + [(None, 200, "x", "a"), (1, 201, "x", "a")], "b long, id long, line string, split string")
    sim = lambda a, b: V.clamp01((V.dot(a, b) + 1) / 2)
    every = blocking.blocked_pairs(df.withColumn("v", V.token_vector("line")), ["b"], "id", ["v", "line"], lambda a, b: F.lit(True))
    want = blocking.with_ratio(every.withColumn("similarity", sim("left_v", "right_v")), "left_line", "right_line").where("similarity >= 0.96 OR ratio >= 0.9")
    want = rows(want.select("left_id", "right_id", "similarity", "ratio"))
    for block_rows in (4_096, 7):
        monkeypatch.setattr(blocking, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(blocking, "_TILE", 16)
        assert rows(blocking.close_lines(df, ["b"], "id", "line", 0.96, 0.9)) == want
    got = rows(blocking.close_lines(df, ["b"], "id", "line", 0.96, 0.9, different="split", both=True).where("there").select("left_id", "right_id"))
    of = {r.id: r.split for r in df.collect()}
    assert len(want) > 50 and got == [x[:2] for x in want if of[x[0]] != of[x[1]]]


def test_large_blocks_of_lines_end_soon(spark):
    import time

    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    lines = [" ".join("".join(rng.choice(letters, 6)) for _ in range(30)) for _ in range(1500)]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "b long, id long, line string")
    began = time.time()
    assert blocking.close_lines(df, ["b"], "id", "line", 0.96, 0.97).count() == 0
    assert time.time() - began < 60  # a million ratios of 209 characters took many minutes


def test_copies_of_texts_are_counted_without_pairs_of_rows(spark, records):
    many = [dict(record_id=i, sample_id=f"s{i}", split=("train", "test")[i % 2], source_dataset=("a", "b", "c")[i % 3], unified_emotion="happy", text="one form of consent") for i in range(3000)]
    near = [dict(record_id=9000 + i, sample_id=f"n{i}", split=("train", "val")[i % 2], source_dataset=("a", "b")[i % 2], unified_emotion="sad",
                 text=("the small boat came home before the storm", "the small boat came home before the storms")[i % 2]) for i in range(10)]
    s = leakage.content_keys(normalize.samples(records(*many, *near)))
    m = leakage.near_matches(s)
    assert m.count() == 25
    # an image match of two rows of one leaking text is the pair that the text gives already
    more = m.unionByName(spark.createDataFrame([("image_near", 0, 1), ("image_near", 2, 9000)], "kind string, left_id long, right_id long"))
    assert rows(leakage.cross_dataset_matches(s, more)) == [("a", "b", 1_000_025), ("a", "c", 1_000_001), ("b", "c", 1_000_000)]


def test_strided_sample_visits_the_stated_places(spark):
    import hashlib

    pool = spark.createDataFrame([(i, "x", "happy") for i in range(100)], "record_id long, dataset_source string, unified_emotion string")
    numbered, counts = align.numbered_pools(pool, "record_id")
    anchors = spark.createDataFrame([(7, "surprised")], "anchor_id long, anchor_emotion string")
    got = align.looked_at(anchors, counts, "text", 24).orderBy("ordinal").collect()
    start = int(hashlib.sha256(b"text:7").hexdigest(), 16) % 100
    assert [r.place for r in got] == [(start + k * 4) % 100 for k in range(24)]
    assert numbered.count() == 100


def test_candidates_picked_in_groups_are_the_chosen_ones(spark, monkeypatch):
    rng = np.random.default_rng(8)
    shared = rng.normal(size=(40, 64))
    shared[3] = 0
    kinds = ["happy", "surprised", "sad", "neutral"]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(shared)], "slot int, vec array<double>")
    pool = spark.createDataFrame([(i, "ab"[i % 2], kinds[i % 3 if i < 390 else 3], i % 40, f"p{i}") for i in range(400)], "record_id long, dataset_source string, unified_emotion string, slot int, name string")
    anchors = spark.createDataFrame([(i, kinds[i % 4], (i * 3) % 40) for i in range(200)], "anchor_id long, anchor_emotion string, anchor_slot int")
    monkeypatch.setattr(align, "RESIDUES", 2)
    for related in (True, False):
        a = anchors.join(v.select(F.col("slot").alias("anchor_slot"), F.col("vec").alias("anchor_vec")), "anchor_slot").drop("anchor_slot")
        want = align.chosen(align.candidates(a, pool.join(v, "slot"), "record_id", "vec", "x", related=related), F.col("emotion_score") * 0.7 + F.col("similarity") * 0.3)
        got = align.picked(anchors, pool, "record_id", shared, "x", lambda e, s, a, p, i: e * 0.7 + s * 0.3, ["name", "slot"], related=related)
        cols = ["anchor_id", "name", "emotion_score", "similarity", "composite"]
        assert got.count() == 200 and rows(got.select(*cols)) == rows(want.select(*cols))


def test_fusion_and_gate(spark):
    df = spark.createDataFrame([(1.0, 0.9, 0.8, 0.7, 0.6)], "e double, i double, c double, b double, t double")
    r = df.select(align.fused_score("e", "i", "c", "b", "t").alias("x")).first().x
    assert r == pytest.approx(0.4 + 0.18 + 0.144 + 0.084 + 0.06)
    assert df.select(align.passes(F.lit(0.56), F.lit(0.5), F.lit(0.3), F.lit(True)).alias("x")).first().x is False


def test_eager_join_equals_the_joined_rows(spark):
    rng = np.random.default_rng(0)
    a = spark.createDataFrame([(int(k) if k else None, f"g{k % 3}", int(v)) for k, v in rng.integers(0, 6, (80, 2))], "k int, ga string, x int")
    b = spark.createDataFrame([(int(k) if k else None, f"h{k % 2}", int(v)) for k, v in rng.integers(0, 6, (70, 2))], "k int, gb string, y int")
    want = a.join(b, "k").groupBy("ga", "gb").agg(F.count("*").alias("n_pairs"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))
    assert rows(eager.eager_join(a, b, "k", ["ga"], ["gb"], ["x"], ["y"])) == rows(want)
    assert eager.eager_join(a.limit(0), b, "k", ["ga"], ["gb"]).count() == 0


def test_profile_of_hot_and_null_keys(spark):
    df = spark.createDataFrame([("a", "x")] * 50 + [("a", None), (None, "x"), ("b", "y")], "k string, s string")
    assert rows(eager.key_profile(df, "k", sets={"s": F.col("s")}).select("k", "n_rows", "n_s", "s")) == [("a", 51, 1, "x"), ("b", 1, 1, "y")]


def test_prefix_sums(spark):
    rng = np.random.default_rng(0)
    data = [(i, "ab"[i % 2], float(p), int(w)) for i, (p, w) in enumerate(zip(rng.random(200).round(2), rng.integers(0, 9, 200)))]
    df = spark.createDataFrame(data, "id long, g string, p double, w long")
    got = {r.id: r.before for r in skew.prefix_sums(df, ["g"], ["id"], F.col("w"), F.col("p"), buckets=16).collect()}
    for g in "ab":
        run = 0
        for i, _, _, w in sorted((x for x in data if x[1] == g), key=lambda x: (x[2], x[0])):
            assert got[i] == run
            run += w


def test_lookup_join_with_heavy_keys(spark):
    df = spark.createDataFrame([("hot", i) for i in range(60)] + [("c", 100), (None, 101), ("none", 102)], "k string, id long")
    dim = spark.createDataFrame([("hot", 1), ("c", 2)], "k string, v int")
    heavy = skew.heavy_keys(df, ["k"], 10)
    assert rows(skew.lookup_join(df, dim, "k", heavy, 1)) == rows(df.join(dim, "k", "left"))


def test_manifests(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "m.json").write_text(json.dumps({"records": [{"a": 3}]}))
    (tmp_path / "m.csv").write_text("a,b\n 1 ,\n")
    assert manifests.read_manifest(spark, str(tmp_path / "m.jsonl")).count() == 2
    assert manifests.read_manifest(spark, str(tmp_path / "m.json")).first().a == 3
    assert tuple(manifests.blanks_to_null(manifests.read_manifest(spark, str(tmp_path / "m.csv"))).first()) == ("1", None)
    with pytest.raises(ValueError):
        manifests.read_manifest(spark, str(tmp_path / "m.txt"))
    d = tmp_path / "splits"
    d.mkdir()
    (d / "train.jsonl").write_text('{"sample_id": "a"}\n')
    (d / "other.jsonl").write_text('{"sample_id": "b"}\n')
    assert [tuple(r) for r in manifests.read_splits(spark, str(d)).collect()] == [("a", "train")]
    assert manifests.tolerant_path(spark, str(tmp_path), " M.CSV ") == f"{tmp_path}/m.csv"
    plan = manifests.prediction_plan(spark, [("m",), ("n",)], ["name"], [str(tmp_path) + "/{name}.csv"])
    assert [(r.name, r.status) for r in plan.collect()] == [("m", "found"), ("n", "missing")]


def test_wave_files(spark, tmp_path):
    with wave.open(str(tmp_path / "tone.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(b"".join(struct.pack("<h", int(20000 * np.sin(2 * np.pi * 440 * i / 16000))) for i in range(4000)))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    np.save(tmp_path / "v.npy", np.ones((2, 2), np.float32))
    got = {r.path.rsplit("/", 1)[1]: r for r in media.sound_vectors(spark, str(tmp_path)).collect()}
    assert got["tone.wav"].rate == 16000 and got["tone.wav"].seconds == 0.25 and len(got["tone.wav"].vector) == 64 and got["bad.wav"].vector is None
    assert media.stored_vectors(spark, str(tmp_path)).first().vector == [1.0] * 4
    assert rows(media.counts_by_suffix(spark, str(tmp_path), media.SOUNDS)) == [("wav", 2)]


def test_export(spark):
    df = spark.createDataFrame([("a b", 1), ("a b", 2), ("c", 3)], "sample_id string, n int")
    assert rows(export.export_ids(df, "sample_id", "n").select("n", "export_id")) == [(1, "a_b"), (2, "a_b_002"), (3, "c")]
    d = spark.createDataFrame([("g", e, s, f"{e}{s}") for e, s in (("happy", 0.9), ("happy", 0.8), ("sad", 0.1), ("happy", 0.7))], "g string, e string, s double, id string")
    assert [r.id for r in export.diverse_subset(d, "g", "e", "s", "id", 3).orderBy("place").collect()] == ["happy0.9", "sad0.1", "happy0.8"]


def test_dialogue_lines(spark):
    df = spark.createDataFrame([("[6.29 - 8.23]\tSes01F_impro01_F000\tneu\t[2.5, 2.5, 2.5]",), ("[1.0 - 2.0]\tSes01F_impro01_M001\txxx\t[2, 2, 2]",), ("C-E2: Neutral;",)], "value string")
    r = normalize.parse_dialogue(df).collect()
    assert len(r) == 1 and (r[0].turn, r[0].label, r[0].valence, r[0].speaker) == ("Ses01F_impro01_F000", "neu", 2.5, "Ses01F_F")


def test_latest_text_wins(spark):
    r = spark.createDataFrame([("a", "own", "sad"), ("b", "own", "sad")], "sample_id string, text string, unified_emotion string")
    m = spark.createDataFrame([("a", "first", "happy", 1), ("a", "last", "angry", 2)], "sample_id string, conditioning_text string, unified_emotion string, n int")
    assert rows(normalize.with_latest_text(r, m, "n").select("sample_id", "text", "unified_emotion")) == [("a", "last", "angry"), ("b", "own", "sad")]


def test_metrics(spark):
    p = spark.createDataFrame([("id", "happy", "happy", [1.0, 0.0], [0.0, 1.0]), ("id", "sad", "sad", [0.0, 1.0], [1.0, 0.0])], "identity_id string, target_emotion string, predicted_emotion string, a array<double>, b array<double>")
    assert metrics.accuracy(p).first().acc == 1.0
    assert metrics.disentanglement(p, "a", "b").first().lds == pytest.approx(1.0)
    t = spark.createDataFrame([("", "happy", "a happy face")], "predicted_emotion string, unified_emotion string, text string")
    assert metrics.accuracy(t).first().acc == 1.0
    assert metrics.latency(spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "v double"), "v", baseline=2.0).first() == (2, 2.0, 2.0, pytest.approx(2.9), 1.0)


def test_silhouette_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5)) + np.repeat(np.eye(5)[:4] * 2, 10, axis=0)
    y = np.repeat(range(4), 10)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    s = []
    for i in range(40):
        own = (y == y[i]) & (np.arange(40) != i)
        a, b = d[i, own].mean(), min(d[i, y == k].mean() for k in range(4) if k != y[i])
        s.append((b - a) / max(a, b))
    got = metrics.silhouette(spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "v array<double>, k int"), "v", "k").first()
    assert got.silhouette == pytest.approx(max(0, np.mean(s)))


def test_graphs(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.1, 0.9])], "id long, v array<double>")
    g = graphs.knn_graph(v, "id", "v", 1)
    assert {(r.src, r.dst) for r in g.collect()} == {(0, 1), (1, 0), (2, 3), (3, 2)}
    line = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 0.2), ("x", "y", 1.0)], "src string, dst string, weight double")
    sym = graphs.symmetric(line)
    d = {(r.src, r.dst): r.distance for r in graphs.shortest_paths(sym).collect()}
    assert d["a", "c"] == pytest.approx(1.0) and d["a", "b"] == pytest.approx(0.5, abs=1e-5) and d["a", "x"] == 1.0
    assert graphs.path_between(sym, "a", "c") == ["a", "b", "c"] and graphs.path_between(sym, "a", "x") == ["a", "x"]
    assert graphs.edge_list(graphs.perturbed(sym, 0.5)).count() == 2
    same = spark.createDataFrame([("g", s, i, j, float(i != j)) for s, i, j in itertools.product("ab", range(3), range(3))], "g string, side string, i int, j int, cost double")
    assert graphs.gromov_wasserstein(same, "g").first().distance == pytest.approx(0.0, abs=0.5)


def test_reports(spark):
    r = spark.createDataFrame([("m", None, "0.5"), ("m", None, "x"), ("m", None, "0.7")], "method string, variant string, acc string")
    got = reporting.seed_aggregate(r, ["acc"]).first()
    assert (got.acc_mean, got.acc_n) == (pytest.approx(0.6), 2)
    assert "0.6" in reporting.latex(spark.createDataFrame([("m", 0.6)], "a string, b double"))


def test_incremental_leakage_over_a_stream(spark, records, tmp_path):
    src = tmp_path / "in"
    records(dict(record_id=1, split="train", identity_id="a"), dict(record_id=2, split="val", identity_id="b")).coalesce(1).write.parquet(str(src / "p"))
    records(dict(record_id=3, split="test", identity_id="a ")).coalesce(1).write.mode("append").parquet(str(src / "p"))
    got = incremental.run_incremental(spark, str(src / "p"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [r.key for r in got.collect()] == ["a"]


def test_stars_need_two_rows(spark):
    df = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, "z")], "id long, k string")
    assert rows(star_edges(df, "k", "id", "r")) == [(1, 2, "r", "k")]


def test_stub_vectors(spark):
    a = media.stub_vectors(spark.createDataFrame([("x",), ("x",), (None,)], "k string"), "k").collect()
    assert a[0].vector == a[1].vector and np.linalg.norm(a[0].vector) == pytest.approx(1.0) and a[2].vector is None


def test_configuration(tmp_path):
    from tesserae.sources import config

    (tmp_path / "a.yaml").write_text("x: {y: 1, z: 2}\nw: 3\n")
    (tmp_path / "b.yaml").write_text("base_config: a.yaml\nx: {y: 5}\n")
    got = config.load(tmp_path / "b.yaml")
    assert got == {"x": {"y": 5, "z": 2}, "w": 3} and config.fingerprint(got) == config.fingerprint(dict(reversed(got.items())))
    assert config.section(splits.Policy, {"reserve": 1.04, "unknown": 1}).reserve == 1.04
    with pytest.raises(ValueError):
        splits.Policy(train=0.9)


def test_stages_stop():
    import time

    from tesserae.plans import stages

    r = stages.run([("a", lambda r: 1), ("b", lambda r: time.sleep(0.05) or r["a"] + 1), ("c", lambda r: 9)], stop_after_seconds=0.04)
    assert r["results"] == {"a": 1, "b": 2} and r["stopped_after"] == "b" == r["slowest"]


def test_paths_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([("train", "sad", "s1", " nan", 4, True, None)], "split string, e string, id string, p string, n int, i boolean, a boolean")
    r = df.select(export.synthesised_path("/r/", "images", "split", "e", "id", ".jpg").alias("x"), export.path_or_placeholder("p", "img", "n").alias("y"), export.modality_letters("i", "a", "a").alias("z")).first()
    assert tuple(r) == ("/r/images/train/sad/s1.jpg", "img::4", "I__")
    (tmp_path / "f.txt").write_text("abc")
    b = export.bundle(spark, str(tmp_path), "bench", {"rows": 3})
    assert b["files"][0]["path"] == "f.txt" and b["files"][0]["sha256"].startswith("ba7816bf") and "rows: 3" in b["card"]
