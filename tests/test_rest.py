"""Smaller functions that no query reaches: paths, sinks, keys of vectors, scores, small graphs, drop rules."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tesserae.functions import hashing, text
from tesserae.operators import graphs, metrics, splits
from tesserae.operators.reporting import numeric
from tesserae.sources import manifests, media


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in columns.items()])


def test_paths_of_splits():
    assert manifests.split_path("x/y.jsonl", None, "val") == "x/y.jsonl" and manifests.split_path(None, "d/", "val") == "d/val.jsonl"
    assert manifests.split_path(None, "d", "val", {"val": "dev"}, ".csv") == "d/dev.csv"
    with pytest.raises(ValueError):
        manifests.split_path(None, None, "val")


def test_sinks_are_read_again(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", 1), ("b", "val", None)], "sample_id string, split string, n int")
    manifests.write_by_split(df, f"{tmp_path}/by")
    assert {r.split: r["count"] for r in spark.read.json(f"{tmp_path}/by").groupBy("split").count().collect()} == {"train": 1, "val": 1}
    manifests.write_manifest(df, f"{tmp_path}/m.csv", "csv")
    back = manifests.read_manifest(spark, f"{tmp_path}/m.csv")
    assert back.columns == ["n", "sample_id", "split"] and {tuple(r) for r in back.collect()} == {("1", "a", "train"), (None, "b", "val")}
    manifests.write_manifest(df, f"{tmp_path}/m.jsonl")
    assert manifests.read_manifest(spark, f"{tmp_path}/m.jsonl").count() == 2
    manifests.write_report(df, f"{tmp_path}/r")
    assert sum(1 for p in (tmp_path / "r").glob("part-*")) == 1


def test_exports_and_metric_files(spark, tmp_path):
    (tmp_path / "metadata.csv").write_text("sample_id,emotion\na,sad\nb,happy\n")
    (tmp_path / "val_split.txt").write_text(" b \n\nzzz\n")
    assert [tuple(r) for r in manifests.read_export(spark, str(tmp_path), "val").collect()] == [("b", "happy")]
    for k in (1, 2):
        (tmp_path / f"run{k}").mkdir()
        (tmp_path / f"run{k}" / "metrics.json").write_text(json.dumps({"acc": k}, indent=1))
    (tmp_path / "run1" / "other.json").write_text("{}")
    assert sorted(r.acc for r in manifests.read_metric_files(spark, str(tmp_path)).collect()) == [1, 2]


def test_availability(spark):
    rows = spark.createDataFrame([(0, 5, False), (0, 5, True), (3, 5, True), (5, 5, False)], "n int, e int, m boolean")
    got = [r.a for r in rows.select(manifests.availability(F.col("n"), F.col("e"), F.col("m")).alias("a")).collect()]
    assert got == ["missing", "metadata_only", "incomplete", "ready"]


def test_image_pools(spark, tmp_path):
    for n in ("b/1.PNG", "2.jpeg", "3.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    got = {(r.source_dataset, r.sample_id, r.raw_label, r.unified_emotion) for r in media.image_records(spark, str(tmp_path), "pool").collect()}
    assert got == {("pool", "1", "unlabeled", "neutral"), ("pool", "2", "unlabeled", "neutral")}


def test_keys_of_vectors_and_fields(spark):
    df = one(spark, v=[0.12345, -1.0, 3.0], a="x")
    got = df.select(hashing.pseudo_identity("v", 2).alias("p"), hashing.fingerprint_id("q_", "a").alias("q"), text.preview("a", 3).alias("t")).first()
    assert got.p == hashlib.sha256(b"0.1235|-1.0000").hexdigest()[:16] or got.p == hashlib.sha256(b"0.1234|-1.0000").hexdigest()[:16]
    assert got.q == "q_" + hashlib.sha256(b'{"a":"x"}').hexdigest()[:12] and got.t == "x"


def test_scores(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.5, None), (0.5, float("nan"))], "a double, b double")
    assert [r.s for r in df.select(metrics.steering_score(F.col("a"), F.col("b")).alias("s")).collect()] == [0.75, 0.5, 0.5]
    got = one(spark, x=[0.0, 0.5, 1.0], y=[0.0, 1.0, 1.0]).select(metrics.geodesic_consistency(F.col("x"), F.col("y")).alias("g")).first().g
    assert got == pytest.approx(0.5 / 3)
    words = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("x",), (None,)], "v string")
    assert [r.n for r in words.select(numeric("v").alias("n")).collect()] == [1.5, None, None, None, None]
    texts = spark.createDataFrame([("sad", None, "a SAD face"), ("happy", "", "a sad face"), (None, None, "x")], "target_emotion string, predicted_emotion string, prompt string")
    assert tuple(metrics.accuracy(texts).first()) == (3, 0.5) and metrics.accuracy(texts.limit(0)).first().acc is None


def test_small_graphs(spark):
    rows = spark.createDataFrame([(1, "k"), (2, "k"), (3, "k"), (4, None)], "id long, who string")
    g = spark.createDataFrame([(1, 4, 0.5)], "src long, dst long, weight double")
    got = {(r.src, r.dst, r.weight) for r in graphs.with_identity(g, rows, "id", "who").collect()}
    assert got == {(1, 4, 0.5), (4, 1, 0.5), (1, 2, 1.0), (2, 1, 1.0), (1, 3, 1.0), (3, 1, 1.0)}
    v = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 1.0], None)], "id long, a array<double>, b array<double>, c array<double>")
    cells = graphs.adjacency_from(v, "id", ["a", "b", "c"]).collect()
    assert {(r.i, r.j): round(r.weight, 4) for r in cells if r.weight} == {(0, 1): 0.7071}


def test_drop_rules(spark):
    groups = spark.createDataFrame([("a", 30, 1), ("b", 5, 3), ("c", 500, 3), ("d", 900, 1)], "group_id string, size long, n_splits long")
    strict = splits.Policy(quarantine_oversized=True, drop_ambiguous=True, max_group_size=600, max_group_share=0.34)
    got = {r.group_id: r.reason for r in splits.with_drop_reason(groups, strict).collect()}
    assert got == {"a": None, "b": "ambiguous_existing_split_links", "c": "oversized_hard_group", "d": "oversized_hard_group"}
    assert [r.group_id for r in splits.kept(groups, strict).collect()] == ["a"] and splits.kept(groups, splits.Policy()).count() == 4
    assert splits.kept(groups.limit(0), strict).count() == 0


def test_written_results(spark, tmp_path):
    from tesserae.sources import exports

    df = spark.createDataFrame([("a", "train", "x", [1]), ("b", "val", None, []), ("c", None, "x", None)], "sample_id string, split string, source_dataset string, more array<int>")
    exports.write_records(df, str(tmp_path), "normalised")
    assert manifests.read_manifest(spark, f"{tmp_path}/normalised.csv").where("sample_id = 'a'").first().more == "[1]"
    got = {(r.column, r.value, r.n) for r in spark.read.json(f"{tmp_path}/normalised_summary.json").collect()}
    assert got == {("rows", None, 3), ("source_dataset", "x", 2), ("source_dataset", None, 1), ("split", "train", 1), ("split", "val", 1), ("split", None, 1)}
    exports.write_splits(df, f"{tmp_path}/s")
    counts = {n: spark.read.json(f"{tmp_path}/s/{n}.jsonl").count() for n in ("all", "train", "val")}
    assert counts == {"all": 3, "train": 1, "val": 1} and spark.read.text(f"{tmp_path}/s/test.jsonl").count() == 0
    exports.write_export(df, f"{tmp_path}/e")
    assert [r.sample_id for r in manifests.read_export(spark, f"{tmp_path}/e", "val").collect()] == ["b"]
    g = spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, weight double")
    exports.write_graph(g, spark.range(2), spark.range(1).select(F.lit(1).alias("n_edges")), f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g/edges.parquet").count() == 1 and spark.read.json(f"{tmp_path}/g/metadata.json").first().n_edges == 1


def test_batches_sets_and_maps(spark):
    from tesserae.operators import sampling

    df = spark.range(10).repartition(3)
    plain = {r.id: r.batch for r in sampling.batches(df, "id", 4).collect()}
    assert plain == {i: i // 4 for i in range(10)}
    mixed = {r.id: r.place for r in sampling.batches(df, "id", 4, seed=1).collect()}
    assert sorted(mixed.values()) == list(range(10)) and mixed == {r.id: r.place for r in sampling.batches(df.repartition(7), "id", 4, seed=1).collect()}
    assert sorted(mixed, key=mixed.get) == sorted(range(10), key=lambda i: hashlib.md5(f"{i}:1".encode()).hexdigest())
    assert sampling.batches(df.limit(0), "id", 4).count() == 0
    with pytest.raises(ValueError):
        sampling.batches(df, "id", 0)
    sets = spark.createDataFrame([(["a", "b"], ["b", "a", "a"]), (["a"], []), (None, None), (None, ["a"])], "a array<string>, b array<string>")
    assert [r.s for r in sets.select(sampling.same_set("a", "b").alias("s")).collect()] == [True, False, True, False]
    assert spark.range(1).select(sampling.present_map({"x": F.lit("1"), "y": F.lit(None).cast("string")}).alias("m")).first().m == {"x": "1"}
