"""Column functions against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import hashing as H
from tesserae.functions import labels as L
from tesserae.functions import text as T
from tesserae.functions import vectors as V


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f("c").alias("x")).first().x


@pytest.mark.parametrize("value, want", [(" Train ", "train"), ("DEV", "val"), ("3", "test"), ("va lid", "val"), ("holdout", None), (None, None), ("", None)])
def test_split_codes(spark, value, want):
    assert one(spark, value, "string", L.split_of) == want


@pytest.mark.parametrize("value, want", [(" Happy\t", "happy"), ("joy", None), (None, None), ("unknown", None)])
def test_emotion(spark, value, want):
    assert one(spark, value, "string", L.emotion_of) == want


@pytest.mark.parametrize("value, want", [("\tidn_1 ", "idn_1"), ("NaN", None), (" ", None), (None, None), ("None", None)])
def test_keys(spark, value, want):
    assert one(spark, value, "string", T.key_of) == want


@pytest.mark.parametrize("value, want", [('a  ""b""\r\nc', 'a "b" c'), ("  ", None), (None, None)])
def test_clean_text(spark, value, want):
    assert one(spark, value, "string", T.clean_text) == want


def test_words_are_letters_and_digits_without_case(spark):
    assert one(spark, "It's  ÉTÉ_2, 漢字!", "string", T.words) == ["it", "s", "été", "2", "漢字"]
    assert one(spark, None, "string", T.words) is None


def test_conditioning_text(spark):
    df = spark.createDataFrame([("Hello there", "sad", "tpl"), ("Hi!!", "sad", "tpl"), ("..", "sad", "tpl"), (None, "sad", "tpl")], "t string, e string, p string")
    text, origin = T.conditioning_text("t", "e", "p")
    got = [tuple(r) for r in df.select(text, origin).collect()]
    assert got == [("Hello there. Emotional tone: sad.", "hybrid"), ("tpl", "template"), ("tpl", "template"), ("tpl", "template")]


@pytest.mark.parametrize("v, a, want", [(2.4, 3.2, "angry"), (2.4, 3.1, "sad"), (3.4, 5.0, "happy"), (3.0, 3.6, "surprised"), (3.0, 3.0, "neutral"), (None, 3.0, None)])
def test_affect(spark, v, a, want):
    df = spark.createDataFrame([(v, a)], "v double, a double")
    assert df.select(L.emotion_from_affect("v", "a").alias("x")).first().x == want


@pytest.mark.parametrize("c, k, want", [("ravdess", "8", "surprised"), ("cremad", "fea", "fearful"), ("iemocap", "FRU", "angry"), ("rafdb", "7", "neutral"), ("affectnet", "7", "contemptuous"), ("affectnet", "Joy", "happy"), ("emobank", "scared", "fearful"), ("x", "what", None)])
def test_corpus_labels(spark, c, k, want):
    df = spark.createDataFrame([(c, k)], "c string, k string")
    assert df.select(L.corpus_label("c", "k").alias("x")).first().x == want


@pytest.mark.parametrize("a, b, want", [("happy", "happy", 1.0), ("happy", "surprised", 0.72), ("neutral", "sad", 0.35), ("happy", "sad", 0.0)])
def test_emotion_match(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(L.emotion_match("a", "b").alias("x")).first().x == want


def test_digest_mod_is_the_number_modulo_n(spark):
    for s in ("", "abc", "fl_0000005663", "é漢"):
        want = int(hashlib.sha256(s.encode()).hexdigest(), 16)
        got = spark.createDataFrame([(s,)], "c string").select(H.digest_mod("c", 10_000).alias("a"), H.digest_mod("c", 37).alias("b")).first()
        assert (got.a, got.b) == (want % 10_000, want % 37)


def test_word_ids(spark):
    want = int(hashlib.md5(b"word").hexdigest(), 16) % 32767 + 1
    assert one(spark, "word", "string", lambda c: H.word_id(c, 32768)) == want
    assert one(spark, " word  word ", "string", lambda c: H.token_ids(c, 32768, 4)) == [want, want, 0, 0]
    assert one(spark, None, "string", lambda c: H.token_ids(c, 32768, 2)) == [0, 0]


def test_token_vector(spark):
    v = np.zeros(64)
    for w in ("it's", "a", "map", "a"):
        v[sum((i + 1) * ord(ch) for i, ch in enumerate(w)) % 64] += 1
    got = one(spark, "It's a map, A!", "string", V.token_vector)
    assert np.allclose(got, v / np.linalg.norm(v))
    assert one(spark, None, "string", V.token_vector) == [0.0] * 64


def test_resample_and_cosine(spark):
    x = np.array([0.0, 1.0, 4.0, 9.0])
    got = one(spark, x.tolist(), "array<double>", lambda c: V.resample(c, 7))
    assert np.allclose(got, np.interp(np.linspace(0, 1, 7), np.linspace(0, 1, 4), x))
    df = spark.createDataFrame([([1.0] * 56, [1.0] * 64, [0.0] * 64)], "a array<double>, b array<double>, z array<double>")
    r = df.select(V.cosine_unit("a", "b").alias("x"), V.cosine_unit("a", "z").alias("y")).first()
    assert r.x == pytest.approx(1.0) and r.y == 0.0


def test_hashes_of_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=64)
    bits = "".join("1" if x >= v.mean() else "0" for x in v)
    assert one(spark, v.tolist(), "array<double>", V.average_hash) == f"{int(bits, 2):016x}"
    assert one(spark, [1.0, 2.0], "array<double>", V.average_hash) is None
    df = spark.createDataFrame([("ffff0000ffff0001", "7fff0000ffff0000", "abc")], "a string, b string, c string")
    r = df.select(V.hamming("a", "b").alias("x"), V.hamming("a", "c").alias("y")).first()
    assert (r.x, r.y) == (2, None)


@pytest.mark.parametrize("value, want", [("[1, -2.5]", [1.0, -2.5]), ("1 2 3", [1.0, 2.0, 3.0]), ("[nan]", None), ("what", None), ("", None), (None, None)])
def test_parse_vector(spark, value, want):
    assert one(spark, value, "string", V.parse_vector) == want


def test_mean_of_present_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], None, [3.0, 4.0]), (None, None, None)], "a array<double>, b array<double>, c array<double>")
    got = [r.x for r in df.select(V.mean_vector("a", "b", "c").alias("x")).collect()]
    assert got == [[2.0, 3.0], None]


def test_line_points(spark):
    df = spark.createDataFrame([([0.0, 0.0], [2.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(V.line_points("a", "b", 3).alias("x")).first().x == [[0.0, 0.0], [1.0, 2.0], [2.0, 4.0]]


def test_anonymous_ids_keep_nulls(spark):
    assert one(spark, None, "string", H.anonymous_id) is None
    assert one(spark, "a", "string", H.anonymous_id) == "id_" + hashlib.md5(b"a").hexdigest()[:8]


def test_encoded_labels(spark):
    df = spark.createDataFrame([("sad",), ("3",), ("9",), (None,), ("what",)], "c string")
    assert [r.x for r in df.select(L.encoded_label("c").alias("x")).collect()] == [2, 3, None, 0, None]


def test_safe_token(spark):
    assert one(spark, "..a b/c_.", "string", T.safe_token) == "a_b_c"
    assert one(spark, "__", "string", T.safe_token) == "unknown"
    assert one(spark, "x", "string", lambda c: F.upper(c)) == "X"
