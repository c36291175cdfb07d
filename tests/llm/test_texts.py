"""Operators over documents: encoding, mixing and languages."""

import base64
import os
import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import bpe, language, mixing

VOCABULARY = Path(bpe.TOKENIZER_DIR) / bpe.VOCABULARY
pytestmark = pytest.mark.skipif(not VOCABULARY.exists(), reason="no public vocabulary")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(str(VOCABULARY))


def test_encoding_of_odd_texts(reference, encoder):
    rng = random.Random(4)
    alphabet = "aZz  \t\n\r'’sdltmrev019.,!?-éßñ漢字😢́​﻿\xa0　½Ⅷ\x85 <|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    texts += ["", " ", "\n\n x", "'s", "''s", "x'll'll've'd", " 's", "it's\n\n'm  ", "<|endoftext|>", "a" * 3000, " " * 500, "ab " * 20000, "!?" * 400]
    assert encoder.encode(texts) == [reference.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_round_trip_and_offsets(encoder, texts):
    for t, ids in zip(texts, encoder.encode(texts)):
        raw = t.encode("utf-8", "surrogatepass")
        assert b"".join(encoder.bytes_of[i] for i in ids) == raw
        cut = [*encoder.offsets(ids), len(raw)]
        assert [raw[a:b] for a, b in zip(cut, cut[1:])] == [encoder.bytes_of[i] for i in ids]


def test_long_pieces_merge_alike(encoder):
    rng = random.Random(0)
    for _ in range(30):
        p = "".join(rng.choice("abcdetinoé") for _ in range(rng.randrange(2, 120))).encode()
        assert encoder._merge_long(p) == encoder.merge(p)


def test_encoded_column(spark, reference):
    rows = [(1, "Hello, world's end"), (2, None), (3, ""), (4, "Hello, world's end"), (5, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.ids for r in bpe.encode_column(df, keep=["doc_id"]).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in rows}
    back = bpe.decode_column(bpe.encode_column(df, keep=["doc_id"]), keep=["doc_id"])
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in rows}
    n = bpe.encode_column(df.limit(0), keep=["doc_id"], count_only=True)
    assert n.count() == 0 and n.columns == ["doc_id", "n_tokens"]


# --- 9 -------------------------------------------------------------------------------------------------------------

def test_filling_keeps_to_the_room():
    got = mixing.fill(100, {"a": 1, "b": 1, "c": 2}, {"a": 10, "b": 1000, "c": 1000})
    assert got["a"] == 10 and got["b"] == pytest.approx(30) and got["c"] == pytest.approx(60)
    assert mixing.fill(100, {"a": 1, "b": 0}, {"a": 5, "b": 50}) == {"a": 5, "b": 0}


def test_shortages_go_to_siblings_before_ancestors():
    w = {("d", "en", "a"): 1.0, ("d", "en", "b"): 1.0, ("d", "fr", "b"): 1.0, ("e", "en", "c"): 1.0}
    room = dict.fromkeys(w, 1000.0) | {("d", "en", "a"): 0.0}
    got = mixing.budgets(400, w, room)
    assert got["d", "en", "b"] == pytest.approx(200) and got["d", "fr", "b"] == pytest.approx(100) and got["e", "en", "c"] == pytest.approx(100)
    got = mixing.budgets(400, w, room | {("d", "en", "b"): 50.0})
    assert got["d", "en", "b"] == 50 and got["d", "fr", "b"] == pytest.approx(250) and got["e", "en", "c"] == pytest.approx(100)


def documents(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(900):
        s = ("annotator_notes", "scene_captions", "studio_logs", "tiny", None, "elsewhere")[min(i % 7, 5)]
        rows.append((i, None if i % 50 == 0 else " ".join(rng.choice(["alpha", "beta", "gamma"], rng.integers(1, 30))), ("en", " FR-CA", None, "zzz")[i % 4], "tiny_source" if s == "tiny" and i < 60 else s))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_mixture(spark):
    t = spark.createDataFrame([("annotator_notes", 0.5, 1), ("scene_captions", 0.2, 1), ("studio_logs", 0.2, 2), ("tiny_source", 0.05, 3), ("nothing", 0.05, 4)], "source string, target_share double, max_repeats long")
    m = mixing.Mixture(documents(spark), t)
    r = {x.source: x for x in m.report().collect()}
    assert r["nothing"].falls_short and r["nothing"].share_reached == 0 and not r["annotator_notes"].falls_short
    for s in ("annotator_notes", "scene_captions", "studio_logs"):
        assert abs(r[s].mixed_tokens - r[s].budget_tokens) < 120 and r[s].share_reached >= r[s].target_share - 0.02
    rows = m.rows().collect()
    cap = {"annotator_notes": 1, "scene_captions": 1, "studio_logs": 2, "tiny_source": 3}
    assert all(x.copies <= cap[x.source] for x in rows) and len({x.doc_id for x in rows}) == len(rows)
    assert {tuple(x) for x in rows} == {tuple(x) for x in mixing.Mixture(documents(spark).repartition(5), t).rows().collect()}
    big = mixing.Mixture(documents(spark), t, total_tokens=10**9)
    assert all(x.mixed_tokens == x.available_tokens * x.max_repeats for x in big.report().collect())
    assert mixing.Mixture(documents(spark).limit(0), t).rows().count() == 0


def test_an_empty_source_gives_to_all_languages_of_its_domain(spark):
    rows = [(i, "alpha beta " * 10, ("en", None)[i % 10 == 0], "a") for i in range(200)] + [(1000 + i, "alpha beta " * 10, "en", "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = spark.createDataFrame([("a", 0.2, 3), ("gone", 0.2, 3), ("b", 0.6, 3)], "source string, target_share double, max_repeats long")
    tree = spark.createDataFrame([("a", "x"), ("gone", "x"), ("gone", "y"), ("b", "y"), (None, "z")], "source string, domain string")
    m = mixing.Mixture(docs, targets, tree, total_tokens=4000)
    got = {p[1:]: b for p, b in m.budget.items()}
    assert got["und", "a"] == pytest.approx(got["en", "a"] / 9) and got["=gone", "gone"] == 0 and got["en", "b"] == pytest.approx(2400)
    assert mixing.Mixture(docs, targets, total_tokens=4000).budget[("other", "en", "b")] == pytest.approx(3000)


def test_what_leaves_miss_is_carried(spark):
    rows = [(i, "alpha beta " * 40, f"{chr(97 + i % 24)}z", "a") for i in range(24 * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    m = mixing.Mixture(docs, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats long"))
    one = m.docs.first().n_tokens
    m = mixing.Mixture(docs, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats long"), total_tokens=int(one * 24 * 2.4))
    r = m.report().first()
    assert abs(r.mixed_tokens - r.budget_tokens) <= one / 2 + 1


# --- 10 ------------------------------------------------------------------------------------------------------------

PARTS = {
    "en": ("the old painter", "a quiet child", "my neighbour", "opened the window", "forgot the answer", "sang in the garden", "while it was raining", "because nobody listened", "before the evening came"),
    "de": ("der alte Maler", "ein stilles Kind", "mein Nachbar", "öffnete das Fenster", "vergaß die Antwort", "sang im Garten", "während es regnete", "weil niemand zuhörte", "bevor der Abend kam"),
    "fr": ("le vieux peintre", "un enfant tranquille", "mon voisin", "ouvrit la fenêtre", "oublia la réponse", "chanta dans le jardin", "pendant qu'il pleuvait", "parce que personne n'écoutait", "avant que le soir ne vienne"),
    "ru": ("старый художник", "тихий ребёнок", "мой сосед", "открыл окно", "забыл ответ", "пел в саду", "пока шёл дождь", "потому что никто не слушал", "прежде чем наступил вечер"),
}


def sentence(rng, lang):
    p = PARTS[lang]
    s = f"{p[rng.integers(0, 3)]} {p[rng.integers(3, 6)]} {p[rng.integers(6, 9)]}"
    return s[0].upper() + s[1:] + ".!?"[rng.integers(0, 3)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {}
    for i in range(600):
        lang = ("en", "de", "fr", "ru")[rng.integers(0, 4)]
        label, parts = lang, [lang] * int(rng.integers(1, 5))
        if i % 6 == 0:
            label = (None, " UND", "en", "de-AT", "xx", "")[i // 6 % 6]
        if i % 10 == 3:
            parts = [lang] * 2 + [("de", "en", "ru", "fr")[("en", "de", "fr", "ru").index(lang)]] * 2
        rows.append((i, " ".join(sentence(rng, x) for x in parts), label))
        stretches = [x for k, x in enumerate(parts) if k == 0 or parts[k - 1] != x]
        code = None if label is None or label.strip().lower() in ("", "und", "xx") else label.strip().lower().split("-")[0]
        if len(stretches) > 1:
            truth.update({(i, k + 1): x for k, x in enumerate(stretches)})
        elif code != lang:
            truth[i, 0] = lang
    rows += [(9000, None, "en"), (9001, "", None), (9002, "ok then", None), (9003, "?! 12 34", None), (9004, 'The old painter sang in the garden. "der alte Maler" (mood board) My neighbour forgot the answer.', None), (9005, "word " * 50_000, "en")]
    truth[9004, 0] = "en"
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), truth


def test_languages_and_stretches(labelled):
    df, truth = labelled
    got = {(r.doc_id, r.segment_no): r for r in language.wrong_labels(df.repartition(4)).collect() if r.doc_id != 9005}
    assert {k: r.lang for k, r in got.items()} == truth
    assert all(0 < r.confidence <= 1 for r in got.values())


PARTS["sv"] = ("den gamla målaren", "ett tyst barn", "min granne", "öppnade fönstret", "glömde svaret", "sjöng i trädgården", "medan det regnade", "eftersom ingen lyssnade", "innan kvällen kom")


def test_a_rare_language_is_one_and_a_rare_mistake_is_none(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(sentence(rng, "en") for _ in range(2)), "en") for i in range(1500)] + [(2000 + i, sentence(rng, "ru"), "ru") for i in range(80)]
    rows += [(3000 + i, " ".join(sentence(rng, "sv") for _ in range(2)), "sv") for i in range(8)] + [(4000 + i, " ".join(sentence(rng, "sv") for _ in range(2)), None) for i in range(3)]
    rows += [(5000 + i, sentence(rng, "ru"), ("bg", "mul", "haw")[i % 3]) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, language.Workspace(spark, "t"))
    assert model.languages == ["en", "ru", "sv"] and model.left_out == ["bg", "haw"]
    got = {(r.doc_id, r.segment_no, r.lang) for r in language.wrong_labels(df).collect()}
    assert got == {(4000 + i, 0, "sv") for i in range(3)} | {(5000 + i, 0, "ru") for i in range(6)}


def test_samples_are_even_by_label():
    got = language.equal_shares({"a": 10, "b": 1000, "c": 100_000}, 2010)
    assert got["a"] == 1 and got["b"] == 1 and got["c"] == pytest.approx(0.01)
    assert language.equal_shares({"a": 5, "b": 7}, 100) == {"a": 1.0, "b": 1.0}


def test_tables_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "some text that nobody labelled", None)], "doc_id long, text string, lang string")
    assert language.wrong_labels(df).count() == 0 and language.wrong_labels(df.limit(0)).count() == 0


def test_sentences_leave_asides_out():
    got = language.sentences('[01.2 - 03.4] The old painter sang in the garden (close-up)! "La vieja" f0=212Hz\nEin stilles Kind vergaß die Antwort.')
    assert got == [("the old painter sang in the garden", True), ("ein stilles kind vergaß die antwort", True)]


def test_environment_names_the_folder():
    assert bpe.TOKENIZER_DIR == os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
