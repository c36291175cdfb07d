"""The language of every text, and of every stretch of a text in several languages.

Multinomial naive Bayes over hashed character n-grams. The labels given are noisy, so the fit has two passes over a bounded
sample, stratified by label, in two halves. The first pass counts n-grams by half and label. The second scores every document by
the model of the other half: a label is a language if most of its documents are recognised without their own help, however rare
it is, and the n-grams of each sentence are counted again for the language found. The same held-out scores set the scale of the
confidence. The matrix of log-probabilities (buckets x languages, a fixed size) goes to the executors as a broadcast; sentences
are scored in batches as a sparse product: its rows are gathered and summed per sentence. A text's sentences are then read in
order: changing the language costs, so a stretch needs the evidence of a sentence, and quoted words and short terms carry no
evidence of their own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import squeeze
from tesserae.operators.skew import unit_hash
from tesserae.workspace import Workspace

#: Labelled documents the model is fitted on at most (a seeded sample with as many of each label, or all of a rarer one).
TRAIN_DOCUMENTS = 20_000
BITS, ORDERS = 16, (2, 3, 4)
BUCKETS = 1 << BITS
#: Share of the background in a language's n-gram probabilities.
BACKGROUND = 0.02
#: A label is a language if at least this part of its documents are found to be in it by the half of the sample they are not in.
LEAST_RECOGNISED = 0.5
#: A document counts in full up to so many letters and spaces; a longer one is counted whole, with a weight that makes it count as
#: much as one of this length, so that no endless text speaks for its language.
FULL_WEIGHT = 4_000
LEAST_WORDS, SENTENCE_WORDS, CHANGE_COST = 5, 5, 12.0
#: The scales of the confidence that are tried: n-grams overlap, about one in so many tells something of its own.
SCALES = (1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 11.0, 16.0, 23.0, 32.0, 64.0)
#: Codes that name no single language.
NO_LANGUAGE = ("xx", "mul", "mis", "und", "zxx")
MISSING = ("", "und", "unknown", "xx", "n/a")

_STOP = re.compile(r"(?<=[.!?\u2026\u3002\uff01\uff1f])[\"'\u201d\u00bb)\]]*\s+|[\r\n\u2028\u2029\x0b\x0c]+|\s+[|/\u2014\u2013]+\s+")
_ASIDE = re.compile(r"\"[^\"\n]{1,60}\"|\u201c[^\u201d\n]{1,60}\u201d|\u00ab[^\u00bb\n]{1,60}\u00bb|\([^()\n]{1,60}\)|\[[^\[\]\n]{1,60}\]|<[^<>\n]{1,40}>")
_WITH_DIGIT = re.compile(r"\S*\d\S*")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_TOKEN = re.compile(r"\S*[^\W\d_]\S*")
_DIGIT = re.compile(r"\d")
_OPENS = re.compile("[\"\u201c\u00ab(\\[<]")
_LETTER_WORDS = re.compile(r"[^\W_]+")


def _tokens(s: str) -> int:
    """Parts between white space that have letters and no digits."""
    return len(_TOKEN.findall(_WITH_DIGIT.sub(" ", s) if _DIGIT.search(s) else s))


def _aside(m: re.Match) -> str:
    """Quoted and bracketed words of less than a sentence are blanked; longer ones stay."""
    return " " if _tokens(m[0]) < SENTENCE_WORDS else m[0]


def sentences(text: str) -> list[tuple[str, bool]]:
    """Each sentence's letters (lower case, words parted by one space) and whether it is long enough to stand alone.

    ``text`` is composed (NFC). Asides and words with digits are left out, and so is what then has no letters.
    """
    out, opens, digits = [], _OPENS.search(text), _DIGIT.search(text)
    for s in _STOP.split(text):
        if opens and _OPENS.search(s):
            s = _ASIDE.sub(_aside, s)
        if digits and _DIGIT.search(s):
            s = _WITH_DIGIT.sub(" ", s)
        line = _NOT_LETTERS.sub(" ", s).strip().lower()
        if line:
            parts = s.split()
            long_ = len(parts) >= SENTENCE_WORDS and (sum(map(str.isalpha, parts)) >= SENTENCE_WORDS or len(_TOKEN.findall(s)) >= SENTENCE_WORDS)
            out.append((line, long_))
    return out


def composed(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def letter_words(text: str) -> int:
    """Words (runs of letters and digits) made of letters only, of a composed text."""
    return sum(map(str.isalpha, _LETTER_WORDS.findall(text)))


def without_marks(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", s) if not unicodedata.combining(ch))


def hashed_grams(lines: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, lines) of the character n-grams of every order, lines padded by a space; each in the order of the lines."""
    padded = [f" {x} " for x in lines]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    cp = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(lines), dtype=np.int32), sizes)
    out, h = [], cp.copy()
    for n in range(2, max(ORDERS) + 1):  # the hash of n code points from that of n - 1
        m = cp.size - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) ^ cp[n - 1 :]
        if n in ORDERS:
            mixed = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
            inside = owner[:m] == owner[n - 1 :]
            out.append((mixed[inside].astype(np.int32), owner[:m][inside]))
    return out


def _chunks(lines: Sequence[str], most: int = 20_000) -> Iterator[tuple[int, int]]:
    """Ranges of lines of about ``most`` characters each; a longer line is a range of its own."""
    lo = size = 0
    for i, x in enumerate(lines):
        if size and size + len(x) > most:
            yield lo, i
            lo, size = i, 0
        size += len(x)
    if lo < len(lines):
        yield lo, len(lines)


class Model:
    """Log-probabilities [BUCKETS, languages], fitted from counts [BUCKETS, languages]; ``scale`` is that of the confidence."""

    def __init__(self, languages: Sequence[str], counts: np.ndarray, scale: float = 1.0, left_out: Sequence[str] = ()):
        self.languages, self.scale, self.left_out = list(languages), scale, list(left_out)
        per_language = counts.sum(axis=0, keepdims=True)
        whole = counts.sum(axis=1, keepdims=True)
        background = (whole + 1.0) / (whole.sum() + BUCKETS)
        share = np.divide(counts, per_language, out=np.zeros_like(counts, dtype=float), where=per_language > 0)
        self.log = np.log((1 - BACKGROUND) * share + BACKGROUND * background).astype(np.float32)

    def score(self, lines: Sequence[str]) -> np.ndarray:
        """Log-likelihood of every line under every language; a batch at a time."""
        out = np.zeros((len(lines), len(self.languages)))
        for lo, hi in _chunks(lines):
            for b, o in hashed_grams(lines[lo:hi]):
                if b.size:
                    at = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                    out[lo + o[at]] += np.add.reduceat(self.log[b], at, axis=0)
        return out

    def stretches(self, weighty: np.ndarray, scores: np.ndarray, best: np.ndarray) -> list[tuple[int, float]]:
        """(language, confidence) of the maximal stretches of a text's sentences, in order.

        ``best`` is the best language of each sentence by itself. A text without a whole sentence is one stretch.
        """
        if not weighty.any():
            scores, best = scores.sum(axis=0, keepdims=True), scores.sum(axis=0, keepdims=True).argmax(axis=1)
        elif not weighty.all():
            scores, best = scores[weighty], best[weighty]
        if (best == best[0]).all():
            return [(int(best[0]), self.confidence(scores.sum(axis=0), best[0]))]
        path = _cheapest_path(scores, CHANGE_COST)
        at = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        return [(int(path[lo]), self.confidence(scores[lo:hi].sum(axis=0), path[lo])) for lo, hi in zip(at, np.r_[at[1:], path.size])]

    def confidence(self, total: np.ndarray, lang: int) -> float:
        """The posterior of a language, in the scale that was fitted."""
        z = np.exp((total - total.max()) / self.scale)
        return float(z[lang] / z.sum())


def _cheapest_path(s: np.ndarray, cost: float) -> np.ndarray:
    """The best language of each sentence where every change costs."""
    n, _ = s.shape
    came, v = np.zeros(s.shape, int), s[0].copy()
    for i in range(1, n):
        top = int(v.argmax())
        stay = v >= v[top] - cost
        came[i] = np.where(stay, np.arange(v.size), top)
        v = np.where(stay, v, v[top] - cost) + s[i]
    path = np.empty(n, int)
    path[-1] = int(v.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = came[i][path[i]]
    return path


def label_of(c="lang"):
    """A label without case, padding and region: null where it is missing."""
    t = F.regexp_replace(F.lower(squeeze(c)), r"[-_].*$", "")
    return F.when(~F.lower(squeeze(c)).isin(*MISSING) & ~t.isin(*MISSING), t)


def _weights(per_doc: list[list[tuple[str, bool]]]) -> np.ndarray:
    """The weight of every line: 1, or less where its document is longer than FULL_WEIGHT."""
    return np.array([w for mine in per_doc for w in [min(1.0, FULL_WEIGHT / max(1, sum(len(x) for x, _ in mine)))] * len(mine)])


def _cells(lines: list[str], tags: np.ndarray, weights: np.ndarray, n_tags: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, n): the weighted number of n-grams of the lines by bucket and tag, cell = bucket x n_tags + tag. Texts may come without
    their accents, so lines that have some count in both ways."""
    bare = [without_marks(x) for x in lines]
    changed = [i for i, (x, y) in enumerate(zip(lines, bare)) if x != y]
    every, tag, weight = lines + [bare[i] for i in changed], np.r_[tags, tags[changed]].astype(np.int64), np.r_[weights, weights[changed]]
    present, compact = np.unique(tag, return_inverse=True)
    total = np.zeros(BUCKETS * present.size)
    for lo, hi in _chunks(every, 500_000):
        for b, o in hashed_grams(every[lo:hi]):
            total += np.bincount(b.astype(np.int64) * present.size + compact[lo + o], weights=weight[lo + o], minlength=total.size)
    found = np.flatnonzero(total)
    return found // max(1, present.size) * n_tags + present[found % max(1, present.size)], total[found]


def _summed(sample: DataFrame, run) -> dict[str, pd.DataFrame]:
    """What ``run`` yields (kind, at, n), summed by kind and place. Places are cells of the model, labels or scales, all bounded."""
    found = sample.mapInPandas(run, "kind string, at long, n double").groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()
    return dict(list(found.groupby("kind")))


def _array(found: dict[str, pd.DataFrame], kind: str, size: int) -> np.ndarray:
    out = np.zeros(size)
    if kind in found:
        out[found[kind]["at"].to_numpy(np.int64)] = found[kind]["n"].to_numpy(float)
    return out


def _rows(kind: str, at, n) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "at": np.asarray(at, np.int64), "n": np.asarray(n, float)})


def equal_shares(counts: dict[str, int], total: int) -> dict[str, float]:
    """The share of every label's documents that goes into a sample of ``total``: as many of each, all of those with fewer."""
    out, left = {}, total
    for i, label in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        quota = left / (len(counts) - i)
        out[label] = min(1.0, quota / counts[label])
        left -= out[label] * counts[label]
    return out


def fit(documents: DataFrame, ws: Workspace, seed: int = 3) -> Model | None:
    """The model of the languages that labels of two or three letters name; None where no label is recognised.

    ``left_out`` of the model are the labels that are no languages: fewer than LEAST_RECOGNISED of their sampled documents are
    recognised by the half of the sample that they are not in, as with one document only or with texts of another language.
    """
    labelled = documents.select("doc_id", "text", label_of().alias("label")).where(
        F.col("label").rlike("^[a-z]{2,3}$") & ~F.col("label").isin(*NO_LANGUAGE) & F.col("text").isNotNull() & (F.length("text") > 0))
    by_label = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 26^2 + 26^3 rows
    if not by_label:
        return None
    labels, n = sorted(by_label), sum(by_label.values())
    shares = equal_shares(by_label, TRAIN_DOCUMENTS)
    share = documents.sparkSession.createDataFrame([(x, shares[x], i) for i, x in enumerate(labels)], "label string, share double, own int")
    sample = labelled.join(F.broadcast(share), "label").where(unit_hash(F.col("doc_id"), F.lit(seed)) < F.col("share"))
    sample = sample.select("text", "own", (unit_hash(F.col("doc_id"), F.lit(seed + 1)) < 0.5).cast("int").alias("half"))
    sample = ws.write(sample.repartition(max(1, int(min(n, TRAIN_DOCUMENTS) / 500))), "sample")
    size = len(labels)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            per_doc = [sentences(composed(t)) for t in f["text"]]
            tags = np.repeat((f["own"] + size * f["half"]).to_numpy(), [len(mine) for mine in per_doc])
            yield _rows("cell", *_cells([x for mine in per_doc for x, _ in mine], tags, _weights(per_doc), 2 * size))

    halves = _array(_summed(sample, first), "cell", BUCKETS * 2 * size).reshape(BUCKETS, 2, size)
    other = [Model(labels, halves[:, 1 - h]) for h in (0, 1)]
    shared = documents.sparkSession.sparkContext.broadcast(other)  # two matrices of BUCKETS x labels numbers

    def second(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own, right, loss = f["own"].to_numpy(), np.zeros(len(f), bool), np.zeros(len(SCALES))
            lines, tags, weights = [], [], [np.zeros(0)]
            for h, m in enumerate(shared.value):
                at = np.flatnonzero(f["half"] == h)
                per_doc = [sentences(composed(t)) for t in f["text"].iloc[at]]
                scores, weight, lo = m.score([x for mine in per_doc for x, _ in mine]), _weights(per_doc), 0
                for i, mine in zip(at, per_doc):
                    s, w = scores[lo : lo + len(mine)], np.array([w for _, w in mine], dtype=bool)
                    share = weight[lo : lo + len(mine)]
                    lo += len(mine)
                    right[i] = len(mine) > 0 and s.sum(axis=0).argmax() == own[i]
                    if w.any():
                        path = _cheapest_path(s[w], CHANGE_COST)
                        lines += [x for x, y in mine if y]
                        tags += path.tolist()
                        weights.append(share[w])
                        if len(path) > 1 and (path == path[0]).all():
                            # a sentence by itself against what the whole text says
                            z = s[w] - s[w].max(axis=1, keepdims=True)
                            for k, scale in enumerate(SCALES):
                                e = np.exp(z / scale)
                                loss[k] -= np.log(0.999 * e[:, path[0]] / e.sum(axis=1) + 0.001 / size).sum()
            yield _rows("cell", *_cells(lines, np.array(tags, dtype=np.int64), np.concatenate(weights), size))
            yield _rows("right", range(size), np.bincount(own[right], minlength=size))
            yield _rows("all", range(size), np.bincount(own, minlength=size))
            yield _rows("loss", range(len(SCALES)), loss)

    found = _summed(sample, second)
    counts = _array(found, "cell", BUCKETS * size).reshape(BUCKETS, size)
    right, all_ = _array(found, "right", size), _array(found, "all", size)
    kept = np.flatnonzero((all_ > 0) & (right >= LEAST_RECOGNISED * all_) & (counts.sum(axis=0) > 0))
    if not kept.size:
        return None
    scale = SCALES[int(_array(found, "loss", len(SCALES)).argmin())]
    return Model([labels[i] for i in kept], counts[:, kept], scale, [x for i, x in enumerate(labels) if i not in kept])


def languages_of(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, label, n_stretches, segment_no, lang, confidence): every stretch of every text.

    A text in one language has one row of segment_no 0; one in several has a row for each maximal stretch from 1 on. Null
    texts and texts without letters have no row; n_words are the words made of letters. A table without any label that is
    recognised (see ``fit``) has no row. A repeated doc_id has the rows of each of its texts.
    """
    ws = Workspace(documents.sparkSession, "language")
    schema = "doc_id long, n_words int, label string, n_stretches int, segment_no int, lang string, confidence double"
    model = fit(documents, ws)
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for f in frames:
            texts = [composed(t) for t in f["text"]]
            per_doc = [sentences(t) for t in texts]
            flat = [x for mine in per_doc for x in mine]
            scores, weighty = m.score([x for x, _ in flat]), np.array([w for _, w in flat], dtype=bool)
            best, lo, out = (scores.argmax(axis=1) if flat else np.zeros(0, int)), 0, []
            for doc_id, text, label, mine in zip(f["doc_id"], texts, f["label"], per_doc):
                if mine:
                    w = weighty[lo : lo + len(mine)]
                    found = m.stretches(w, scores[lo : lo + len(mine)], best[lo : lo + len(mine)])
                    lo += len(mine)
                    n_words = letter_words(text)
                    for k, (i, conf) in enumerate(found):
                        out.append((doc_id, n_words, label, len(found), k + 1 if len(found) > 1 else 0, m.languages[i], conf))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "label", "n_stretches", "segment_no", "lang", "confidence"])

    texts = documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", label_of().alias("label"))
    return texts.mapInPandas(run, schema)


def wrong_labels(documents: DataFrame) -> DataFrame:
    """(doc_id, segment_no, lang, confidence) of the texts whose label is missing or wrong, and of all mixed ones.

    Texts of fewer than LEAST_WORDS words made of letters are no cases.
    """
    case = (F.col("n_stretches") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return languages_of(documents).where((F.col("n_words") >= LEAST_WORDS) & case).select("doc_id", "segment_no", "lang", "confidence")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_labels(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("confidence")


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
