"""Typed values mapped to the entries of a canonical list.

Values are normalised and deduplicated, so a value that a third of all rows carry is matched once. A value is looked at through
its windows: all runs of consecutive words no longer than the longest form of the list, so that what dresses an entry up, however
long it is, does not hide it. Windows meet the forms of the entries in an inverted index of weighted character n-grams (of the
words, and of the words without vowels) and are scored by cosine; a label's score is its best form's and best window's. What
reaches the threshold is checked exactly: every word of the form must be found in the value (misspelt, cut short, lengthened,
without vowels, in any order or run together), so that sharing a word is not enough. The best label that passes is accepted if no
other that passes comes within the margin. Nothing is cut by rank, number of words or length.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.text import squeeze
from tesserae.workspace import Workspace

#: The least cosine of a match, and by how much it must be above that of any other label.
THRESHOLD, MARGIN = 0.24, 0.03
#: A form is indexed by its heaviest n-grams, those that make up this part of its squared weight: the n-grams that most forms share
#: (the longest lists of the index) are left out of the vector it is compared by.
INDEXED = 0.97
#: How well a word of the form must be found in the value, and all of them on average (by length); how well in a value run together.
LEAST_WORD, LEAST_MEAN, LEAST_INSIDE = 0.5, 0.74, 0.7
VOWELS = "aeiou"
#: Digits typed for letters, and the letters.
DIGITS, LETTERS = "01345789", "oleastbg"


def normal_form(c) -> Column:
    """Lower case, compatibility forms folded by removing marks, everything but letters and digits to single spaces."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def plain_words(c: Column) -> Column:
    """The words of a normal form; digits that stand for letters read as letters, where the word has letters too."""
    return F.transform(F.split(c, " "), lambda w: F.when(w.rlike(r"\p{L}") & w.rlike(r"\d"), F.translate(w, DIGITS, LETTERS)).otherwise(w))


def _bare(word: str) -> str:
    return "".join(ch for ch in word if ch not in VOWELS)


def _once(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


def _steps(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b."""
    if a == b:
        return 0
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


def _near(a: str, b: str) -> float:
    """1 less the steps from a to b in the measure of the longer; 0 where the lengths alone put it below LEAST_WORD."""
    longer = max(len(a), len(b), 1)
    if min(len(a), len(b)) < LEAST_WORD * longer:
        return 0.0
    return 1 - _steps(a, b) / longer


@functools.lru_cache(maxsize=200_000)
def word_match(word: str, entry: str) -> float:
    """How well a typed word stands for a word of an entry, from 0 to 1."""
    if word == entry:
        return 1.0
    best = max(_near(word, entry), _near(_once(word), _once(entry)) - 0.02)
    if len(word) < len(entry):  # cut short
        if len(word) >= 3 and entry.startswith(word):
            best = max(best, 0.9)
        elif len(_once(word)) >= 3 and _once(entry).startswith(_once(word)):
            best = max(best, 0.88)
        elif len(word) >= 4:
            best = max(best, 0.85 * _near(word, entry[: len(word)]))
    elif len(word) > len(entry) >= 3:  # with an ending
        best = max(best, 0.95 * max(_near(word[:k], entry) for k in range(len(entry) - 1, len(entry) + 2)))
    bare = _bare(entry)
    if len(bare) >= 2 and _bare(word) == word:
        best = max(best, 0.95 * _near(word, bare))
    return best


def inside(word: str, text: str) -> float:
    """How well a word is found somewhere in a text without spaces: 1 less the fewest steps in the measure of the word."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(word, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return 1 - min(row) / len(word)


def stands_whole(value: str, form: str) -> bool:
    """Whether all words of a form are found in a value: each in a word of its own, or all of them in the value run together."""
    have, want = value.split(), form.split()
    if have == want:
        return True
    if not have or not want:
        return False
    if len(have) >= len(want):
        fit = [[word_match(h, w) for h in have] for w in want]
        owner: dict[int, int] = {}

        def place(i: int, seen: set[int]) -> bool:
            """A word of the value for word i of the form, best first; others may have to move."""
            for j in sorted(range(len(have)), key=lambda j: -fit[i][j]):
                if fit[i][j] >= LEAST_WORD and j not in seen:
                    seen.add(j)
                    if j not in owner or place(owner[j], seen):
                        owner[j] = i
                        return True
            return False

        if all(place(i, set()) for i in range(len(want))):
            mean = sum(fit[i][j] * len(want[i]) for j, i in owner.items()) / sum(map(len, want))
            if mean >= LEAST_MEAN:
                return True
    joined = "".join(have)
    return abs(len(joined) - sum(map(len, want))) <= 3 and all(len(w) > 1 and inside(w, joined) >= LEAST_INSIDE for w in want)


def windows_of(words: Column, most: int) -> Column:
    """All runs of up to ``most`` consecutive words, joined by spaces."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda k: F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))
    return F.array_distinct(F.flatten(runs))


def _grams(c: Column) -> Column:
    """Character 2- and 3-grams of the words of a normal form, and of the words without vowels."""
    marked = F.transform(F.split(c, " "), lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    bare = F.transform(F.split(F.translate(c, VOWELS, ""), " "), lambda w: F.concat(F.lit("<"), w, F.lit(">")))

    def cut(w: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - (n - 1))), lambda i: F.substring(w, i, F.lit(n)))

    views = F.concat(marked, bare)
    return F.flatten(F.concat(F.transform(views, lambda w: cut(w, 2)), F.transform(views, lambda w: cut(w, 3))))


def catalog_forms(catalog: DataFrame) -> DataFrame:
    """(label_id, form): canonical labels and aliases in normal form. Null or wordless ones are no forms."""
    every = catalog.select("label_id", F.explode(F.concat(F.array("canonical_label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    return every.select("label_id", normal_form("form").alias("form")).where("form <> ''").distinct()


def _index(forms: DataFrame, n_forms: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(idf(g, idf), index(g, form, we)): the weight of every n-gram of the forms, and the forms' unit vectors without their lightest n-grams."""
    posted = forms.select("form", F.explode(_grams(F.col("form"))).alias("g")).groupBy("form", "g").agg(F.count(F.lit(1)).alias("tf"))
    idf = ws.write(posted.groupBy("g").agg(F.log(1 + F.lit(float(n_forms)) / F.count(F.lit(1))).alias("idf")), "idf")
    falling = Window.partitionBy("form").orderBy(F.desc("w"), "g")
    weighed = posted.join(idf, "g").select("form", "g", (F.col("tf") * F.col("idf")).alias("w"))
    weighed = weighed.withColumn("above", F.sum(F.col("w") * F.col("w")).over(falling) - F.col("w") * F.col("w"))
    weighed = weighed.withColumn("all", F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("form"))).where(F.col("above") < INDEXED * F.col("all"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("form")))
    return idf, ws.write(weighed.select("g", "form", (F.col("w") / size).alias("we")), "index")


def match_values(values: DataFrame, forms: DataFrame) -> DataFrame:
    """(value, label_id, score) for distinct normal forms ``values``(value): the accepted entry, or label_id 0.

    ``forms``(label_id, form). A value that equals a form takes it. If two entries share a form the smaller label_id stands. Null
    and empty values have no row; without forms every value is 0.
    """
    ws = Workspace(values.sparkSession, "canonical")
    values = ws.write(values.select("value").where("value <> ''").distinct().withColumn("words", plain_words(F.col("value"))), "values")
    forms = ws.write(forms.groupBy("form").agg(F.min("label_id").alias("label_id")), "forms")
    n_forms, most = forms.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(F.split("form", " "))), F.lit(1))).first()
    idf, index = _index(forms, n_forms, ws)
    seen = ws.write(values.select("value", F.array_join("words", " ").alias("line"), F.explode(windows_of(F.col("words"), most)).alias("window")), "windows")
    # an n-gram that no form has weighs as much as one that a single form has
    asked = seen.select("window").distinct().select("window", F.explode(_grams(F.col("window"))).alias("g")).groupBy("window", "g").agg(F.count(F.lit(1)).alias("tf"))
    asked = asked.join(idf, "g", "left").select("window", "g", (F.col("tf") * F.coalesce("idf", F.lit(math.log(1 + n_forms)))).alias("w"))
    size = asked.groupBy("window").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = asked.join(index, "g").groupBy("window", "form").agg(F.sum(F.col("w") * F.col("we")).alias("dot"))
    scored = dots.join(size, "window").select("window", "form", (F.col("dot") / F.col("norm")).alias("cosine")).where(F.col("cosine") >= THRESHOLD)
    # the check reads the whole value, the cosine the window that fits best
    top = seen.join(ws.write(scored, "scored"), "window").groupBy("value", "line", "form").agg(F.max("cosine").alias("cosine")).join(forms, "form")

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = [stands_whole(v, e) for v, e in zip(f["line"], f["form"])]
            yield f.loc[ok, ["value", "form", "label_id", "cosine"]]

    spread = top.select("value", "line", "form", "label_id", "cosine").repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "value", "form")
    passed = spread.mapInPandas(check, "value string, form string, label_id long, cosine double")
    per_label = passed.groupBy("value", "label_id").agg(F.max("cosine").alias("score"), F.max(F.col("value") == F.col("form")).alias("same"))
    rank = Window.partitionBy("value").orderBy(F.desc("same"), F.desc("score"), "label_id")
    ranked = per_label.withColumn("second", F.lead("score").over(rank)).withColumn("n", F.row_number().over(rank)).where("n = 1")
    found = ranked.where(F.col("same") | (F.col("score") - F.coalesce("second", F.lit(0.0)) >= MARGIN)).select("value", "label_id", "score")
    return values.join(found, "value", "left").select("value", F.coalesce("label_id", F.lit(0)).cast("long").alias("label_id"), "score")


def typed_values(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(record_id, source_dataset, raw_label) of the rows with a typed label that says something.

    Sources of another style, and labels that are null, blank or "unlabeled" (any case, padded) are left out.
    """
    typed = sources.where(F.lower(squeeze("label_style")) == "typed").select("source_dataset").distinct()
    rows = records.select("record_id", "source_dataset", "raw_label").join(F.broadcast(typed), "source_dataset")
    return rows.where(~F.lower(squeeze("raw_label")).isin("", "unlabeled"))


def map_labels(records: DataFrame, sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """(record_id, source_dataset, raw_label, label_id, score): each typed label with its entry, 0 where it is none.

    ``sources`` (a row per source) and ``catalog`` are fixed tables. A label without letters and digits is no entry.
    """
    rows = typed_values(records, sources).withColumn("value", normal_form("raw_label"))
    found = Workspace(records.sparkSession, "labels").write(match_values(rows.select("value").distinct(), catalog_forms(catalog)), "found")
    # a value may stand in a third of all rows: adaptive execution splits its rows, the found side is unique by value
    out = rows.join(found, "value", "left")
    return out.select("record_id", "source_dataset", "raw_label", F.coalesce("label_id", F.lit(0)).cast("long").alias("label_id"), "score")


def _read(spark: SparkSession, sf_dir: str):
    return (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("normalized_records", "source_labels", "label_catalog"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_labels(*_read(spark, sf_dir)).select("record_id", "label_id")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_dataset, unified_emotion, n_rows, n_values): mapped labels by emotion; those of no entry have a null emotion."""
    records, sources, catalog = _read(spark, sf_dir)
    emotion = catalog.groupBy("label_id").agg(F.min("unified_emotion").alias("unified_emotion"))
    return map_labels(records, sources, catalog).join(emotion, "label_id", "left").groupBy("source_dataset", "unified_emotion").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(normal_form("raw_label")).alias("n_values"))
