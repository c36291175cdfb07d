"""Pseudo-alignment of records across modalities."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.hashing import digest_mod, hash_split
from tesserae.functions.labels import RELATED, TAXONOMY, emotion_match, taxonomy_index
from tesserae.functions.text import ascii_tokens
from tesserae.functions.vectors import clamp01, dot, let, norm, normalised
from tesserae.operators.skew import in_order
from tesserae.workspace import Workspace, ship


@dataclass(frozen=True)
class Weights:
    emotion: float = 0.40
    identity: float = 0.20
    clip: float = 0.18
    imagebind: float = 0.12
    text_audio: float = 0.10


@dataclass(frozen=True)
class Thresholds:
    final: float = 0.55
    emotion: float = 0.50
    identity: float = 0.40


#: How many of a pool are looked at for an anchor, and how many of these go on by similarity.
LOOKED, KEPT = 24, 8


def fused_score(emotion, identity, clip, imagebind, text_audio=None, w: Weights = Weights()) -> Column:
    """The weighted mean of the five scores, each clamped to [0, 1]; a missing text-audio score is the mean of clip and imagebind."""
    c = lambda x: clamp01(F.col(x) if isinstance(x, str) else x)
    e, i, k, b = c(emotion), c(identity), c(clip), c(imagebind)
    t = F.coalesce(c(text_audio), (k + b) / 2) if text_audio is not None else (k + b) / 2
    total = max(w.emotion + w.identity + w.clip + w.imagebind + w.text_audio, 1e-8)
    return (w.emotion * e + w.identity * i + w.clip * k + w.imagebind * b + w.text_audio * t) / total


def passes(final, emotion, identity, has_reference, t: Thresholds = Thresholds()) -> Column:
    """Final and emotion scores reach their thresholds, the identity score only where there is a reference."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (c(final) >= t.final) & (c(emotion) >= t.emotion) & (~c(has_reference) | (c(identity) >= t.identity))


def related_table(spark) -> DataFrame:
    """(anchor_emotion, emotion): each category with itself and its relatives; a fixed table."""
    rows = [(a, b) for a in TAXONOMY for b in TAXONOMY if a == b or any(a in g and b in g for g in RELATED)]
    return spark.createDataFrame(rows, "anchor_emotion string, emotion string")


def numbered_pools(pool: DataFrame, id_col: str, source_col: str = "dataset_source") -> tuple[DataFrame, DataFrame]:
    """(rows with ``place`` from 0, emotion counts) in the order of taxonomy, source and id within each emotion.

    Places come from one sort of the pool by ranges, so neither an emotion nor a source is ever in one task. A pool for an anchor
    is the emotions related to it, one after another in the order of the taxonomy.
    """
    rows = in_order(pool, ["unified_emotion", source_col, id_col], Workspace(pool.sparkSession, "pool"))
    per = rows.groupBy("unified_emotion").agg(F.count(F.lit(1)).alias("n_emotion"), F.min("place").alias("_first"))
    rows = rows.join(F.broadcast(per.select("unified_emotion", "_first")), "unified_emotion")
    return rows.withColumn("place", F.col("place") - F.col("_first")).drop("_first"), per.drop("_first")


def looked_at(anchors: DataFrame, counts: DataFrame, salt: str, limit: int = LOOKED, related: bool = True) -> DataFrame:
    """(anchor columns, unified_emotion of the pool, place, ordinal): the strided sample of an anchor's pool.

    All of a pool up to ``limit``; of a larger one every (n // limit)-th place from the digest of ``salt:anchor id`` modulo n on,
    around the end. The pool holds the related emotions, or all of them.
    """
    spark = anchors.sparkSession
    kin = related_table(spark) if related else spark.createDataFrame([(a, b) for a in TAXONOMY for b in TAXONOMY], "anchor_emotion string, emotion string")
    rel = kin.join(F.broadcast(counts), F.col("emotion") == F.col("unified_emotion")).drop("unified_emotion")
    rel = rel.withColumn("t", taxonomy_index("emotion"))
    before = Window.partitionBy("anchor_emotion").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    rel = rel.withColumn("lo", F.coalesce(F.sum("n_emotion").over(before), F.lit(0)))
    total = rel.groupBy("anchor_emotion").agg(F.sum("n_emotion").alias("n"))
    a = anchors.join(F.broadcast(total), anchors.anchor_emotion == total.anchor_emotion).drop(total.anchor_emotion)
    start = F.when(F.col("n") <= limit, F.lit(0).cast("long")).otherwise(digest_mod(F.concat(F.lit(f"{salt}:"), F.col("anchor_id").cast("string")), F.col("n")))
    step = F.when(F.col("n") <= limit, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.col("n") / limit)))
    picks = let(start, lambda s: F.transform(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(limit)) - 1), lambda k: (s + k * step) % F.col("n")))
    a = a.select(*anchors.columns, F.posexplode(picks).alias("ordinal", "at"))
    joined = a.join(F.broadcast(rel), (a.anchor_emotion == rel.anchor_emotion) & (a["at"] >= rel.lo) & (a["at"] < rel.lo + rel.n_emotion))
    return joined.select(*[a[c] for c in anchors.columns], "ordinal", F.col("emotion").alias("unified_emotion"), (F.col("at") - F.col("lo")).alias("place"))


def candidates(anchors: DataFrame, pool: DataFrame, id_col: str, vec: str, salt: str, limit: int = LOOKED, kept: int = KEPT, related: bool = True, keep: str | None = None) -> DataFrame:
    """The ``kept`` most similar of the looked-at pool of every anchor, with emotion score and similarity.

    anchors(anchor_id, anchor_emotion, anchor_vec); pool(id_col, dataset_source, unified_emotion, vec, ...). Similarity falling,
    then the order in which the pool was looked at. Without ``related`` the pool holds every emotion and none is asked to match.
    ``keep`` names a column for the candidate's unit vector.
    """
    # unit vectors once per row, so that a pair costs one product; the zero vector has none and is similar to nothing
    unit = lambda c: F.when(norm(c) > 0, normalised(c))
    rows, counts = numbered_pools(pool.where(F.col("unified_emotion").isin(*TAXONOMY)).withColumn("_v", unit(vec)).drop(vec), id_col)
    seen = looked_at(anchors.withColumn("_a", unit("anchor_vec")).drop("anchor_vec"), counts, salt, limit, related).join(rows, ["unified_emotion", "place"])
    seen = seen.withColumn("emotion_score", emotion_match("anchor_emotion", "unified_emotion"))
    seen = seen.where("emotion_score > 0") if related else seen
    seen = seen.withColumn(keep, F.col("_v")) if keep else seen
    seen = seen.withColumn("similarity", F.round(F.when(F.col("_a").isNotNull() & F.col("_v").isNotNull(), clamp01((dot("_a", "_v") + 1) / 2)).otherwise(0.0), 9)).drop("_a", "_v")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("similarity"), F.desc("emotion_score"), "ordinal")
    return seen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= kept).drop("place")


#: Residues of one group of ``picked``; a group holds about LOOKED + 1 rows of the pool for each.
RESIDUES = 512
#: Up to so many shared vectors go to all workers.
SHARED_VECTORS = 50_000


def token_places(c) -> Column:
    """The places that ``vectors.token_vector`` counts, a character each from 0 on."""
    return F.array_join(F.transform(ascii_tokens(c), lambda w: F.char(
        48 + F.aggregate(F.transform(F.split(w, ""), lambda ch, i: (i + 1) * F.ascii(ch)), F.lit(0), lambda acc, x: acc + x) % 64)), "")


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, summed from the first component on; zero rows stay."""
    square = np.zeros(len(v))
    for k in range(v.shape[1]):
        square += v[:, k] * v[:, k]
    size = np.sqrt(square)[:, None]
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _places_units(places: Sequence[str]) -> np.ndarray:
    raw = np.frombuffer("".join(places).encode("ascii"), np.uint8).astype(np.int64) - 48
    owner = np.repeat(np.arange(len(places)), [len(x) for x in places])
    counts = np.bincount(owner * 64 + raw, minlength=64 * len(places)).reshape(-1, 64).astype(float)
    return _unit(_unit(counts))  # the token vector has length 1, and is divided by its length once more


def _round9(x: np.ndarray) -> np.ndarray:
    """To nine decimals, half up on the shortest decimal form, as ``round`` in SQL."""
    y = x * 1e9
    low = np.floor(y)
    out = np.floor(y + 0.5) / 1e9
    for at in zip(*np.nonzero(np.abs(y - low - 0.5) < 1e-5)):
        out[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def picked(
    anchors: DataFrame, pool: DataFrame, id_col: str, shared: np.ndarray, salt: str, score: Callable, carry: Sequence[str], limit: int = LOOKED, kept: int = KEPT, related: bool = True,
) -> DataFrame:
    """(anchor_id, <carry>, emotion_score, similarity, composite): ``chosen(candidates(...))`` without a row per anchor and looked-at row.

    anchors(anchor_id, anchor_emotion, anchor_slot, ...), pool(id_col, dataset_source, unified_emotion, slot or places, <carry>).
    A vector is a row of ``shared`` or the ``token_places`` of a text. The looked-at places of an anchor have one residue by the step
    of its pool, or another one after the end, so anchors and pool meet once each in groups of neighbouring residues.
    ``score(emotion_score, similarity, anchors, pool)`` gets arrays and rows of one shape; NaN leaves a row out.
    """
    spark = anchors.sparkSession
    ship(spark)
    ws = Workspace(spark, "picked")
    rows, counts = numbered_pools(pool.where(F.col("unified_emotion").isin(*TAXONOMY)), id_col)
    size = {r.unified_emotion: r.n_emotion for r in counts.collect()}  # a row per emotion
    kin = {a: tuple(b for b in TAXONOMY if b in size and (not related or a == b or any(a in g and b in g for g in RELATED))) for a in TAXONOMY}
    keys = {k: i for i, k in enumerate(sorted(set(kin.values())))}
    total = {k: sum(size[e] for e in k) for k in keys}
    of_anchor = [(a, keys[k], total[k], max(1, total[k] // limit)) for a, k in kin.items() if k]
    of_pool = [(e, keys[k], sum(size[x] for x in k[:i]), max(1, total[k] // limit), max(0, total[k] - limit * max(1, total[k] // limit))) for k in keys for i, e in enumerate(k)]
    a = anchors.join(F.broadcast(spark.createDataFrame(of_anchor, "anchor_emotion string, _k int, _n long, _step long")), "anchor_emotion")
    start = F.when(F.col("_n") <= limit, F.lit(0).cast("long")).otherwise(digest_mod(F.concat(F.lit(f"{salt}:"), F.col("anchor_id").cast("string")), F.col("_n")))
    whole = F.col("_n") <= limit
    a = a.withColumn("_start", start).withColumn("_g", F.when(whole, F.lit(0)).otherwise(F.floor(F.col("_start") % F.col("_step") / RESIDUES)).cast("int"))
    a = a.withColumn("_e", taxonomy_index("anchor_emotion").cast("int")).drop("anchor_emotion")
    p = rows.join(F.broadcast(spark.createDataFrame(of_pool, "unified_emotion string, _k int, _lo long, _step long, _more long")), "unified_emotion").withColumn("_at", F.col("place") + F.col("_lo"))
    group = lambda c: F.floor(c % F.col("_step") / RESIDUES).cast("int")
    p = p.withColumn("_g", F.explode(F.array_distinct(F.array(group(F.col("_at")), group(F.col("_at") + F.col("_more"))))))
    texts = "places" in pool.columns
    p = p.select("_k", "_g", "_at", taxonomy_index("unified_emotion").cast("int").alias("_e"), *dict.fromkeys([*carry, "places" if texts else "slot"]))
    match = np.array([[1.0 if x == y else 0.72 if any(x in g and y in g for g in RELATED) else 0.35 if "neutral" in (x, y) else 0.0 for y in TAXONOMY] for x in TAXONOMY])
    sent = spark.sparkContext.broadcast(_unit(shared))

    def run(a: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        names = ["anchor_id", *carry, "emotion_score", "similarity", "composite"]
        if not len(a) or not len(p):
            return pd.DataFrame({c: [] for c in names})
        p = p.sort_values("_at", ignore_index=True)
        at, pe, units = p["_at"].to_numpy(), p["_e"].to_numpy(), sent.value
        pv = _places_units(p["places"].tolist()) if texts else units[p["slot"].to_numpy()]
        columns, has = np.ascontiguousarray(pv.T), pv.any(1)
        n, step = int(a["_n"].iat[0]), int(a["_step"].iat[0])
        ordinal, out = np.arange(min(n, limit)), []
        for lo in range(0, len(a), 2_048):
            b = a.iloc[lo : lo + 2_048].reset_index(drop=True)
            i = np.searchsorted(at, (b["_start"].to_numpy()[:, None] + ordinal * step) % n)
            av = units[b["anchor_slot"].to_numpy()]
            dot = np.zeros(i.shape)
            for k in range(len(columns)):
                dot += av[:, k][:, None] * columns[k][i]
            sim = np.where(av.any(1)[:, None] & has[i], _round9(np.clip((dot + 1) / 2, 0.0, 1.0)), 0.0)
            e = match[b["_e"].to_numpy()[:, None], pe[i]]
            top = np.lexsort((np.broadcast_to(ordinal, i.shape), -e, -sim), axis=-1)[:, :kept]
            i, sim, e = (np.take_along_axis(x, top, 1) for x in (i, sim, e))
            c = np.where(np.isnan(s := score(e, sim, b, p, i)), -1.0, _round9(np.nan_to_num(s)))
            best = c.argmax(1)[:, None]
            i, sim, e, c = (np.take_along_axis(x, best, 1)[:, 0] for x in (i, sim, e, c))
            ok = c >= 0
            found = {"anchor_id": b["anchor_id"].to_numpy()[ok], **{x: p[x].to_numpy()[i[ok]] for x in carry}}
            out.append(pd.DataFrame({**found, "emotion_score": e[ok], "similarity": sim[ok], "composite": c[ok]}))
        return pd.concat(out, ignore_index=True)

    kinds = ", ".join(f"{c} {p.schema[c].dataType.simpleString()}" for c in carry)
    found = a.groupBy("_k", "_g").cogroup(p.groupBy("_k", "_g")).applyInPandas(
        run, f"anchor_id {anchors.schema['anchor_id'].dataType.simpleString()}, {kinds}, emotion_score double, similarity double, composite double")
    return ws.write(found, salt)


def chosen(found: DataFrame, score: Column) -> DataFrame:
    """The candidate of the highest composite score per anchor; ties by rank."""
    best = Window.partitionBy("anchor_id").orderBy(F.desc("composite"), "rank")
    return found.withColumn("composite", F.round(score, 9)).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def resolved_split(split, sample_id, train: float = 0.8, val: float = 0.1) -> Column:
    """The split where it is one, else the hashed one."""
    s = F.col(split) if isinstance(split, str) else split
    return F.when(s.isin("train", "val", "test"), s).otherwise(hash_split(sample_id, train, val))


def tuple_id(image, text, audio, reference) -> Column:
    c = lambda x: F.col(x).cast("string") if isinstance(x, str) else x.cast("string")
    return F.concat_ws("__", c(image), c(text), F.coalesce(c(audio), F.lit("noaudio")), F.coalesce(c(reference), F.lit("noref")))


def mode_flags(mask: str = "modality_mask") -> dict[str, Column]:
    """The four views of aligned samples by the modalities they need."""
    m = lambda x: F.coalesce(F.col(f"{mask}.{x}"), F.lit(False))
    return {
        "full_multimodal": m("has_image") & m("has_audio") & m("has_text"),
        "image_text": m("has_image") & m("has_text"),
        "image_audio": m("has_image") & m("has_audio"),
        "text_audio_image_reference": m("has_image") & m("has_audio") & m("has_text") & m("has_reference_image"),
    }


def quality(rows: DataFrame, least: float, need: tuple[str, ...] = (), score: str = "alignment_scores.final_score", mask: str = "modality_mask") -> DataFrame:
    """Rows whose score is at least ``least`` and that have the needed modalities (audio, text, reference_image). A null score or flag fails."""
    ok = F.col(score) >= least
    for m in need:
        ok = ok & F.coalesce(F.col(f"{mask}.has_{m}"), F.lit(False))
    return rows.where(ok)


def best_per_class(rows: DataFrame, by: str, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of every class in the given order."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank_in_class", F.row_number().over(w)).where(F.col("rank_in_class") <= limit)
