"""Agreement of modalities in prediction tables: prompts, scores, retrieval."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.vectors import raw_cosine
from tesserae.operators.metrics import first_column, mean_of
from tesserae.operators.reporting import numeric
from tesserae.workspace import ship

# The keys of a sample's stored scores and the columns they fill, and the names of columns of human judgement.
SCORE_COLUMNS = {
    "emotion_match_score": "alignment_emotion_match",
    "clip_similarity": "alignment_clip_similarity",
    "imagebind_similarity": "alignment_imagebind_similarity",
    "identity_similarity": "alignment_identity_similarity",
    "final_score": "alignment_final_score",
}
HUMAN_COLUMNS = ("human_score", "human_preference", "preference_score", "h_score")

#: Queries whose vectors are broadcast at once; more of them are worked off in blocks of this number.
QUERY_BLOCK = 4_096


def prompt_of(text, emotion) -> Column:
    """The text, or ``a {emotion} face`` where it is blank. A null emotion reads as blank."""
    c = lambda x: F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    return F.when(F.trim(c(text)) != "", c(text)).otherwise(F.concat(F.lit("a "), c(emotion), F.lit(" face")))


def with_stored_scores(df: DataFrame, column: str = "alignment_scores") -> DataFrame:
    """Adds the columns of SCORE_COLUMNS from a JSON text, as far as the table has none of that name. Unreadable text gives nulls."""
    if column not in df.columns:
        return df
    read = F.from_json(F.col(column).cast("string"), ", ".join(f"{k} string" for k in SCORE_COLUMNS))
    return df.select("*", *[read[k].try_cast("double").alias(c) for k, c in SCORE_COLUMNS.items() if c not in df.columns])


def prepared(df: DataFrame, split: str | None = None, cap: int | None = None) -> DataFrame:
    """The rows of a split (of all where it is not given or the table has no such column), the first ``cap`` by sample_id if there is a cap."""
    if split and "split" in df.columns:
        df = df.where(F.col("split") == split)
    return df.orderBy("sample_id").limit(cap) if cap and cap > 0 else df


def agreement(df: DataFrame, prompt: str, image: str, audio: str, reference: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, clip, ib, identity, human, consistency): means over rows of cosines between the vector columns.

    clip is that of prompt and image, ib half image and prompt plus half image and audio, identity (cosine + 1) / 2 of
    reference and image, consistency the mean of the three pairs of modalities. human is the mean of the first column of
    human judgement that the table has. A missing vector gives a row no cosine; a mean of no rows is null.
    """
    ti, ia, ta = raw_cosine(prompt, image), raw_cosine(image, audio), raw_cosine(prompt, audio)
    same = (raw_cosine(reference, image) + 1) / 2 if reference else F.lit(None).cast("double")
    judged = next((c for c in HUMAN_COLUMNS if c in df.columns), None)
    human = numeric(judged) if judged else first_column(df, ()).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), mean_of(ti).alias("clip"), mean_of(0.5 * ti + 0.5 * ia).alias("ib"), mean_of(same).alias("identity"),
        mean_of(human).alias("human"), mean_of((ti + ta + ia) / 3).alias("consistency"))


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def match_ranks(queries: DataFrame, base: DataFrame, id_col: str, query_vec: str, base_vec: str) -> DataFrame:
    """(query_id, rank): the place of a query's own row among all rows of ``base`` by cosine, ties by id; null if it is not there.

    Queries are a stated set, worked off in blocks whose vectors are broadcast. A partition of ``base`` only tells for each
    query how many of its rows stand before the match, so what is shuffled is a number per query and partition.
    """
    spark = queries.sparkSession
    ship(spark)
    own = queries.select(F.col(id_col).alias("id"), F.col(query_vec).cast("array<double>").alias("q")).where("q IS NOT NULL").join(
        base.select(F.col(id_col).alias("id"), F.col(base_vec).cast("array<double>").alias("b")).where("b IS NOT NULL"), "id")
    kind = queries.schema[id_col].dataType.simpleString()
    n_blocks = max(1, -(-own.count() // QUERY_BLOCK))
    own = own.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    found = None
    for k in range(n_blocks):
        pdf = own.where(F.col("_part") == k).orderBy("id").toPandas()  # about QUERY_BLOCK rows
        if not len(pdf):
            continue
        q, b = _unit(np.stack(pdf["q"].to_numpy())), _unit(np.stack(pdf["b"].to_numpy()))
        shared = spark.sparkContext.broadcast((pdf["id"].to_numpy(), q, (q * b).sum(axis=1).round(12)))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q, gold = shared.value
            before = np.zeros(len(ids), np.int64)
            for f in frames:
                if len(f):
                    sim, other = (q @ _unit(np.stack(f["b"].to_numpy())).T).round(12), f["id"].to_numpy()
                    before += ((sim > gold[:, None]) | ((sim == gold[:, None]) & (other[None] < ids[:, None]))).sum(axis=1)
            yield pd.DataFrame({"query_id": ids, "before": before})

        rows = base.select(F.col(id_col).alias("id"), F.col(base_vec).cast("array<double>").alias("b")).where("b IS NOT NULL")
        part = rows.mapInPandas(run, f"query_id {kind}, before long")
        found = part if found is None else found.unionByName(part)
    every = queries.select(F.col(id_col).alias("query_id")).distinct()
    if found is None:
        return every.withColumn("rank", F.lit(None).cast("long"))
    return every.join(found.groupBy("query_id").agg((F.sum("before") + 1).alias("rank")), "query_id", "left")


def retrieval_table(queries: DataFrame, base: DataFrame, id_col: str, image: str, others: dict[str, str], ks: Sequence[int] = (1, 5)) -> DataFrame:
    """(direction, k, n, recall): for each named column of ``base``, the share of queries whose own row is among the k nearest to their image."""
    out = None
    for name, column in others.items():
        r = match_ranks(queries, base, id_col, image, column)
        agg = r.agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.coalesce("rank", F.lit(1 << 60)) <= k).cast("double")).alias(str(k)) for k in ks])
        one = agg.select(F.lit(name).alias("direction"), "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("recall")) for k in ks])).alias("x"))
        one = one.select("direction", "x.k", "n", "x.recall")
        out = one if out is None else out.unionByName(one)
    return out
