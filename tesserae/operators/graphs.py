"""Graphs over rows and classes, as edge tables."""

from __future__ import annotations



from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.blocking import nearest
from tesserae.workspace import Workspace, ship

#: Dense kernels (all-pairs paths) are for graphs of up to so many vertices.
DENSE_VERTICES = 2000


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): both directions of every edge, the larger weight where they differ; loops and weights of 0 drop out."""
    both = edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.where((F.col("weight") > 0) & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


#: The nodes of the modality graph, in order.
NODES = ("text", "identity", "emotion", "image", "audio")
# The nodes that an ablation switches off.
ABLATIONS = {
    "no_identity_branch": ("identity",),
    "no_audio": ("audio",),
    "text_only": ("identity", "emotion", "image", "audio"),
    "image_text": ("emotion", "audio"),
    "text_audio": ("identity", "image"),
}


def node_mask(has_reference, has_audio, ablations: Sequence[str] = ()) -> Column:
    """Which of NODES take part: identity needs a reference image, audio a sound; ablations switch nodes off."""
    off = {n for a in ablations for n in ABLATIONS[a]}
    have = {"identity": F.coalesce(F.col(has_reference), F.lit(False)), "audio": F.coalesce(F.col(has_audio), F.lit(False))}
    return F.array(*[F.lit(0.0) if n in off else have.get(n, F.lit(True)).cast("double") for n in NODES])


def knn_graph(rows: DataFrame, id_col: str, vec: str, k: int = 10) -> DataFrame:
    """Each row with its k nearest by unit cosine, made symmetric. All rows are queries, in parts of what is broadcast at once."""
    have = rows.where(F.col(vec).isNotNull())
    parts = max(1, -(-have.count() // 100_000))
    found = None
    for p in range(parts):
        q = have if parts == 1 else have.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == p)
        one = nearest(q, have, id_col, vec, k).select(F.col("query_id").alias("src"), F.col("neighbour_id").alias("dst"), F.col("similarity").alias("weight"))
        found = one if found is None else found.unionByName(one)
    return symmetric(found)


def edge_list(graph: DataFrame) -> DataFrame:
    """Each undirected edge once, from the smaller id."""
    return graph.where((F.col("src") < F.col("dst")) & (F.col("weight") > 0))


def with_identity(graph: DataFrame, rows: DataFrame, id_col: str, key: str) -> DataFrame:
    """The graph with rows of one key linked at weight 1 through their least row (a star keeps them connected without all pairs)."""
    have = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(id_col).alias("dst"))
    least = Workspace(rows.sparkSession, "identity").write(have.groupBy("k").agg(F.min("dst").alias("src")), "least")
    star = have.join(least, "k").where("src <> dst").select("src", "dst", F.lit(1.0).alias("weight"))
    return symmetric(graph.select("src", "dst", "weight").unionByName(star))


def class_graph(prototypes: DataFrame, k: int = 3) -> DataFrame:
    """Graph of a few classes, prototypes(name, valence, arousal): similarity 1 / (1 + distance), each with its k nearest, made symmetric."""
    a = prototypes.select(F.col("name").alias("src"), F.col("valence").alias("v1"), F.col("arousal").alias("a1"), F.lit(1).alias("_k"))
    b = prototypes.select(F.col("name").alias("dst"), F.col("valence").alias("v2"), F.col("arousal").alias("a2"), F.lit(1).alias("_k"))
    d = F.sqrt((F.col("v1") - F.col("v2")) ** 2 + (F.col("a1") - F.col("a2")) ** 2)
    pairs = a.join(F.broadcast(b), "_k").where("src <> dst").select("src", "dst", (1 / (1 + d)).alias("weight"))
    best = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return symmetric(pairs.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k))


def shortest_paths(graph: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """(src, dst, distance): lengths of the shortest paths over 1 / (weight + epsilon), divided by the largest (at least 1); 1.0 where there is none.

    A dense kernel in one task, for graphs of up to DENSE_VERTICES vertices (classes, anchors); larger ones are refused.
    """
    ship(graph.sparkSession)
    kind = graph.schema["src"].dataType.simpleString()
    n = graph.select("src").union(graph.select("dst")).distinct().count()
    if n > DENSE_VERTICES:
        raise ValueError(f"{n} vertices are too many for all pairs")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(f["src"]) | set(f["dst"]))
        at = {x: i for i, x in enumerate(names)}
        d = np.full((len(names), len(names)), np.inf)
        np.fill_diagonal(d, 0.0)
        for s, t, w in zip(f["src"], f["dst"], f["weight"]):
            d[at[s], at[t]] = min(d[at[s], at[t]], 1 / (w + epsilon))
        for k in range(len(names)):
            d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
        top = max(1.0, d[np.isfinite(d)].max(initial=0.0))
        d = np.where(np.isfinite(d), d / top, 1.0)
        i, j = np.indices(d.shape)
        return pd.DataFrame({"src": [names[x] for x in i.ravel()], "dst": [names[x] for x in j.ravel()], "distance": d.ravel()})

    return graph.select("src", "dst", "weight", F.lit(1).alias("_one")).groupBy("_one").applyInPandas(
        lambda f: run(f), f"src {kind}, dst {kind}, distance double")


def fully_connected(graph: DataFrame, vertices: DataFrame, default: float = 0.25) -> DataFrame:
    """Every two of a few vertices(name) linked at the median weight of the graph."""
    median = graph.agg(F.coalesce(F.percentile("weight", 0.5), F.lit(default)).alias("w")).first().w
    a, b = vertices.select(F.col("name").alias("src"), F.lit(1).alias("_k")), vertices.select(F.col("name").alias("dst"), F.lit(1).alias("_k"))
    return a.join(F.broadcast(b), "_k").where("src <> dst").select("src", "dst", F.lit(median).alias("weight"))


def thinned(graph: DataFrame, k: int) -> DataFrame:
    """The k heaviest edges of every vertex, made symmetric."""
    best = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return symmetric(graph.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k))


def perturbed(graph: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """The graph without max(1, floor(edges x share)) of its undirected edges, drawn by a seeded hash."""
    once = edge_list(graph)
    n = once.count()
    gone = once.orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(max(1, int(n * share)) if n else 0).select("src", "dst")
    return symmetric(once.join(gone, ["src", "dst"], "left_anti"))


def graph_facts(graph: DataFrame) -> DataFrame:
    """One row (n_vertices, n_edges, has_loops)."""
    ends = graph.select("src").union(graph.select("dst"))
    n = ends.agg(F.countDistinct("src").alias("n_vertices")).first().n_vertices
    return graph.agg(F.lit(n).cast("long").alias("n_vertices"), F.count_if(F.col("src") < F.col("dst")).alias("n_edges"), F.coalesce(F.bool_or(F.col("src") == F.col("dst")), F.lit(False)).alias("has_loops"))


def path_between(graph: DataFrame, source, target, epsilon: float = 1e-6) -> list:
    """The vertices of the shortest path in a small graph; [source, target] where there is none."""
    import heapq

    if graph.count() > DENSE_VERTICES**2:
        raise ValueError("too many edges for a path on the driver")
    near: dict = {}
    for r in graph.collect():  # at most DENSE_VERTICES squared edges
        near.setdefault(r.src, []).append((r.dst, 1 / (r.weight + epsilon)))
    best, heap = {source: (0.0, None)}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u][0]:
            continue
        for v, w in near.get(u, []):
            if v not in best or d + w < best[v][0]:
                best[v] = (d + w, u)
                heapq.heappush(heap, (d + w, v))
    if target not in best:
        return [source, target]
    path = [target]
    while path[-1] != source:
        path.append(best[path[-1]][1])
    return path[::-1]


def gromov_wasserstein(costs: DataFrame, group: str, regular: float = 0.05, outer: int = 20, inner: int = 50) -> DataFrame:
    """(group, distance): the entropic Gromov-Wasserstein distance of two small cost matrices per group.

    costs(group, side in {a, b}, i, j, cost): dense matrices; each group is one small task.
    """
    ship(costs.sparkSession)
    kind = costs.schema[group].dataType.simpleString()

    def dense(f: pd.DataFrame) -> np.ndarray:
        n = int(max(f["i"].max(), f["j"].max())) + 1
        m = np.zeros((n, n))
        m[f["i"], f["j"]] = f["cost"]
        return m

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a, b = dense(f[f["side"] == "a"]), dense(f[f["side"] == "b"])
        p, q = np.full(len(a), 1 / len(a)), np.full(len(b), 1 / len(b))
        plan = np.outer(p, q)
        const = (a**2 @ p)[:, None] + (b**2 @ q)[None]
        for _ in range(outer):
            k = np.exp(-(const - 2 * a @ plan @ b.T) / regular)
            u, v = np.ones_like(p), np.ones_like(q)
            for _ in range(inner):
                u = p / np.maximum(k @ v, 1e-12)
                v = q / np.maximum(k.T @ u, 1e-12)
            plan = u[:, None] * k * v[None]
        return pd.DataFrame({group: [f[group].iloc[0]], "distance": [float(((const - 2 * a @ plan @ b.T) * plan).sum())]})

    return costs.groupBy(group).applyInPandas(run, f"{group} {kind}, distance double")


def adjacency_from(vectors: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    """(id, i, j, weight): cosines of the present vectors of a row, two by two, negative ones 0: one small graph per row."""
    from tesserae.functions.vectors import raw_cosine

    cells = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.greatest(F.lit(0.0), raw_cosine(a, b)).alias("weight"))
        for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    return vectors.select(id_col, F.explode(F.array(*cells)).alias("x")).select(id_col, "x.i", "x.j", "x.weight").where("weight IS NOT NULL")


