"""Similarity pairs within blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import ascii_tokens, token_line
from tesserae.operators.skew import HEAVY_LIMIT
from tesserae.workspace import Workspace, ship


def classes(rows: DataFrame, key: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(representatives, membership) of exact copies by ``key``: one row per distinct value with its least id and number of rows."""
    have = rows.where(F.col(key).isNotNull())
    reps = Workspace(rows.sparkSession, "classes").write(have.groupBy(key).agg(F.min(id_col).alias("class_id"), F.count(F.lit(1)).alias("n_rows")), "reps")
    return reps, have.join(reps.select(key, "class_id"), key).select(id_col, "class_id")


#: A block of more rows is compared in parts of about so many, each two parts in a place of their own.
BLOCK_ROWS = 4_096


def _parts_of_blocks(base: DataFrame, block: Sequence[str]) -> DataFrame | None:
    """(block..., _parts) of the blocks of more than BLOCK_ROWS rows, written and broadcast if they are few; None if there are none."""
    sizes = base.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK_ROWS)
    for c in block:
        sizes = sizes.where(F.col(c).isNotNull())
    large = Workspace(base.sparkSession, "blocks").write(sizes.select(*block, F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("_parts")), "large")
    n = large.count()
    if not n:
        return None
    return F.broadcast(large) if n <= HEAVY_LIMIT else large


def blocked_pairs(
    rows: DataFrame, block: Sequence[str], id_col: str, carry: Sequence[str], accept, different: Sequence[str] = (),
    max_rows: int | None = None, max_visits: int | None = None,
) -> DataFrame:
    """(left_id, right_id, left_<carry>..., right_<carry>...) of rows of one block with left_id < right_id that ``accept``.

    ``accept(left, right)`` gets two functions from a carried column's name to a column. Rows with a null in the block pair
    with nothing. ``different`` names columns whose values must differ. ``max_rows`` and ``max_visits`` reproduce a bounded
    comparison: only the first rows of a block by id take part, and only that many pairs in (i, j) order are looked at, those
    of equal ``different`` columns included. By default nothing is bounded.
    """
    keep = [*dict.fromkeys([*carry, *different])]
    base = rows.select(*block, F.col(id_col).alias("_id"), *keep)
    if max_rows is not None or max_visits is not None:
        order = Window.partitionBy(*block).orderBy("_id")
        base = base.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*block)))
        if max_rows is not None:
            base = base.where(F.col("_i") < max_rows).withColumn("_n", F.least("_n", F.lit(max_rows)))
        keep = [*keep, "_i", "_n"]
    a = base.select(*block, F.col("_id").alias("left_id"), *[F.col(c).alias(f"left_{c}") for c in keep])
    b = base.select(*block, F.col("_id").alias("right_id"), *[F.col(c).alias(f"right_{c}") for c in keep])
    parts = _parts_of_blocks(base, block)
    if parts is None:
        pairs = a.join(b, list(block)).where("left_id < right_id")
    else:
        # every row of the left stands in its own part against all parts of the right, so each two rows meet in one place
        every = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
        own = lambda c: F.pmod(F.xxhash64(c), F.coalesce("_parts", F.lit(1))).cast("int")
        a = a.join(parts, list(block), "left").withColumn("_p", own("left_id")).withColumn("_q", F.explode(every)).drop("_parts")
        b = b.join(parts, list(block), "left").withColumn("_q", own("right_id")).withColumn("_p", F.explode(every)).drop("_parts")
        pairs = a.join(b, [*block, "_p", "_q"]).where("left_id < right_id").drop("_p", "_q")
    if max_visits is not None:
        i, j, n = F.col("left__i"), F.col("right__i"), F.col("left__n")
        pairs = pairs.where((i * n - F.floor(i * (i + 1) / 2) + (j - i)) <= max_visits)
    for c in different:
        pairs = pairs.where(F.col(f"left_{c}") != F.col(f"right_{c}"))
    ok = accept(lambda c: F.col(f"left_{c}"), lambda c: F.col(f"right_{c}"))
    return pairs.where(ok).drop("left__i", "right__i", "left__n", "right__n")


def text_block(text, emotion) -> list[Column]:
    """Block of a text: its first two tokens, its length in eights up to 20, and its emotion."""
    t = ascii_tokens(text)
    return [
        F.get(t, 0).alias("token1"), F.get(t, 1).alias("token2"),
        F.least(F.floor(F.size(t) / 8), F.lit(20)).alias("band"), F.col(emotion).alias("emotion"),
    ]


def with_ratio(pairs: DataFrame, a: str, b: str, name: str = "ratio") -> DataFrame:
    """Adds the matching-blocks ratio of two texts (their normalised lines), as sequence matchers define it."""
    ship(pairs.sparkSession)

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)])

    return pairs.withColumn(name, ratio(token_line(a), token_line(b)))


#: Characters of normalised lines, and how many rows of a block are compared with how many at once.
_ALPHABET = " '0123456789abcdefghijklmnopqrstuvwxyz"
_TILE = 2_048


def line_vectors(lines: Sequence[str]) -> np.ndarray:
    """``vectors.token_vector`` of normalised lines, equal to it to the last bit."""
    n, at = pd.factorize(np.array([w for x in lines for w in x.split(" ")], dtype=object))
    place = np.fromiter((sum(i * ord(c) for i, c in enumerate(w, 1)) % 64 for w in at), np.int64, len(at))
    owner = np.repeat(np.arange(len(lines)), [x.count(" ") + 1 for x in lines])
    counts = np.bincount(owner * 64 + place[n], minlength=64 * len(lines)).reshape(-1, 64).astype(float)
    return counts / np.sqrt((counts * counts).sum(1, keepdims=True))


def _characters(lines: Sequence[str]) -> np.ndarray:
    raw = np.frombuffer("".join(lines).encode("ascii"), np.uint8)
    code = np.zeros(128, np.int64)
    code[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    k = len(_ALPHABET)
    return np.bincount(owner * k + code[raw], minlength=k * len(lines)).reshape(-1, k).astype(np.float32)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row products, summed from the first component on as ``vectors.dot`` does."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, which no sum of matching blocks exceeds."""
    where: dict[str, int] = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def _ratio(a: str, b: str, least: float = 0.0) -> float:
    """The matching-blocks ratio, or -1.0 where a bound shows it to be below ``least``."""
    from difflib import SequenceMatcher

    if least and 2.0 * _subsequence(a, b) / (len(a) + len(b)) < least:
        return -1.0
    return SequenceMatcher(None, a, b).ratio()


def _close_in_blocks(f: pd.DataFrame, cut: Sequence[int], cosine: float, ratio: float, unit: bool, both: bool) -> pd.DataFrame:
    """The close pairs of the blocks (or pairs of parts of one) that begin at ``cut[:-1]``: see ``close_lines``."""
    f = f.iloc[: cut[-1]]
    lines, ids, own = f["line"].tolist(), f["id"].to_numpy(), f["own"].to_numpy()
    side = pd.factorize(f["side"])[0] if "side" in f else None
    v, c, size = line_vectors(lines), _characters(lines), np.array([len(x) for x in lines], np.float32)
    v32, square, parted = v.astype(np.float32), (c * c).sum(1), (f["_p"] != f["_q"]).to_numpy()
    found = []
    for first, last in zip(cut, cut[1:]):
        for lo in range(first, last if last - first > 1 else first, _TILE):
            for up in range(lo, last, _TILE):
                a, b = slice(lo, min(lo + _TILE, last)), slice(up, min(up + _TILE, last))
                total = size[a][:, None] + size[b][None]
                # the distance of the counts of characters bounds the ratio, and is at least their Euclidean distance
                far = square[a][:, None] + square[b][None] - 2 * (c[a] @ c[b].T)
                hit = (v32[a] @ v32[b].T >= 2 * cosine - 1 - 1e-4) | (far <= ((1 - ratio) * total + 1e-2) ** 2)
                if side is not None:
                    hit &= side[a][:, None] != side[b][None]
                if parted[first]:
                    hit &= own[a][:, None] != own[b][None]
                i, j = np.nonzero(np.triu(hit, 1) if lo == up else hit)
                if len(i):
                    found.append((i + lo, j + up))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
    out, length = [], np.sqrt(_in_order(v, v))
    for k in range(0, len(i), 100_000):
        p, q = i[k : k + 100_000], j[k : k + 100_000]
        dot = _in_order(v[p], v[q])
        sim = np.clip(((dot / (length[p] * length[q]) if unit else dot) + 1) / 2, 0.0, 1.0)
        near, apart, total = sim >= cosine, np.abs(c[p] - c[q]).sum(1), size[p] + size[q]
        may = near | ((total - apart) / total >= ratio - 1e-6)
        p, q, sim, near = p[may], q[may], sim[may], near[may]
        if both:  # only whether they are close, in either direction
            there = np.array([n or _ratio(lines[x], lines[y], ratio) >= ratio for x, y, n in zip(p, q, near)], bool)
            back = np.array([n or _ratio(lines[y], lines[x], ratio) >= ratio for x, y, n in zip(p, q, near)], bool)
            ok = there | back
            out.append(pd.DataFrame({"left_id": ids[p[ok]], "right_id": ids[q[ok]], "there": there[ok], "back": back[ok]}))
        else:
            r = np.array([_ratio(lines[x], lines[y], 0.0 if n else ratio) for x, y, n in zip(p, q, near)], float)
            ok = near | (r >= ratio)
            out.append(pd.DataFrame({"left_id": ids[p[ok]], "right_id": ids[q[ok]], "similarity": sim[ok], "ratio": r[ok]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame()


def close_lines(rows: DataFrame, block: Sequence[str], id_col: str, line: str, cosine: float, ratio: float, different: str | None = None, both: bool = False, unit: bool = False) -> DataFrame:
    """Pairs of normalised lines (not empty) of one block, left_id < right_id, with a unit cosine of ``cosine`` or a matching-blocks ratio of ``ratio``.

    (left_id, right_id, similarity, ratio), the ratio of left against right; with ``both`` (left_id, right_id, there, back): whether they
    are close, and whether they are with the right one first. All pairs of a block are compared, by products of matrices; the ratio is
    only worked out for pairs that bounds (counts of characters, common subsequence) leave. ``different`` names a column whose values
    must differ, ``unit`` divides the cosine by the vectors' lengths once more, as ``vectors.cosine_same_size`` does. Large blocks are
    dealt out in parts.
    """
    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    base = rows.select(*block, F.col(id_col).alias("id"), F.col(line).alias("line"), *([F.col(different).alias("side")] if different else []))
    for c in [*block, *(["side"] if different else [])]:
        base = base.where(F.col(c).isNotNull())
    parts = _parts_of_blocks(base, block)
    if parts is None:
        base = base.withColumns({"own": F.lit(0), "_p": F.lit(0), "_q": F.lit(0)})
    else:
        # a row of part o stands in the places (least, greatest) of o and every part: two parts meet in one place
        base = base.join(parts, list(block), "left").withColumn("own", F.pmod(F.xxhash64("id"), F.coalesce("_parts", F.lit(1))).cast("int"))
        base = base.withColumn("_o", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        base = base.withColumn("_p", F.least("own", "_o")).withColumn("_q", F.greatest("own", "_o")).drop("_parts", "_o")
    place = [*block, "_p", "_q"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by number: the work grows with the square of a block, so few bytes are no reason for few tasks
    base = base.repartition(n, *place).sortWithinPartitions(*place)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            new = np.zeros(len(f), bool)
            for c in place:
                x = f[c].to_numpy()
                new[1:] |= x[1:] != x[:-1]
            cut = [0, *np.flatnonzero(new).tolist()]
            rest = f.iloc[cut[-1] :]
            if len(cut) > 1 and len(out := _close_in_blocks(f, cut, cosine, ratio, unit, both)):
                yield out
        if rest is not None and len(out := _close_in_blocks(rest, [0, len(rest)], cosine, ratio, unit, both)):
            yield out

    found = "there boolean, back boolean" if both else "similarity double, ratio double"
    return base.mapInPandas(run, f"left_id {kind}, right_id {kind}, {found}")


def leader_clusters(rows: DataFrame, block: str, id_col: str, vec: str, least_cosine: float) -> DataFrame:
    """(id, leader): greedy leader clusters within blocks, in order of id: the first free row leads and takes all free rows at least that close."""
    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", ignore_index=True)
        m = np.stack([np.asarray(v, float) for v in f["vec"]])
        size = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
        leader = np.full(len(f), -1)
        for i in range(len(f)):
            if leader[i] < 0:
                near = (m @ m[i] + 1) / 2 >= least_cosine
                near[i] = True
                leader[(leader < 0) & near] = i
        return pd.DataFrame({"id": f["id"], "leader": f["id"].to_numpy()[leader]})

    have = rows.where(F.col(vec).isNotNull()).select(F.col(block).alias("block"), F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    return have.groupBy("block").applyInPandas(run, f"id {kind}, leader {kind}")


#: Queries whose vectors are broadcast at once.
QUERY_PART = 20_000


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def nearest(queries: DataFrame, base: DataFrame, id_col: str, vec: str, k: int, block_rows: int = 1024) -> DataFrame:
    """(query_id, neighbour_id, similarity, rank): the k nearest rows of ``base`` by unit cosine, ties by id, a row never its own neighbour.

    The stated queries are worked off in parts of about QUERY_PART, whose vectors are broadcast; each partition of ``base`` keeps
    its own k best per query, so what is shuffled is k rows per query and partition.
    """
    ship(queries.sparkSession)
    q = queries.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    rows = base.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    n_parts, cand = max(1, -(-q.count() // QUERY_PART)), None
    for part in range(n_parts):
        pdf = q.where(F.pmod(F.xxhash64("id"), F.lit(n_parts)) == part).orderBy("id").toPandas()
        ids = pdf["id"].to_numpy()
        shared = queries.sparkSession.sparkContext.broadcast((ids, _unit(np.stack(pdf["v"].to_numpy())) if len(pdf) else np.zeros((0, 1))))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            for f in frames:
                if not len(f) or not len(ids):
                    continue
                f = f.sort_values("id", ignore_index=True)
                x, other = _unit(np.stack(f["v"].to_numpy())), f["id"].to_numpy()
                for lo in range(0, len(ids), block_rows):
                    sim = np.clip((m[lo : lo + block_rows] @ x.T + 1) / 2, 0, 1).round(12)
                    sim[ids[lo : lo + block_rows][:, None] == other[None]] = -1
                    top = min(k, sim.shape[1])
                    # all that reach the k-th best similarity, so that no tie is lost; the ranks below settle them by id
                    least = np.partition(sim, sim.shape[1] - top, axis=1)[:, -top]
                    r, c = np.nonzero(sim >= least[:, None])
                    yield pd.DataFrame({"query_id": ids[lo + r], "neighbour_id": other[c], "similarity": sim[r, c]})

        one = rows.mapInPandas(run, "query_id long, neighbour_id long, similarity double").where("similarity >= 0")
        cand = one if cand is None else cand.unionByName(one)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return cand.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
