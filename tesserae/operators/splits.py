"""Leakage-safe splits: hard links, groups, assignment, soft conflicts, repair and validation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import vectors as V
from tesserae.functions.hashing import digest_mod
from tesserae.functions.labels import SPLITS
from tesserae.functions.text import token_line
from tesserae.operators.blocking import blocked_pairs
from tesserae.operators.components import connected_components, labelled, star_edges
from tesserae.operators.skew import in_order
from tesserae.workspace import Workspace, ship


# The weights of the misses in the balanced assignment, and what a first source and a split of few emotions take off.
SIZE_WEIGHT = 1.8
BALANCE = {"emotions": 1.2, "sources": 1.0, "modes": 0.6}
NEW_SOURCE, FEW_EMOTIONS = 0.1, 0.05


@dataclass(frozen=True)
class Policy:
    """Knobs of the split builder. ``seed``, ``batch_size`` and ``text_similarity`` are accepted and change nothing."""

    train: float = 0.70
    val: float = 0.15
    test: float = 0.15
    reserve: float = 1.0
    audio_rows: int = 32
    audio_identities: int = 8
    audio_texts: int = 32
    audio_links: bool = True
    max_group_size: int = 5000
    max_group_share: float = 0.35
    share_rule_from: int = 1000
    quarantine_oversized: bool = False
    drop_ambiguous: bool = False
    reassign_up_to: int = 48
    drop_up_to: int = 128
    prefer_train: bool = False
    ambiguous_from: int = 4
    drop_from_warnings: int = 8
    drop_from_kinds: int = 1
    winner_ratio: float = 0.15
    rounds: int = 7
    deviation: float = 0.08
    hash_bits: int = 2
    face_similarity: float = 0.98
    audio_similarity: float = 0.97
    image_similarity: float = 0.985
    proxy_similarity: float = 0.992
    seed: int = 0
    batch_size: int = 128
    text_similarity: float = 0.98

    def __post_init__(self):
        if abs(self.train + self.val + self.test - 1) > 1e-6:
            raise ValueError("the shares of the splits must add up to 1")


def audio_buckets(samples: DataFrame, policy: Policy = Policy(), key: str = "audio_path") -> DataFrame:
    """(key, n_rows, n_identities, n_speakers, n_texts, refusal): whether rows of one audio may be linked, and the first reason why not."""
    text = token_line("text")
    out = samples.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("identity_id").alias("n_identities"), F.countDistinct("speaker_id").alias("n_speakers"),
        F.countDistinct(F.when(text != "", text)).alias("n_texts"))
    reason = (
        F.when(F.lit(not policy.audio_links), "disabled").when(F.col("n_rows") > policy.audio_rows, "group_size")
        .when(F.col("n_identities") > policy.audio_identities, "distinct_identities").when(F.col("n_texts") > policy.audio_texts, "distinct_texts"))
    return out.withColumn("refusal", reason)


def hard_edges(samples: DataFrame, policy: Policy = Policy(), id_col: str = "record_id", pair_keys: Sequence[str] = (), link_keys: Sequence[str] = ()) -> DataFrame:
    """(left, right, rule, value): star edges of every hard rule. ``pair_keys`` and ``link_keys`` name explicit link columns, whose values are told apart by column."""
    ok = Workspace(samples.sparkSession, "audio").write(audio_buckets(samples, policy).where("refusal IS NULL AND n_rows > 1").select("audio_path"), "ok")
    linkable = samples.join(ok, "audio_path", "left_semi")
    parts = [star_edges(samples, k, id_col, r) for k, r in (("sample_id", "sample_id"), ("identity_id", "identity_id"), ("speaker_id", "speaker_id"), ("image_path", "image_hash"))]
    parts.append(star_edges(linkable, "audio_path", id_col, "audio_hash"))
    for keys, rule in ((pair_keys, "explicit_pair_metadata"), (link_keys, "reference_target_link")):
        for k in keys:
            parts.append(star_edges(samples.withColumn("_k", F.concat(F.lit(f"{k}:"), F.col(k))), "_k", id_col, rule))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grouped(samples: DataFrame, edges: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Samples with ``group_id``: the least id of all that are linked directly or indirectly."""
    return labelled(samples, id_col, edges).withColumnRenamed("component", "group_id")


def group_table(members: DataFrame, maps: bool = True) -> DataFrame:
    """(group_id, size, n_splits, n_sources, n_emotions, n_image, n_audio, n_text, emotions, sources): the summary of each group; the last two are maps of counts, left out without ``maps``."""
    def counter(c: str) -> Column:
        return F.map_from_entries(F.collect_list(F.struct(c, "n")))

    base = members.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("size"), F.countDistinct("split").alias("n_splits"), F.countDistinct("dataset_source").alias("n_sources"),
        F.countDistinct("unified_emotion").alias("n_emotions"), F.count_if("has_image").alias("n_image"), F.count_if("has_audio").alias("n_audio"), F.count_if("has_text").alias("n_text"))
    for name, c in (("emotions", "unified_emotion"), ("sources", "dataset_source")) if maps else ():  # bounded by taxonomy and sources
        m = members.where(F.col(c).isNotNull()).groupBy("group_id", c).agg(F.count(F.lit(1)).alias("n")).groupBy("group_id").agg(counter(c).alias(name))
        base = base.join(m, "group_id", "left")
    return base


def drop_reason(policy: Policy, total: Column) -> Column:
    """Why a group is left out of the assignment, or null."""
    big = (F.col("size") > policy.max_group_size) | ((total >= policy.share_rule_from) & (F.col("size") / total > policy.max_group_share))
    return F.when(F.lit(policy.quarantine_oversized) & big, "oversized_hard_group").when(
        F.lit(policy.drop_ambiguous) & (F.col("n_splits") > 2), "ambiguous_existing_split_links")


def with_drop_reason(groups: DataFrame, policy: Policy) -> DataFrame:
    """Groups with ``reason`` (null for those that go on to the assignment); shares are of the rows of all groups."""
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return groups.withColumn("reason", drop_reason(policy, F.lit(total)))


def kept(groups: DataFrame, policy: Policy) -> DataFrame:
    """The groups that go on to the assignment."""
    return with_drop_reason(groups, policy).where("reason IS NULL").drop("reason")


def targets(total: int, policy: Policy, reserved: bool) -> dict[str, float]:
    val, test = total * policy.val, total * policy.test
    if reserved:
        val, test = val * policy.reserve, test * policy.reserve
        return {"train": max(0.0, total - val - test), "val": val, "test": test}
    return {"train": total * policy.train, "val": val, "test": test}


def reserved_segments(classes: Sequence[tuple[int, int]], goal: Mapping[str, float], have: dict[str, int]) -> list[tuple[int, int, int, str, str]]:
    """(size, start, end, first, second) for classes (size, number) of equal groups in falling size: who gets the groups from place
    ``start`` to ``end`` of the whole order, first and second by turns. What no segment names stays train.

    Each group goes to the one of val and test that lacks most (ties: fewer rows so far, then the later name) while one lacks any.
    Groups of one size are alike, so runs are counted instead of walked: first the one that lacks more until they are level,
    then by turns, then what is left.
    """
    out, at = [], 0
    lack = lambda s: goal[s] - have[s]

    def give(size: int, n: int, first: str, second: str | None = None) -> None:
        nonlocal at, k
        out.append((size, at, at + n, first, second or first))
        have[first] += size * (n if second is None else n // 2)
        if second:
            have[second] += size * (n // 2)
        at, k = at + n, k - n

    for size, k in classes:
        while k:
            open_ = [s for s in ("val", "test") if lack(s) > 0]
            if not open_:
                return out
            first = max(open_, key=lambda s: (lack(s), -have[s], s))
            if len(open_) == 1:
                give(size, min(k, max(1, math.floor(lack(first) / size))), first)
                continue
            second = "val" if first == "test" else "test"
            ahead = lack(first) - lack(second)
            if ahead >= size:
                give(size, min(k, math.floor(ahead / size)), first)
            elif (turns := min(k // 2, math.floor(lack(second) / size) - 1)) > 0:
                give(size, 2 * turns, first, second)
            else:
                give(size, 1, first)
    return out


def assign_reserved(groups: DataFrame, policy: Policy = Policy(reserve=1.04)) -> DataFrame:
    """(group_id, size, split): val and test are filled first, everything else is train.

    Val, then test, take the group nearest to their target (ties: the least id). The other groups come in order of size, existing
    splits and sources (all falling) and id; each goes to the evaluation split that lacks most (ties: fewer rows so far, then the
    later name) while one lacks any. Only sizes decide, so the order is folded over its distinct sizes (at most the square root
    of twice the rows) and groups find their split by their place in it; no task holds the groups.
    """
    ws = Workspace(groups.sparkSession, "reserved")
    slim = ws.write(groups.select("group_id", "size", "n_splits", "n_sources"), "groups")
    goal, have, taken = targets(int(slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]), policy, True), {"val": 0, "test": 0}, []
    for s in ("val", "test"):
        free = slim.where(~F.col("group_id").isin([r.group_id for r, _ in taken])) if taken else slim
        best = free.agg(F.min(F.struct((F.abs(F.col("size") - goal[s]) / max(goal[s], 1.0)).alias("d"), "group_id", "size")).alias("x")).first().x
        if best is not None:
            taken.append((best, s))
            have[s] += best["size"]
    rest = slim.where(~F.col("group_id").isin([r.group_id for r, _ in taken])) if taken else slim
    order = {"_size": -F.col("size"), "_splits": -F.col("n_splits"), "_sources": -F.col("n_sources")}
    rest = in_order(rest.withColumns(order), [*order, "group_id"], ws)
    classes = [(r["size"], r.n) for r in rest.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()]
    segments = groups.sparkSession.createDataFrame(reserved_segments(classes, goal, have), "size long, start long, end long, first string, second string")
    per_size = segments.groupBy("size").agg(F.collect_list(F.struct("start", "end", "first", "second")).alias("segments"))  # a handful per size
    mine = F.get(F.filter("segments", lambda x: (x["start"] <= F.col("place")) & (F.col("place") < x["end"])), 0)
    pick = F.when(mine.isNull(), "train").when((F.col("place") - mine["start"]) % 2 == 0, mine["first"]).otherwise(mine["second"])
    out = rest.withColumn("size", F.col("size").cast("long")).join(per_size, "size", "left").select("group_id", "size", pick.alias("split"))
    kind = groups.schema["group_id"].dataType.simpleString()
    first = groups.sparkSession.createDataFrame([(r.group_id, r["size"], s) for r, s in taken], f"group_id {kind}, size long, split string")
    return first.unionByName(out)


def assign_balanced(groups: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(group_id, size, split): each group goes where the weighted misses of size, emotions, sources and modalities grow least.

    Val, test and train first take the group nearest to their target (ties: more sources, more emotions, id). The
    misses depend on what every group before brought, so one task folds over the summary of the groups: one short row per group.
    """
    ship(groups.sparkSession)
    kind = groups.schema["group_id"].dataType.simpleString()
    weights = BALANCE

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["size", "n_splits", "n_sources", "group_id"], ascending=[False, False, False, True], ignore_index=True)
        rows = [
            {"size": int(r.size_), "emotions": dict(r.emotions or {}), "sources": dict(r.sources or {}),
             "modes": {"image": r.n_image, "audio": r.n_audio, "text": r.n_text}, "key": (-r.n_sources, -r.n_emotions, r.group_id)}
            for r in f.rename(columns={"size": "size_"}).itertuples()]
        total = sum(r["size"] for r in rows)
        goal = targets(total, policy, False)
        share = {s: goal[s] / total if total else 0.0 for s in SPLITS}
        whole = {k: Counter() for k in weights}
        for r in rows:
            for k in weights:
                whole[k].update(r[k])
        have, size, out = {s: {k: Counter() for k in weights} for s in SPLITS}, dict.fromkeys(SPLITS, 0), [None] * len(rows)

        def put(i: int, s: str) -> None:
            out[i] = s
            size[s] += rows[i]["size"]
            for k in weights:
                have[s][k].update(rows[i][k])

        def cost(r: dict, s: str) -> float:
            c = SIZE_WEIGHT * abs(size[s] + r["size"] - goal[s]) / max(goal[s], 1.0)
            for k, w in weights.items():
                for x, n in r[k].items():
                    aim = whole[k][x] * share[s]
                    c += w * abs(have[s][k][x] + n - aim) / max(aim + 1.0, 1.0)
            if r["sources"] and not have[s]["sources"]:
                c -= NEW_SOURCE
            if r["emotions"] and len(have[s]["emotions"]) < 3:
                c -= FEW_EMOTIONS
            return c

        free = list(range(len(rows)))
        for s in ("val", "test", "train"):
            if free:
                best = min(free, key=lambda i: (abs(rows[i]["size"] - goal[s]) / max(goal[s], 1.0), *rows[i]["key"]))
                free.remove(best)
                put(best, s)
        for i in free:
            put(i, min(SPLITS, key=lambda s: (cost(rows[i], s), SPLITS.index(s))))
        return pd.DataFrame({"group_id": f["group_id"], "size": f["size"], "split": out})

    return groups.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(
        lambda f: run(f.drop(columns="_one")), f"group_id {kind}, size long, split string")


def assign_by_deficit(groups: DataFrame, policy: Policy = Policy(), key: str = "group_id") -> DataFrame:
    """(key, size, split): groups in order of the digest of their key go to the split that lacks most (ties: train, val, test)."""
    ship(groups.sparkSession)
    kind = groups.schema[key].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["d", "k"], ignore_index=True)
        goal, have, out = targets(int(f["size"].sum()), policy, False), dict.fromkeys(SPLITS, 0), []
        for n in f["size"]:
            s = max(SPLITS, key=lambda x: (goal[x] - have[x], -SPLITS.index(x)))
            have[s] += n
            out.append(s)
        return pd.DataFrame({"k": f["k"], "size": f["size"], "split": out})

    return groups.select(F.col(key).alias("k"), "size", F.sha2(F.col(key).cast("string"), 256).alias("d"), F.lit(1).alias("_one")).groupBy("_one").applyInPandas(
        lambda f: run(f.drop(columns="_one")), f"k {kind}, size long, split string").withColumnRenamed("k", key)


def disjoint_splits(samples: DataFrame, policy: Policy = Policy(), id_col: str = "record_id") -> DataFrame:
    """(id, split): identity-disjoint splits by the digest of the identity, or of the row's own id where it has none. No order, no shuffle."""
    owner = F.coalesce("identity_id", F.col(id_col).cast("string"))
    v = digest_mod(owner, 10_000) / F.lit(10_000.0)
    return samples.select(id_col, F.when(v < policy.train, "train").when(v < policy.train + policy.val, "val").otherwise("test").alias("split"))


# --- soft conflicts ------------------------------------------------------------------------------------------------

def directional_conflicts(members: DataFrame, bucket: str, kind: str) -> DataFrame:
    """(kind, group_id, split, other_split, n): one warning per bucket for every group in a split and every other split the bucket stands in."""
    have = members.where(F.col(bucket).isNotNull() & F.col("split").isNotNull())
    mine = have.select(bucket, "group_id", "split").distinct()
    theirs = have.select(bucket, F.col("split").alias("other_split")).distinct()
    return mine.join(theirs, bucket).where("split <> other_split").groupBy("group_id", "split", "other_split").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))


def _across(rows: DataFrame, block: Column, id_col: str, score, least: float, other_source: bool) -> DataFrame:
    """Pairs of one block in two splits (and in two sources) whose score of their ``_value`` is at least ``least``."""
    carry = [c for c in ("group_id", "dataset_source") if c in rows.columns]
    apart = lambda a, b: ~a("dataset_source").eqNullSafe(b("dataset_source")) if other_source else F.lit(True)
    pairs = blocked_pairs(rows.withColumn("_block", block), ["_block"], id_col, ["_value", *carry], lambda a, b: apart(a, b) & (score(a("_value"), b("_value")) >= least), different=["split"])
    return pairs.withColumn("score", score(F.col("left__value"), F.col("right__value"))).drop("_block", "left__value", "right__value")


def hash_pairs(rows: DataFrame, column: str, bits: int, other_source: bool = False, id_col: str = "record_id") -> DataFrame:
    """(left_id, right_id, left_split, right_split, ..., score) of rows in two splits whose hashes begin with the same six digits and differ in at most ``bits`` bits."""
    have = rows.where(F.col(column).isNotNull()).withColumn("_value", F.col(column))
    return _across(have, F.substring("_value", 1, 6), id_col, lambda a, b: 1 - V.hamming(a, b) / F.lit(64.0), 1 - bits / 64, other_source)


def vector_pairs(rows: DataFrame, column: str, least: float, other_source: bool = False, id_col: str = "record_id") -> DataFrame:
    """As ``hash_pairs`` for vectors of one sign signature whose unit cosine is at least ``least``."""
    have = rows.where(F.col(column).isNotNull()).withColumn("_value", F.col(column))
    return _across(have, V.sign_code("_value"), id_col, V.cosine_unit, least, other_source)


def near_pairs(members: DataFrame, policy: Policy = Policy(), id_col: str = "record_id") -> DataFrame | None:
    """(kind, left_group_id, right_group_id, left_split, right_split): similar faces, audio and images across splits, and images also across sources.

    Reads those of the columns face_hash, image_hash, face_vector, audio_vector and image_vector that the members have; None
    if they have none. A hash stands in for a row without the vector; image_hash stands in for face_hash.
    """
    have, out = set(members.columns), []

    def add(pairs: DataFrame, kind: str, extra: str | None = None, from_score: float = 1.0) -> None:
        cols = [F.col(c) for c in ("left_group_id", "right_group_id", "left_split", "right_split")]
        out.append(pairs.select(F.lit(kind).alias("kind"), *cols))
        if extra:
            out.append(pairs.where(F.col("score") >= from_score).select(F.lit(extra).alias("kind"), *cols))

    without = lambda c: members.where(F.col(c).isNull()) if c in have else members
    face = next((c for c in ("face_hash", "image_hash") if c in have), None)
    if face:
        rows = without("face_vector")
        if face == "face_hash" and "image_hash" in have:
            rows = rows.withColumn("face_hash", F.coalesce("face_hash", "image_hash"))
        add(hash_pairs(rows, face, policy.hash_bits, id_col=id_col), "face_similarity", "proxy_identity_cluster")
    if "face_vector" in have:
        add(vector_pairs(members, "face_vector", policy.face_similarity, id_col=id_col), "face_similarity", "proxy_identity_cluster", policy.proxy_similarity)
    if "audio_vector" in have:
        add(vector_pairs(members, "audio_vector", policy.audio_similarity, id_col=id_col), "audio_similarity", "proxy_speaker_cluster", policy.proxy_similarity)
    for kind, other in (("image_similarity", False), ("cross_dataset_similarity", True)):
        if "image_hash" in have:
            add(hash_pairs(without("image_vector"), "image_hash", policy.hash_bits, other, id_col), kind)
        if "image_vector" in have:
            add(vector_pairs(members, "image_vector", policy.image_similarity, other, id_col), kind)
    found = out[0] if out else None
    for p in out[1:]:
        found = found.unionByName(p)
    return found


def pairwise_conflicts(pairs: DataFrame) -> DataFrame:
    """(kind, group_id, split, other_split, n): each pair warns both of its groups."""
    side = lambda a, b: F.struct(F.col(f"{a}_group_id").alias("group_id"), F.col(f"{a}_split").alias("split"), F.col(f"{b}_split").alias("other_split"))
    both = pairs.select("kind", F.explode(F.array(side("left", "right"), side("right", "left"))).alias("x")).select("kind", "x.*")
    return both.groupBy("group_id", "split", "other_split", "kind").agg(F.count(F.lit(1)).alias("n"))


def repair_components(members: DataFrame, policy: Policy = Policy(), pairs: DataFrame | None = None) -> DataFrame:
    """(group_id, kind, component): groups of two splits or more that one linkable audio file, or a chain of similar images, holds together."""
    ok = audio_buckets(members, policy).where("refusal IS NULL").select("audio_path")
    have = members.where(F.col("split").isNotNull()).join(ok, "audio_path").select("audio_path", "group_id", "split").distinct()
    wide = have.groupBy("audio_path").agg(F.countDistinct("split").alias("n")).where("n > 1").select("audio_path")
    out = have.join(wide, "audio_path").select("group_id", F.lit("exact_audio_duplicate").alias("kind"), F.col("audio_path").alias("component")).distinct()
    for kind in COMPONENT_KINDS[1:] if pairs is not None else ():
        edges = pairs.where(F.col("kind") == kind).select(F.col("left_group_id").alias("left"), F.col("right_group_id").alias("right"))
        found = connected_components(edges.where("left <> right").distinct())
        out = out.unionByName(found.select(F.col("member").alias("group_id"), F.lit(kind).alias("kind"), F.col("component").cast("string").alias("component")))
    return out


def soft_conflicts(members: DataFrame, policy: Policy = Policy(), pairs: DataFrame | None = None) -> DataFrame:
    """Warnings of exact text, exact audio (buckets that may be linked) and ambiguous audio (those that may not), of members(group_id, split, text_key, audio_path, ...), and of their ``near_pairs`` (looked for if they are not given)."""
    pairs = near_pairs(members, policy) if pairs is None else pairs
    ok = Workspace(members.sparkSession, "audio").write(audio_buckets(members, policy).select("audio_path", F.col("refusal").isNull().alias("_ok")), "ok")
    tagged = members.join(ok, "audio_path", "left")
    exact = tagged.withColumn("_a", F.when(F.col("_ok"), F.col("audio_path")))
    loose = tagged.withColumn("_a", F.when(~F.col("_ok"), F.col("audio_path")))
    out = directional_conflicts(members, "text_key", "text_duplicate").unionByName(
        directional_conflicts(exact, "_a", "exact_audio_duplicate")).unionByName(directional_conflicts(loose, "_a", "ambiguous_audio_reuse"))
    return out if pairs is None else out.unionByName(pairwise_conflicts(pairs))


def size_penalty(n: Mapping[str, float], goal: Mapping[str, float]) -> float:
    """The sum over splits of the miss in the measure of the target."""
    return sum(abs(n[s] - goal[s]) / max(goal[s], 1.0) for s in SPLITS)


RISKY = ("exact_audio_duplicate", "ambiguous_audio_reuse", "image_similarity", "face_similarity", "cross_dataset_similarity")
#: Kinds whose components are repaired as a whole, in this order.
COMPONENT_KINDS = ("exact_audio_duplicate", "cross_dataset_similarity", "image_similarity")


def repair_plan(groups: DataFrame, conflicts: DataFrame, policy: Policy = Policy(), components: DataFrame | None = None) -> DataFrame:
    """(group_id, from_split, action, to_split): what is done with groups that soft conflicts touch; groups that stay are not listed.

    Groups(group_id, size, split). A small group with ambiguous audio of enough warnings is moved to train (if preferred) or
    dropped. Then the components(group_id, kind, component) that still span two splits, largest first within a kind, are cut back
    to the split that costs the fewest rows. Else a small group goes to the split that most of its warnings name, if that clearly wins and the sizes stay
    within the allowed deviation, and nothing was moved the other way in this round; one with many warnings of a risky kind is dropped. Folds over the groups with warnings, most
    warnings first, in one task; a group comes with a handful of numbers.
    """
    ship(groups.sparkSession)
    kind = groups.schema["group_id"].dataType.simpleString()
    per = conflicts.groupBy("group_id").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("kind") == "ambiguous_audio_reuse", F.col("n")).otherwise(0)).alias("ambiguous"),
        F.countDistinct(F.when(F.col("kind").isin(*RISKY), F.col("kind"))).alias("risky"),
        *[F.sum(F.when(F.col("other_split") == s, F.col("n")).otherwise(0)).alias(f"to_{s}") for s in SPLITS])
    counts = {r.split: r.n for r in groups.groupBy("split").agg(F.sum("size").alias("n")).collect()}  # a row per split
    start = {s: counts.get(s, 0) for s in SPLITS}
    goal = targets(sum(start.values()), policy, False)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        n, out, went, done = dict(start), [], set(), set()
        rows = {r.group_id: r for r in f.rename(columns={"size": "size_"}).itertuples()}
        for r in sorted(rows.values(), key=lambda r: (-r.n, r.size_, r.group_id)):
            if r.ambiguous >= policy.ambiguous_from and r.size_ <= policy.drop_up_to:
                there = {x: n[x] - (r.size_ if x == r.split else 0) + (r.size_ if x == "train" else 0) for x in SPLITS}
                to = "train" if policy.prefer_train and r.split != "train" and size_penalty(there, goal) <= size_penalty(n, goal) + policy.deviation else None
                n[r.split] -= r.size_
                if to:
                    n[to] += r.size_
                went.add((r.split, to))
                done.add(r.group_id)
                out.append((r.group_id, r.split, "reassign" if to else "drop", to))
        held: dict[tuple[str, str], list] = {}
        for r in rows.values():
            for c in r.components if r.components is not None else ():
                held.setdefault((c["kind"], c["component"]), []).append(r)
        free = lambda of: [r for r in of if r.group_id not in done]
        for kind in COMPONENT_KINDS:
            own = [sorted(of, key=lambda r: r.group_id) for (k, _), of in held.items() if k == kind]
            for of in sorted(own, key=lambda of: (-sum(r.size_ for r in free(of)), -len(of), [r.group_id for r in of])):
                best = None
                for target in sorted({r.split for r in free(of)}):
                    lost = [r for r in free(of) if r.split != target]
                    after = {x: n[x] - sum(r.size_ for r in lost if r.split == x) for x in SPLITS}
                    if lost and all(r.size_ <= policy.drop_up_to for r in lost) and size_penalty(after, goal) <= size_penalty(n, goal) + policy.deviation:
                        rank = (SPLITS if policy.prefer_train else ("test", "train", "val")).index(target)
                        plan = ((sum(r.size_ for r in lost), size_penalty(after, goal), len(lost), rank), lost, after)
                        best = plan if best is None or plan[0] < best[0] else best
                if best:
                    n.update(best[2])
                    done.update(r.group_id for r in best[1])
                    out += [(r.group_id, r.split, "drop", None) for r in best[1]]
        for r in f[~f["group_id"].isin(done)].sort_values(["n", "size", "group_id"], ascending=[False, True, True]).rename(columns={"size": "size_"}).itertuples():
            moved = lambda s: {x: n[x] - (r.size_ if x == r.split else 0) + (r.size_ if x == s else 0) for x in SPLITS}  # noqa: B023, E731
            fits = lambda s: size_penalty(moved(s), goal) <= size_penalty(n, goal) + policy.deviation  # noqa: B023, E731
            action, to = None, None
            votes = sorted(((getattr(r, f"to_{s}"), -SPLITS.index(s), s) for s in SPLITS), reverse=True)
            if (r.size_ <= policy.reassign_up_to and votes[0][2] != r.split and (votes[0][2], r.split) not in went
                  and votes[0][0] > (1 + policy.winner_ratio) * votes[1][0] and fits(votes[0][2])):
                action, to = "reassign", votes[0][2]
            elif r.n >= policy.drop_from_warnings and r.risky >= policy.drop_from_kinds and r.size_ <= policy.drop_up_to and fits(None):
                action = "drop"
            if action:
                n.update(moved(to))
                went.add((r.split, to))
                out.append((r.group_id, r.split, action, to))
        return pd.DataFrame(out, columns=["group_id", "from_split", "action", "to_split"])

    if components is None:
        one = groups.join(per, "group_id").withColumn("components", F.expr("CAST(NULL AS array<struct<kind: string, component: string>>)"))
    else:
        held = components.groupBy("group_id").agg(F.collect_set(F.struct("kind", "component")).alias("components"))
        one = groups.join(per, "group_id").join(held, "group_id", "left")
    one = one.withColumn("_one", F.lit(1))
    return one.groupBy("_one").applyInPandas(lambda f: run(f.drop(columns="_one")), f"group_id {kind}, from_split string, action string, to_split string")


def repair(members: DataFrame, policy: Policy = Policy(), ws=None) -> DataFrame:
    """Members after up to ``rounds`` rounds of conflicts and repair; dropped groups are gone."""
    ws = ws or Workspace(members.sparkSession, "repair")
    for _ in range(policy.rounds):
        groups = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.first("split").alias("split"))
        pairs = near_pairs(members, policy)
        pairs = pairs if pairs is None else ws.write(pairs, "pairs")
        plan = ws.write(repair_plan(groups, soft_conflicts(members, policy, pairs), policy, repair_components(members, policy, pairs)), "plan")
        if not plan.head(1):
            break
        step = members.join(plan.select("group_id", "action", "to_split"), "group_id", "left").where("action IS NULL OR action <> 'drop'")
        members = ws.write(step.withColumn("split", F.coalesce("to_split", "split")).drop("action", "to_split"), "members")
    return members


def validation(samples: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(check, n, status): what still stands across splits, and whether all three splits are there.

    Samples with image_hash or image_vector also get the numbers of near-same images and of those from two sources.
    """
    from tesserae.operators.leakage import leaking_keys

    keyed = samples.where(F.col("split").isNotNull())
    ok = audio_buckets(keyed, policy).select("audio_path", "refusal")
    audio = leaking_keys(keyed, "audio_path").join(ok, "audio_path")
    parts = [
        leaking_keys(keyed, "identity_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("identity_overlap").alias("check"), "n"),
        leaking_keys(keyed, "speaker_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("speaker_overlap").alias("check"), "n"),
        leaking_keys(keyed, "image_path").agg(F.count(F.lit(1)).alias("n")).select(F.lit("exact_image_overlap").alias("check"), "n"),
        audio.agg(F.count(F.lit(1)).alias("n")).select(F.lit("audio_overlap_raw").alias("check"), "n"),
        audio.agg(F.count_if(F.col("refusal").isNull()).alias("n")).select(F.lit("audio_overlap_actionable").alias("check"), "n"),
        audio.agg(F.count_if(F.col("refusal").isNotNull()).alias("n")).select(F.lit("audio_overlap_ambiguous").alias("check"), "n"),
        keyed.agg((F.lit(3) - F.countDistinct("split")).alias("n")).select(F.lit("missing_splits").alias("check"), "n"),
    ]
    if "image_hash" in keyed.columns:
        parts.append(hash_pairs(keyed, "image_hash", policy.hash_bits).agg(F.count(F.lit(1)).alias("n")).select(F.lit("near_duplicate_overlap").alias("check"), "n"))
    cross = []
    if "image_hash" in keyed.columns:
        cross.append(hash_pairs(keyed.where(F.col("image_vector").isNull()) if "image_vector" in keyed.columns else keyed, "image_hash", policy.hash_bits, True))
    if "image_vector" in keyed.columns:
        cross.append(vector_pairs(keyed, "image_vector", policy.image_similarity, True))
    if cross:
        cross = [c.select("left_id", "right_id") for c in cross]
        parts.append((cross[0].unionByName(cross[1]) if cross[1:] else cross[0]).agg(F.count(F.lit(1)).alias("n")).select(F.lit("cross_dataset_overlap").alias("check"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("n") > 0, "WARNING").otherwise("PASS"))
