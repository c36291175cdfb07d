"""Sources mixed to target shares of the tokens.

Targets hang as leaves on a tree domain - language - source. Budgets go down the tree: a node's budget is shared among its
children by weight, as far as what stands below them can give; what a child cannot take goes to its siblings, and only what
no sibling can take has already gone to the ancestors' other branches. A leaf then takes whole seeded epochs of its
documents and a token prefix of the next one. The prefix comes from a two-level prefix sum, so no task holds a leaf; what a prefix
of whole documents misses of a leaf's budget is carried to the next leaf of the source.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import squeeze
from tesserae.llm.bpe import encode_column
from tesserae.operators.skew import prefix_sums, unit_hash
from tesserae.workspace import Workspace

Path = tuple[str, ...]
#: The domain of sources without one.
OTHER = "other"


def language_label(c="lang"):
    """The two-letter code of a label without case, padding and region; everything else is und."""
    t = F.regexp_extract(F.lower(squeeze(c)), r"^([a-z]{2})(?:[-_].*)?$", 1)
    return F.when(F.coalesce(t, F.lit("")).isin("", "xx"), F.lit("und")).otherwise(t)


def fill(budget: float, weights: Mapping, room: Mapping) -> dict:
    """``budget`` shared in proportion to ``weights``, nobody above its ``room``; what is cut off goes to the others."""
    out, open_ = {k: 0.0 for k in weights}, {k for k in weights if weights[k] > 0 and room[k] > 0}
    left = min(budget, sum(room[k] for k in open_))
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if out[k] + left * weights[k] / total >= room[k]}
        if not full:
            for k in open_:
                out[k] += left * weights[k] / total
            break
        for k in full:
            left -= room[k] - out[k]
            out[k] = room[k]
        open_ -= full
    return out


def budgets(total: float, weights: Mapping[Path, float], room: Mapping[Path, float]) -> dict[Path, float]:
    """The budget of every leaf of the tree whose leaves are the paths of ``weights``; ``room`` is what a leaf can give."""
    out: dict[Path, float] = {}

    def down(prefix: Path, budget: float) -> None:
        below = [p for p in weights if p[: len(prefix)] == prefix]
        if below == [prefix]:
            out[prefix] = budget
            return
        w, r = defaultdict(float), defaultdict(float)
        for p in below:
            w[p[: len(prefix) + 1]] += weights[p]
            r[p[: len(prefix) + 1]] += room[p]
        for child, b in fill(budget, w, r).items():
            down(child, b)

    if weights:
        down((), total)
    return out


def leaf_weights(targets: list[dict], leaves: Mapping[Path, int], domains: Mapping[str, str]) -> tuple[dict[Path, float], dict[Path, float]]:
    """(weight, capacity in tokens) of every leaf: a source's share falls on its languages in the measure of their tokens.

    A target source without tokens keeps one leaf of weight and no capacity. It hangs right below its domain, in a branch of its
    own, so that its share is handed to all languages of the domain alike.
    """
    weight, room = {}, {}
    for t in targets:
        mine = {p: n for p, n in leaves.items() if p[-1] == t["source"] and n > 0}
        whole = sum(mine.values())
        if not whole:
            p = (domains.get(t["source"], OTHER), f"={t['source']}", t["source"])
            weight[p], room[p] = t["target_share"], 0.0
        for p, n in mine.items():
            weight[p], room[p] = t["target_share"] * n / whole, float(n * t["max_repeats"])
    return weight, room


class Mixture:
    """A mixture of ``documents`` (doc_id, text, lang, source) by ``targets`` (source, target_share, max_repeats).

    ``domains``(source, domain) is the upper part of the tree, a row per source; sources it does not name (all, if it is left out)
    form one more domain. A source with several rows takes the least domain, null ones do not count.
    ``total_tokens`` is the size asked for; None takes the largest at which every source that has documents still reaches its
    share. Targets are a fixed table, one row per source: null or negative shares count 0, null or negative repeats count 0.
    Documents without a target, without source or without tokens are left out. A repeated doc_id counts as often as it stands.
    """

    def __init__(
        self, documents: DataFrame, targets: DataFrame, domains: DataFrame | None = None, total_tokens: int | None = None, seed: int = 5, tokenizer: str = ""
    ):
        spark, self.seed = documents.sparkSession, seed
        self.ws = Workspace(spark, "mixture")
        self.targets = [
            {"source": r.source, "target_share": max(0.0, r.target_share or 0.0), "max_repeats": max(0, r.max_repeats or 0)}
            for r in targets.select("source", "target_share", "max_repeats").collect() if r.source is not None
        ]
        self.domains = {} if domains is None else {
            r.source: r.domain for r in domains.where("source IS NOT NULL AND domain IS NOT NULL").groupBy("source").agg(F.min("domain").alias("domain")).collect()}
        self.repeats = {t["source"]: t["max_repeats"] for t in self.targets}
        wanted = F.broadcast(targets.select("source").where("source IS NOT NULL").distinct())
        slim = documents.join(wanted, "source", "left_semi").select("doc_id", "source", language_label().alias("lang"), "text")
        sized = encode_column(slim, path=tokenizer, count_only=True, keep=["doc_id", "source", "lang"]).where("n_tokens > 0")
        self.docs = self.ws.write(sized, "sized")
        # sources x languages, both bounded: at most targets x 677 rows
        found = self.docs.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n")).collect()
        self.leaves = {(self.domains.get(r.source, OTHER), r.lang, r.source): r.n for r in found}
        self.weight, self.room = leaf_weights(self.targets, self.leaves, self.domains)
        self.total = total_tokens if total_tokens is not None else self._largest()
        self.budget = budgets(self.total, self.weight, self.room)

    def _largest(self) -> int:
        free = {p: (1e18 if self.room[p] > 0 else 0.0) for p in self.weight}
        part = budgets(1.0, self.weight, free)
        per_source, room = defaultdict(float), defaultdict(float)
        for p, b in part.items():
            per_source[p[-1]] += b
            room[p[-1]] += self.room[p]
        return math.floor(min((room[s] / b for s, b in per_source.items() if b > 0), default=0))

    def rows(self) -> DataFrame:
        """(doc_id, source, lang, n_tokens, copies): the documents of the mixture and how often each is taken.

        Whole epochs take every document of a leaf; the last, partial one takes the prefix of a seeded order that comes
        nearest to what is left of the leaf's budget and of the source's leaves before it, largest first. So a source misses
        its budget by about half a document, however many leaves it has.
        """
        plan = {}
        for p, b in self.budget.items():
            n = self.leaves.get(p, 0)
            if n and b > 0:
                full = int((b + 1e-6) // n)
                plan[p[2], p[1]] = (full, b - full * n)
        spark = self.docs.sparkSession
        at = spark.createDataFrame([(*k, *v) for k, v in plan.items()], "source string, lang string, full long, rest double")
        order = unit_hash(F.col("doc_id"), F.lit(self.seed))
        placed = prefix_sums(self.docs.join(F.broadcast(at), ["source", "lang"]), ["source", "lang"], ["doc_id"], F.col("n_tokens"), order)
        placed = self.ws.write(placed.withColumn("upto", F.col("before") + F.col("n_tokens")), "placed")
        # the prefixes on both sides of what is left; a row per leaf
        sides = placed.groupBy("source", "lang").agg(
            F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("lo"), F.min(F.when(F.col("upto") > F.col("rest"), F.col("upto"))).alias("hi")).collect()
        cuts, carried = [], defaultdict(float)
        for r in sorted(sides, key=lambda r: (r.source, -plan[r.source, r.lang][1], r.lang)):
            full, rest = plan[r.source, r.lang]
            aim, lo = rest + carried[r.source], r.lo or 0
            # the largest leaf may be at its limit of repeats, where there is no further copy to take
            more = r.hi is not None and full < self.repeats[r.source]
            cut = r.hi if more and abs(r.hi - aim) < abs(lo - aim) else lo
            carried[r.source] = aim - cut
            cuts.append((r.source, r.lang, cut))
        cut = spark.createDataFrame(cuts, "source string, lang string, cut long")
        taken = placed.join(F.broadcast(cut), ["source", "lang"])
        copies = F.col("full") + F.when(F.col("upto") <= F.col("cut"), 1).otherwise(0)
        return taken.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "lang", "n_tokens", "copies")

    def report(self) -> DataFrame:
        """One row per target: its share, what there is, its budget, what was taken, and the share reached of the tokens taken.

        falls_short tells the sources whose own share of the asked size is more than they could give.
        """
        got = {r.source: r for r in self.rows().groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("docs")).collect()}
        whole, all_shares, out = sum(r.tokens for r in got.values()), sum(t["target_share"] for t in self.targets), []
        for t in self.targets:
            s, g = t["source"], got.get(t["source"])
            have = sum(n for p, n in self.leaves.items() if p[-1] == s)
            asked = sum(b for p, b in self.budget.items() if p[-1] == s)
            own = self.total * t["target_share"] / all_shares if all_shares else 0.0
            out.append((s, t["target_share"], t["max_repeats"], have, float(asked), g.tokens if g else 0, g.docs if g else 0, g.copies if g else 0,
                        g.tokens / whole if g and whole else 0.0, have * t["max_repeats"] < own - 1e-6))
        return self.docs.sparkSession.createDataFrame(
            out, "source string, target_share double, max_repeats long, available_tokens long, budget_tokens double, mixed_tokens long, "
            "n_docs long, n_copies long, share_reached double, falls_short boolean")


#: The tree of the queries: the domains of the sources of the test tables.
DOMAINS = {
    "annotator_notes": "description", "scene_captions": "description", "portrait_briefs": "description", "casting_briefs": "description",
    "dialog_transcripts": "speech", "listening_diaries": "speech", "studio_logs": "speech",
    "review_threads": "reference", "dataset_cards": "reference", "consent_summaries": "reference", "lab_protocols": "reference",
}


def _run(spark: SparkSession, sf_dir: str) -> Mixture:
    tree = spark.createDataFrame(list(DOMAINS.items()), "source string, domain string")
    return Mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet"), tree)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).rows()


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).report()
