"""Splits that keep related records together.

Identities and speakers are vertices, a record that has both is an edge. Borůvka-style rounds: every component takes the
least edge that leaves it (edges carry random-looking hashed weights, so trees stay shallow), components along the taken
edges merge, edges within a component and parallel edges drop out. The edges taken are written as a spanning forest, and
one written table per round maps components to their root. Roots are then stratified by size band and dealt to the splits.
Keys that now stand in several splits are looked for below the roots that do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.labels import SPLITS, split_of
from tesserae.functions.text import key_of
from tesserae.operators.skew import heavy_keys, lookup_join, prefix_sums, unit_hash
from tesserae.workspace import Workspace

MAX_ROUNDS = 60
ENTITIES = ("identity_id", "speaker_id")


def spanning_forest(edges: DataFrame, ws: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(forest, roots) of undirected ``edges``(u, v).

    forest(u, v, round) holds the edges taken: with n vertices in c components there are n - c. roots(vertex, root) has every
    vertex with an edge. Null ends and loops are no edges; repeated edges count once.
    """
    ws = ws or Workspace(edges.sparkSession, "forest")
    one = (
        edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct()
        .select(F.col("lo").alias("a"), F.col("hi").alias("b"), F.struct(F.xxhash64("lo", "hi").alias("w"), "lo", "hi").alias("e"))
    )
    graph, maps, taken = ws.write(one, "graph"), [], []
    while graph.head(1):
        if len(maps) >= MAX_ROUNDS:
            raise RuntimeError("the graph did not contract")
        ways = graph.select("a", "b", "e").union(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        best = ways.groupBy("a").agg(F.min(F.struct("e", "b")).alias("x")).select("a", "x.e", "x.b")
        # an edge taken from both sides makes its smaller end the root of the other; every tree has exactly one such edge
        pair = best.groupBy("e").agg(F.min(F.struct("a", "b")).alias("x"), F.max(F.struct("a", "b")).alias("y"), F.count(F.lit(1)).alias("n"))
        pair = ws.write(pair, "taken")
        up = pair.select(F.col("y.a").alias("c"), F.col("y.b").alias("p"))
        tops = pair.where("n = 2").select(F.col("x.a").alias("c"), F.col("x.a").alias("p"))
        point = ws.write(up.unionByName(tops), "point")
        while True:  # pointer doubling up the shallow trees
            far = point.select(F.col("c").alias("p"), F.col("p").alias("q"))
            step = point.join(far, "p").select("c", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved"))
            step = ws.write(step, "point")
            ws.drop(point)
            point = step.select("c", "p")
            point._workspace_path = step._workspace_path
            if not step.where("moved").head(1):
                break
        maps.append(point)
        taken.append(pair.select("e.lo", "e.hi", F.lit(len(maps)).alias("round")))
        to_a, to_b = point.select(F.col("c").alias("a"), F.col("p").alias("ra")), point.select(F.col("c").alias("b"), F.col("p").alias("rb"))
        rest = (
            graph.join(to_a, "a").join(to_b, "b").where("ra <> rb")
            .groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("e").alias("e"))
        )
        rest = ws.write(rest, "graph")
        ws.drop(graph)
        graph = rest
    if not maps:
        forest = one.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(0).alias("round")).limit(0)
        return forest, one.select(F.col("a").alias("vertex"), F.col("b").alias("root")).limit(0)
    roots = maps[-1].select(F.col("c").alias("vertex"), F.col("p").alias("root"))
    for earlier in reversed(maps[:-1]):
        later = roots.select(F.col("vertex").alias("p"), "root")
        roots = earlier.join(later, "p", "left").select(F.col("c").alias("vertex"), F.coalesce("root", "p").alias("root"))
    forest = taken[0]
    for t in taken[1:]:
        forest = forest.unionByName(t)
    return forest.select(F.col("lo").alias("u"), F.col("hi").alias("v"), "round"), ws.write(roots, "roots")


def _vertex(field: str, key) -> F.Column:
    return F.concat(F.lit(f"{field}="), key)


class GroupedSplit:
    """The run over one table of records; entities are the named key columns, joined left to right."""

    def __init__(self, records: DataFrame, id_col: str = "record_id", entities: tuple[str, str] = ENTITIES):
        self.spark, self.ws, self.entities = records.sparkSession, Workspace(records.sparkSession, "split"), entities
        first, second = entities
        rows = records.select(
            F.col(id_col).alias("id"), split_of("split").alias("now"),
            _vertex(first, key_of(first)).alias("a"), _vertex(second, key_of(second)).alias("b"),
        )
        self.rows = self.ws.write(rows.withColumn("vertex", F.coalesce("a", "b")), "rows")
        edges = self.rows.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").alias("u"), F.col("b").alias("v"))
        self.forest, self.roots = spanning_forest(edges, self.ws)
        self.roots.head(1)

    def entity_table(self) -> DataFrame:
        """(entity_field, entity_key, root, n_rows, n_train, n_val, n_test): every key with its root and its rows by present split."""
        side = lambda v: self.rows.where(F.col(v).isNotNull()).select(F.col(v).alias("vertex"), "now")
        seen = side("a").unionByName(side("b")).groupBy("vertex").agg(
            F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col("now") == s).alias(f"n_{s}") for s in SPLITS]
        )
        return seen.join(self.roots, "vertex", "left").select(
            F.substring_index("vertex", "=", 1).alias("entity_field"),
            F.expr("substring(vertex, instr(vertex, '=') + 1)").alias("entity_key"),
            F.coalesce("root", "vertex").alias("root"), "n_rows", *[f"n_{s}" for s in SPLITS],
        )

    def conflicts(self) -> DataFrame:
        """The keys that now occur in more than one split: first the roots of the forest whose rows do, then their keys.

        A key's rows all hang below its root, so a root in one split has no such key and is done with.
        """
        keys = self.ws.write(self.entity_table(), "entities")
        n = sum(F.when(F.col(f"n_{s}") > 0, 1).otherwise(0) for s in SPLITS)
        torn = keys.groupBy("root").agg(*[F.sum(f"n_{s}").alias(f"n_{s}") for s in SPLITS]).where(n > 1).select("root")
        return keys.join(self.ws.write(torn, "torn"), "root", "left_semi").where(n > 1)

    def root_splits(self, targets: DataFrame, seed: int = 11) -> DataFrame:
        """(root, size, split): every group of linked records with its rows and the split it is dealt.

        ``targets``(split, target_share): shares are scaled to 1; null or negative ones count 0. Roots are stratified by size
        band (powers of two) and dealt band after band, larger ones first. In a band roots stand in seeded order, and the
        splits get a stretch of its rows each, in the measure of what they lack after the bands before; a root goes where its
        middle stands. A split that lacks less than the least root of the band takes part only if all do. What a band has
        really dealt is summed before the next one, so no split misses its share by more than about one root's size. Rows
        without any entity are groups of one and have no root here; see ``assign``.
        """
        owner = self.rows.where("vertex IS NOT NULL").groupBy("vertex").agg(F.count(F.lit(1)).alias("n"))
        sizes = owner.join(self.roots, "vertex", "left").groupBy(F.coalesce("root", "vertex").alias("root")).agg(F.sum("n").alias("size"))
        sizes = sizes.withColumn("band", F.floor(F.log2("size")).cast("int"))
        goal = {r.split: max(0.0, r.target_share or 0.0) for r in targets.collect() if r.split}  # one row per split
        total, n_all = sum(goal.values()) or 1.0, self.rows.count()
        self.lack = {s: g / total * n_all for s, g in goal.items()}
        placed = self.ws.write(prefix_sums(sizes, ["band"], ["root"], F.col("size"), unit_hash(F.col("root"), F.lit(seed))), "placed")
        middle, cuts = F.col("before") + F.col("size") / 2, []
        for r in sorted(placed.groupBy("band").agg(F.sum("size").alias("rows")).collect(), key=lambda r: -r.band):  # at most 64 rows
            mine = self._cut(r.band, r.rows)
            cuts += mine
            for x in placed.where(F.col("band") == r.band).groupBy(self._pick(mine, middle).alias("split")).agg(F.sum("size").alias("n")).collect():
                if x.split is not None:
                    self.lack[x.split] -= x.n
        at = self.spark.createDataFrame(cuts, "band int, lo double, hi double, split string")
        dealt = placed.join(F.broadcast(at), (placed.band == at.band) & (middle >= F.col("lo")) & (middle < F.col("hi")))
        return dealt.select("root", "size", "split")

    def _cut(self, band: int, rows: int) -> list[tuple[int, float, float, str]]:
        """The band's rows cut into one stretch per split in the measure of what the splits lack, the largest first."""
        need = {s: x for s, x in self.lack.items() if x >= 2**band} or {s: max(0.0, x) for s, x in self.lack.items()}
        if not sum(need.values()):
            need = {s: 1.0 for s in self.lack}
        all_, at, out = sum(need.values()), 0.0, []
        for s in sorted(need, key=lambda s: (-need[s], s)):
            out.append((band, at, at + rows * need[s] / all_, s))
            at = out[-1][2]
        return [(b, lo, (hi if i < len(out) - 1 else float("inf")), s) for i, (b, lo, hi, s) in enumerate(out)]

    @staticmethod
    def _pick(cut: list[tuple[int, float, float, str]], at: Column) -> Column:
        """The split whose stretch ``at`` stands in."""
        pick = F.lit(cut[-1][3] if cut else None).cast("string")
        for _, _, hi, s in reversed(cut[:-1]):
            pick = F.when(at < hi, F.lit(s)).otherwise(pick)
        return pick

    def assign(self, targets: DataFrame, seed: int = 11) -> DataFrame:
        """(id, split): the new split of every record. Rows without an entity fill up what the splits lack, by seeded hash."""
        dealt = self.ws.write(self.root_splits(targets, seed), "dealt")
        of_vertex = self.rows.where("vertex IS NOT NULL").select("vertex").distinct().join(self.roots, "vertex", "left").select(
            "vertex", F.coalesce("root", "vertex").alias("root")).join(dealt.select("root", "split"), "root").select("vertex", "split")
        of_vertex = self.ws.write(of_vertex, "of_vertex")
        linked = self.rows.where("vertex IS NOT NULL").select("id", "vertex")
        heavy = self.ws.write(heavy_keys(linked, ["vertex"]), "heavy")
        out = lookup_join(linked, of_vertex, "vertex", heavy, heavy.count(), "inner").select("id", "split")
        free = self.rows.where("vertex IS NULL").select("id")
        pick = self._pick(self._cut(0, 1), unit_hash(F.col("id"), F.lit(seed)))
        return out.unionByName(free.select("id", pick.alias("split")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = GroupedSplit(spark.read.parquet(f"{sf_dir}/normalized_records.parquet"))
    return run.conflicts().select("entity_field", "entity_key")


def p2_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, split): the new split of every record."""
    run = GroupedSplit(spark.read.parquet(f"{sf_dir}/normalized_records.parquet"))
    return run.assign(spark.read.parquet(f"{sf_dir}/split_targets.parquet")).withColumnRenamed("id", "record_id")


def p2_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_field, n_keys, n_torn): how many keys there are, and of how many the new splits tear the rows apart."""
    run = GroupedSplit(spark.read.parquet(f"{sf_dir}/normalized_records.parquet"))
    new = run.ws.write(run.assign(spark.read.parquet(f"{sf_dir}/split_targets.parquet")), "new")
    long = run.rows.join(new, "id").select("split", F.explode(F.array("a", "b")).alias("vertex")).where("vertex IS NOT NULL")
    seen = long.groupBy("vertex").agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS])
    torn = sum(F.col(s) for s in SPLITS) > 1
    return seen.groupBy(F.substring_index("vertex", "=", 1).alias("entity_field")).agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(torn).alias("n_torn"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, n_rows, share_reached, target_share): the proportions the new splits reach."""
    targets = spark.read.parquet(f"{sf_dir}/split_targets.parquet")
    n = p2_assignment(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    n = targets.select("split", "target_share").join(n, "split", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    every = Window.partitionBy(F.lit(1))  # a row per split
    return n.select("split", "n_rows", (F.col("n_rows") / F.sum("n_rows").over(every)).alias("share_reached"), "target_share")
