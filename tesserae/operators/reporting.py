"""Report tables from metric rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that identify a metric row, as far as a table has them.
ID_COLUMNS = ("section", "table", "method", "variant", "baseline", "dataset", "split", "topology", "perturbation", "regularization")


def numeric(c: str) -> Column:
    """A number, or null for text that is none, NaN and infinities."""
    v = F.col(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def seed_aggregate(rows: DataFrame, metrics: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """(by..., <metric>_mean, <metric>_std, <metric>_n...): mean and population deviation over the seeds; null keys are groups of their own."""
    by = list(by) if by is not None else [c for c in ID_COLUMNS if c in rows.columns]
    aggs = []
    for m in metrics:
        v = numeric(m)
        aggs += [F.avg(v).alias(f"{m}_mean"), F.stddev_pop(v).alias(f"{m}_std"), F.count(v).alias(f"{m}_n")]
    return rows.groupBy(*by).agg(*aggs)


# The names a section of rows may have.
SECTIONS = {
    "main_results": ("main_results", "main", "main_table"),
    "cross_dataset": ("cross_dataset", "cross_dataset_generalization"),
    "architecture": ("architecture", "architecture_comparison"),
    "geometry": ("geometry", "geometry_evaluation"),
    "retrieval": ("retrieval", "retrieval_evaluation"),
    "ablations": ("ablation", "ablations", "component_ablations", "modality_ablations"),
    "sensitivity": ("sensitivity", "graph_sensitivity"),
}
# The columns that may carry the x axis and the group of a sensitivity curve, in order of preference.
CURVE_X = ("ot_regularization", "regularization", "graph_perturbation", "k")
CURVE_GROUP = ("graph_topology", "topology", "variant", "method")


def section_rows(rows: DataFrame, table: str) -> DataFrame:
    """The rows of a table's section under any of its names, read without case; all rows where there is no such column."""
    return rows.where(F.lower("section").isin(*SECTIONS.get(table, (table,)))) if "section" in rows.columns else rows


def seed_rows(rows: DataFrame, by: Sequence[str], metrics: Sequence[str], order: str | None = None, digits: int = 3) -> DataFrame:
    """(by..., status, num_samples, <metric>...): the seeds of a row in one, metrics as mean ± deviation.

    status lists the distinct ones in order, joined by commas; num_samples is the largest, 0 if there is none. With
    ``order`` the rows come in the order in which their keys first appear.
    """
    aggs = [F.array_join(F.array_sort(F.collect_set("status")), ",").alias("status") if "status" in rows.columns else F.lit("").alias("status"),
            F.coalesce(F.max("num_samples"), F.lit(0)).alias("num_samples") if "num_samples" in rows.columns else F.lit(0).alias("num_samples")]
    for m in metrics:
        aggs += [F.avg(numeric(m)).alias(f"_m_{m}"), F.stddev_pop(numeric(m)).alias(f"_s_{m}")]
    if order:
        aggs.append(F.min(order).alias("_first"))
    out = rows.groupBy(*by).agg(*aggs)
    out = out.orderBy("_first") if order else out
    return out.select(*by, "status", "num_samples", *[mean_std(f"_m_{m}", f"_s_{m}", digits).alias(m) for m in metrics])


def cross_dataset_table(rows: DataFrame, metric_of: dict[str, str], default: str, by: Sequence[str] = ("name",)) -> DataFrame:
    """One row per ``by`` with a column per data set: the mean of the metric that ``metric_of`` names for it (else ``default``)."""
    names = sorted(r.dataset for r in rows.select("dataset").where("dataset IS NOT NULL").distinct().collect())  # the data sets of a report
    return rows.groupBy(*by).agg(*[F.avg(F.when(F.col("dataset") == d, numeric(metric_of.get(d, default)))).alias(d) for d in names])


def sensitivity_curve(rows: DataFrame, metric: str) -> DataFrame:
    """(curve, x, y) in order: x and curve are the first columns of CURVE_X and CURVE_GROUP that the table has (curve null if none).

    The metric may also stand under <metric>_mean, or in lower case.
    """
    x = next((c for c in CURVE_X if c in rows.columns), None)
    y = next((c for c in (metric, f"{metric}_mean", metric.lower(), f"{metric.lower()}_mean") if c in rows.columns), None)
    if x is None or y is None:
        raise KeyError(f"no column for {'x' if x is None else metric} among {rows.columns}")
    group = next((F.col(c) for c in CURVE_GROUP if c in rows.columns), F.lit(None).cast("string"))
    return rows.select(group.alias("curve"), F.col(x).alias("x"), F.col(y).alias("y")).orderBy("curve", "x")


def top_counts(rows: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """(key, n) of the most frequent keys; ties by key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(limit)


def wide(rows: DataFrame, by: str, split: str, metrics: Sequence[str], splits: Sequence[str] = ("val", "test")) -> DataFrame:
    """One row per ``by`` with <split>_<metric> columns."""
    p = rows.groupBy(by).pivot(split, list(splits))
    if len(metrics) == 1:
        out = p.agg(F.avg(metrics[0]))
        return out.select(by, *[F.col(s).alias(f"{s}_{metrics[0]}") for s in splits])
    return p.agg(*[F.avg(m).alias(m) for m in metrics])


def plan_grid(**levels: Sequence) -> list[tuple]:
    """All combinations of a few named levels, in order."""
    import itertools

    return list(itertools.product(*levels.values()))


def missing(plan: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The planned cells without a result, each once."""
    return plan.select(*keys).distinct().join(have.select(*keys).distinct(), list(keys), "left_anti")


def mean_std(mean: str, std: str, digits: int = 3) -> Column:
    """``mean ± std`` with a fixed number of decimals; two hyphens where there is no mean."""
    f = f"%.{digits}f"
    both = F.format_string(f"{f} ± {f}", F.col(mean), F.coalesce(F.col(std), F.lit(0.0)))
    return F.when(F.col(mean).isNull(), F.lit("--")).otherwise(both)


def display_name(c: str, names: dict[str, str]) -> Column:
    """A name from the table of names, else the words of the key with capitals."""
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]) if names else None
    fallback = F.initcap(F.replace(F.col(c), F.lit("_"), F.lit(" ")))
    return F.coalesce(F.try_element_at(table, F.col(c)), fallback) if names else fallback


def latex(df: DataFrame, limit: int = 10_000) -> str:
    """A small table as LaTeX; tables of more rows are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("the table is too long to print")
    head = " & ".join(df.columns) + r" \\"
    body = [" & ".join("--" if v is None else str(v) for v in r) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}"])
