"""Analysis of experiment results.

The report has one row per experiment (model x strategy x dataset), so it
is small by construction; every query here is an ordinary aggregate over
it and stays valid when results of many grids are read together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import model_parameters, model_strategy_key, parameter_bin, parameter_bin_order

KEYS = ["model", "strategy", "dataset"]
REPORT_METRICS = ["accuracy", "precision", "recall", "f1_score", "avg_inference_time", "vram_usage_gb",
                  "invalid_rate"]
QUALITY = ["accuracy", "precision", "recall", "f1_score"]


def report_rows(results: DataFrame) -> DataFrame:
    """Result documents -> flat report rows.  Failed experiments keep their
    keys and error with NULL metrics; optional metrics absent -> NULL; NaN
    is stored as NULL so that ordering and means skip it."""
    def m(name):
        c = F.col(f"metrics.{name}") if name in _metric_fields(results) else F.lit(None).cast("double")
        c = c.cast("double")
        return F.when(F.col("error").isNull(), F.nanvl(c, F.lit(None).cast("double"))).alias(name)
    return results.select(*KEYS, *[m(c) for c in REPORT_METRICS], "error")


def _metric_fields(results: DataFrame) -> set:
    if "metrics" not in results.columns:
        return set()
    return {f.name for f in results.schema["metrics"].dataType.fields}


def flat_report(flat: DataFrame) -> DataFrame:
    """Flat grid metrics (``run_grid`` output) -> report rows."""
    cols = []
    for c in REPORT_METRICS:
        cols.append((F.col(c) if c in flat.columns else F.lit(None)).cast("double").alias(c))
    return flat.select(*KEYS, *cols, "error")


def successful(report: DataFrame) -> DataFrame:
    return report.where(F.col("error").isNull())


def sorted_report(report: DataFrame) -> DataFrame:
    """Report by F1 descending, NULLs last, keys as tie break."""
    return report.orderBy(F.desc_nulls_last("f1_score"), *KEYS)


def means_by(report: DataFrame, key: str, metrics: list[str] | None = None, order: str = "f1_score",
             ascending: bool = False) -> DataFrame:
    metrics = metrics or QUALITY
    out = report.groupBy(key).agg(*[F.avg(c).alias(c) for c in metrics])
    o = F.asc_nulls_last(order) if ascending else F.desc_nulls_last(order)
    return out.orderBy(o, key)


def grouped_means(report: DataFrame) -> DataFrame:
    """Mean F1, accuracy and time per model, per strategy and per dataset in
    one pass (three grouping sets); ``dimension`` names the set."""
    dims = ["model", "strategy", "dataset"]
    agg = report.groupingSets([[d] for d in dims], *dims).agg(
        F.avg("f1_score").alias("f1_score"), F.avg("accuracy").alias("accuracy"),
        F.avg("avg_inference_time").alias("avg_inference_time"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    name = None
    for d in dims:
        cond = F.col(f"_g_{d}") == 0
        name = F.when(cond, F.lit(d)) if name is None else name.when(cond, F.lit(d))
    value = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d)) for d in dims])
    return agg.select(name.alias("dimension"), value.alias("value"), "f1_score", "accuracy", "avg_inference_time")


def best_per_group(report: DataFrame, key: str, counterpart: str, metric: str = "f1_score") -> DataFrame:
    """Mean metric per group and the counterpart of its best row (first
    maximum, NULLs skipped; ties broken by the other keys).  A group whose
    metric is all NULL gets a NULL best."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(metric), *[k for k in KEYS if k != key])
    ranked = report.withColumn("_rn", F.row_number().over(w))
    best = ranked.where((F.col("_rn") == 1) & F.col(metric).isNotNull()).select(
        key, F.col(counterpart).alias(f"best_{counterpart}"))
    means = report.groupBy(key).agg(F.avg(metric).alias(f"mean_{metric}"))
    return means.join(best, key, "left")


def best_overall(report: DataFrame, metric: str = "f1_score") -> DataFrame:
    """The single best row; empty when every metric value is NULL."""
    return report.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), *KEYS).limit(1)


def compare_models(report: DataFrame, strategies: list[str], datasets: list[str],
                   metric: str = "f1_score") -> DataFrame:
    """Model x (strategy, dataset) pivot of the mean metric over successful
    results; column names ``<strategy>|<dataset>``.  Pivot values are the
    given lists, so the column set is fixed and bounded."""
    rep = successful(report).withColumn("_col", F.concat_ws("|", "strategy", "dataset"))
    values = [f"{s}|{d}" for s in strategies for d in datasets]
    return rep.groupBy("model").pivot("_col", values).agg(F.avg(metric))


def heatmap(report: DataFrame, column: str, values: list[str], metric: str = "f1_score") -> DataFrame:
    """Model x ``column`` mean metric (one of the heat-map tables)."""
    return report.groupBy("model").pivot(column, values).agg(F.avg(metric))


def statistical_analysis(report: DataFrame, metric: str = "f1_score") -> DataFrame:
    """Per model_strategy over datasets: mean, population std, min, max, n."""
    rep = successful(report).withColumn("model_strategy", model_strategy_key("model", "strategy"))
    v = F.col(metric)
    return rep.groupBy("model_strategy").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count(v).alias("n"))


def with_parameters(report: DataFrame) -> DataFrame:
    return report.withColumn("num_parameters", model_parameters("model"))


def parameter_trend(report: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Least-squares line of each metric against the parameter count (rows
    with a known count): one row per metric with slope and intercept."""
    metrics = metrics or ["f1_score", "accuracy", "avg_inference_time"]
    rep = with_parameters(report).where(F.col("num_parameters").isNotNull())
    aggs = []
    for m in metrics:
        aggs += [F.regr_slope(m, "num_parameters").alias(f"{m}__slope"),
                 F.regr_intercept(m, "num_parameters").alias(f"{m}__intercept"),
                 F.regr_count(m, "num_parameters").alias(f"{m}__n")]
    wide = rep.agg(*aggs)
    stacks = ", ".join(f"'{m}', `{m}__slope`, `{m}__intercept`, `{m}__n`" for m in metrics)
    return wide.selectExpr(f"stack({len(metrics)}, {stacks}) as (metric, slope, intercept, n)")


def fitted_values(report: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """The trend line at each experiment (rows with a known parameter count):
    ``metric``, ``num_parameters``, ``value`` and ``fitted`` = slope x parameters +
    intercept.  The trend, a row for each metric, is broadcast."""
    metrics = metrics or ["f1_score", "accuracy", "avg_inference_time"]
    rep = with_parameters(report).where(F.col("num_parameters").isNotNull())
    long = rep.select(*KEYS, "num_parameters", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m"))
    return (long.select(*KEYS, "num_parameters", "_m.metric", "_m.value")
            .join(F.broadcast(parameter_trend(report, metrics)), "metric")
            .select(*KEYS, "metric", "num_parameters", "value",
                    (F.col("slope") * F.col("num_parameters") + F.col("intercept")).alias("fitted")))


def split_sizes(assignment: DataFrame) -> DataFrame:
    """Rows, and rows of each class, in each part of a split (``dataset, split, label``)."""
    return assignment.groupBy("dataset", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("negatives"),
        F.count_if(F.col("label") == 1).alias("positives"))


def parameter_bins(report: DataFrame, metric: str = "f1_score") -> DataFrame:
    """Mean metric per parameter-size bin (right-closed), ascending."""
    rep = with_parameters(report).where(F.col("num_parameters").isNotNull())
    rep = rep.withColumn("param_range", parameter_bin("num_parameters")) \
        .withColumn("bin_order", parameter_bin_order("num_parameters")).where(F.col("param_range").isNotNull())
    return rep.groupBy("param_range", "bin_order").agg(F.avg(metric).alias(metric), F.count("*").alias("n")) \
        .orderBy(F.asc_nulls_last(metric), "bin_order")


def distinct_values(report: DataFrame) -> DataFrame:
    """Sorted distinct models, strategies and datasets, each as a list."""
    return report.agg(*[F.array_join(F.array_sort(F.collect_set(c)), ", ").alias(f"{c}s") for c in KEYS])


def counts(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("experiments"),
                      F.count_if(F.col("error").isNull()).alias("successful"),
                      F.count_if(F.col("error").isNotNull()).alias("failed"))
