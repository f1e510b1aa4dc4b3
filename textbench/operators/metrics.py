"""Classification metrics from five counters.

All metrics of a cell derive from ``tn, fp, fn, tp`` (after invalid answers
are scored as wrong) and ``invalid``; they are summed conditionally in one
``groupBy`` (partial aggregation before the shuffle, a handful of longs
per group after it), and the ratios are projections over the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import clean_prediction, is_valid_prediction

COUNTER_COLUMNS = ["n", "true_negatives", "false_positives", "false_negatives", "true_positives",
                   "invalid_predictions"]


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 when den is 0 (empty denominators count as zero)."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def counter_aggs(label: str = "label", prediction: str = "prediction") -> list[Column]:
    y = F.col(label)
    p = clean_prediction(prediction, label)
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 0) & (p == 0)).alias("true_negatives"),
        F.count_if((y == 0) & (p == 1)).alias("false_positives"),
        F.count_if((y == 1) & (p == 0)).alias("false_negatives"),
        F.count_if((y == 1) & (p == 1)).alias("true_positives"),
        F.count_if(~is_valid_prediction(prediction)).alias("invalid_predictions"),
    ]


def confusion_counts(df: DataFrame, by: list[str] | None = None, label: str = "label",
                     prediction: str = "prediction", extra: list[Column] | None = None) -> DataFrame:
    aggs = counter_aggs(label, prediction) + list(extra or [])
    return df.groupBy(*(by or [])).agg(*aggs)


def metric_columns() -> list[Column]:
    """Projections over the counter columns (see :data:`COUNTER_COLUMNS`)."""
    tn, fp, fn, tp = (F.col(c) for c in ("true_negatives", "false_positives", "false_negatives",
                                         "true_positives"))
    n, inv = F.col("n"), F.col("invalid_predictions")
    p1, r1, f1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fn + fp)
    # macro means run over the classes present in truth or prediction only
    has0 = (tn + fp + fn) > 0
    has1 = (tp + fp + fn) > 0
    n_cls = has0.cast("int") + has1.cast("int")

    def macro(v0, v1):
        s = F.when(has0, v0).otherwise(0.0) + F.when(has1, v1).otherwise(0.0)
        return F.when(n_cls > 0, s / n_cls).otherwise(F.lit(0.0))

    return [
        _ratio(tp + tn, n).alias("accuracy"),
        p1.alias("precision"),
        r1.alias("recall"),
        f1.alias("f1_score"),
        macro(p0, p1).alias("precision_macro"),
        macro(r0, r1).alias("recall_macro"),
        macro(f0, f1).alias("f1_macro"),
        inv.alias("invalid_predictions"),
        _ratio(inv, n).alias("invalid_rate"),
        F.array(F.array(tn, fp), F.array(fn, tp)).alias("confusion_matrix"),
        tn.alias("true_negatives"),
        fp.alias("false_positives"),
        fn.alias("false_negatives"),
        tp.alias("true_positives"),
    ]


METRIC_NAMES = ["accuracy", "precision", "recall", "f1_score", "precision_macro", "recall_macro", "f1_macro",
                "invalid_predictions", "invalid_rate", "confusion_matrix", "true_negatives", "false_positives",
                "false_negatives", "true_positives"]


def with_metrics(counts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Counters -> metric columns; ``keep`` columns pass through first."""
    keep = keep if keep is not None else [c for c in counts.columns if c not in COUNTER_COLUMNS]
    return counts.select(*keep, "n", *metric_columns())


def calculate_metrics(df: DataFrame, by: list[str] | None = None, label: str = "label",
                      prediction: str = "prediction") -> DataFrame:
    """Metrics of labelled predictions, one row per ``by`` group."""
    by = list(by or [])
    return with_metrics(confusion_counts(df, by, label, prediction), keep=by)


#: Further metrics by name: an aggregate over ``label`` and ``prediction``, and whether more is better.
_REGISTERED: dict = {}


def register_metric(name: str, aggregate, more_is_better: bool = True) -> None:
    """A metric of one's own: ``aggregate()`` gives an aggregate column over the
    columns ``label`` and ``prediction``.  It may then be named wherever a metric is."""
    if name in METRIC_NAMES:
        raise ValueError(f"'{name}' is a metric already")
    _REGISTERED[name] = (aggregate, more_is_better)


def metric_value(df: DataFrame, name: str, label: str = "label", prediction: str = "prediction") -> float | None:
    """One metric of labelled predictions, by name; None without rows."""
    rows = df.select(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
    if name in _REGISTERED:
        value = rows.agg(_REGISTERED[name][0]().cast("double").alias("value")).first()["value"]
        return None if value is None else float(value)
    if name not in METRIC_NAMES or name == "confusion_matrix":
        raise ValueError(f"unknown metric '{name}'; options: {sorted([*METRIC_NAMES, *_REGISTERED])}")
    row = calculate_metrics(rows).first()
    return float(row[name]) if row and row["n"] else None


def more_is_better(name: str) -> bool:
    return _REGISTERED[name][1] if name in _REGISTERED else name not in FEWER_IS_BETTER


FEWER_IS_BETTER = {"invalid_predictions", "invalid_rate", "false_positives", "false_negatives"}


def metrics_from_confusion(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Metrics from stored counters (tn, fp, fn, tp, invalid, n) — used to
    re-derive published results."""
    return with_metrics(df, keep)


def with_correct(df: DataFrame) -> DataFrame:
    """``correct`` = label equals prediction (NULL-safe: NULL is wrong)."""
    return df.withColumn("correct", F.coalesce(F.col("label") == F.col("prediction"), F.lit(False)))


def error_rows(df: DataFrame) -> DataFrame:
    """Rows whose prediction differs from the label, invalid answers included."""
    return with_correct(df).where(~F.col("correct"))


def false_positives(df: DataFrame) -> DataFrame:
    """Label 0 predicted as 1 (an invalid answer is neither FP nor FN here)."""
    return df.where((F.col("label") == 0) & (F.col("prediction") == 1))


def false_negatives(df: DataFrame) -> DataFrame:
    return df.where((F.col("label") == 1) & (F.col("prediction") == 0))


def error_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Error count, rate, FP and FN counts per group (error analysis)."""
    y, p = F.col("label"), F.col("prediction")
    wrong = ~F.coalesce(y == p, F.lit(False))
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(wrong).alias("n_errors"),
        (F.count_if(wrong) / F.count(F.lit(1))).alias("error_rate"),
        F.count_if((y == 0) & (p == 1)).alias("n_false_positives"),
        F.count_if((y == 1) & (p == 0)).alias("n_false_negatives"),
        F.count_if(~is_valid_prediction("prediction")).alias("n_invalid"),
    )


def first_example(df: DataFrame, by: list[str] | None = None, order: str = "doc_id") -> DataFrame:
    """The first row of each group in ``order`` (the example shown for a
    subset such as the false positives): a partial aggregate, so a group of
    any size sends one row per task."""
    by = list(by or [])
    rest = [c for c in df.columns if c not in by]
    first = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*by, "_first.*").select(*df.columns)


def timing_aggs(time_col: str = "inference_time") -> list[Column]:
    t = F.col(time_col)
    return [F.sum(t).alias("total_inference_time"), F.avg(t).alias("avg_inference_time")]
