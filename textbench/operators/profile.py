"""Corpus profiling: counts, class balance, text-length statistics.

Quantiles are exact and computed without gathering, sorting or windowing a
group (:mod:`textbench.operators.quantiles`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_length
from .quantiles import box_statistics


def dataset_stats(corpus: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total, class counts and mean/min/max text length in one pass."""
    by = list(by if by is not None else ["dataset"])
    n = text_length("text")
    return corpus.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col("label") == 1).alias("fake_samples"),
        F.count_if(F.col("label") == 0).alias("true_samples"),
        F.avg(n).alias("avg_text_length"),
        F.min(n).alias("min_text_length"),
        F.max(n).alias("max_text_length"),
    )


STAT_NAMES = ["total_samples", "fake_samples", "true_samples", "avg_text_length", "min_text_length",
              "max_text_length"]


def dataset_comparison(stats: DataFrame, datasets: list[str]) -> DataFrame:
    """Statistics as rows, datasets as columns (unpivot, then pivot on the
    dataset names; the stats frame has one row per dataset)."""
    long = stats.select("dataset", *[F.col(c).cast("double").alias(c) for c in STAT_NAMES]).unpivot(
        "dataset", STAT_NAMES, "stat", "value")
    return long.groupBy("stat").pivot("dataset", datasets).agg(F.first("value"))


def class_distribution(corpus: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per label (NULL labels left out), with the share of each class
    in percent; the share window runs over the aggregated rows only."""
    by = list(by if by is not None else ["dataset"])
    counts = corpus.where(F.col("label").isNotNull()).groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    return counts.withColumn("share_pct", F.col("n") * 100.0 / F.sum("n").over(w))


def integer_box_stats(df: DataFrame, value: Column | str, by: list[str]) -> DataFrame:
    """Box-plot statistics of an integer column per group (:func:`box_statistics`)."""
    v = F.col(value) if isinstance(value, str) else value
    return box_statistics(df, v.cast("long"), by)


def length_box_stats(corpus: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = list(by if by is not None else ["dataset", "label"])
    return integer_box_stats(corpus.where(F.col("label").isNotNull()), text_length("text"), by)


def box_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Box-plot statistics of a real-valued column per group (:func:`box_statistics`)."""
    return box_statistics(df, F.col(value).cast("double"), by)
