"""Metric operators against published confusion matrices (golden values)."""

import pytest
from pyspark.sql import functions as F

from textbench.operators import metrics

# published counters and metrics of six experiments (n = 1000 each):
# tn, fp, fn, tp, invalid, accuracy, precision, recall, f1, precision_macro, recall_macro, f1_macro
GOLDEN = [
    (266, 234, 369, 131, 0, 0.397, 0.3589, 0.2620, 0.3029, 0.388901, 0.397000, 0.385806),
    (390, 110, 490, 10, 0, 0.400, 0.0833, 0.0200, 0.0323, 0.263258, 0.400000, 0.298738),
    (0, 500, 500, 0, 1000, 0.000, 0.0000, 0.0000, 0.0000, 0.000000, 0.000000, 0.000000),
    (0, 500, 499, 1, 998, 0.001, 0.0020, 0.0020, 0.0020, 0.000998, 0.001000, 0.000999),
    (19, 481, 326, 174, 444, 0.193, 0.2656, 0.3480, 0.3013, 0.160361, 0.193000, 0.173135),
    (499, 1, 1, 499, 0, 0.998, 0.9980, 0.9980, 0.9980, 0.998000, 0.998000, 0.998000),
]


def _counts(spark, rows):
    return spark.createDataFrame(
        [(i, tn + fp + fn + tp, tn, fp, fn, tp, inv) for i, (tn, fp, fn, tp, inv, *_) in enumerate(rows)],
        "id int, n long, true_negatives long, false_positives long, false_negatives long, true_positives long, "
        "invalid_predictions long")


def test_golden_confusion_matrices(spark):
    out = {r["id"]: r for r in metrics.metrics_from_confusion(_counts(spark, GOLDEN), keep=["id"]).collect()}
    for i, g in enumerate(GOLDEN):
        r = out[i]
        assert r["accuracy"] == pytest.approx(g[5], abs=5e-5)
        assert r["precision"] == pytest.approx(g[6], abs=5e-5)
        assert r["recall"] == pytest.approx(g[7], abs=5e-5)
        assert r["f1_score"] == pytest.approx(g[8], abs=5e-5)
        assert r["precision_macro"] == pytest.approx(g[9], abs=5e-7)
        assert r["recall_macro"] == pytest.approx(g[10], abs=5e-7)
        assert r["f1_macro"] == pytest.approx(g[11], abs=5e-7)
        assert r["invalid_rate"] == pytest.approx(g[4] / 1000)
        assert r["confusion_matrix"] == [[g[0], g[1]], [g[2], g[3]]]


def test_macro_absent_class(spark):
    rows = [(0, 0, 0, 5, 0), (390, 110, 490, 10, 0), (0, 500, 500, 0, 0)]
    out = metrics.metrics_from_confusion(_counts(spark, rows), keep=["id"]).orderBy("id").collect()
    assert out[0]["precision_macro"] == 1.0
    assert out[1]["precision_macro"] == pytest.approx(0.263257575, abs=1e-8)
    assert out[2]["precision_macro"] == 0.0


def test_row_level_metrics_and_invalid(spark):
    # label, prediction: one invalid (-1) and one NULL answer, both scored wrong
    rows = [(0, 0), (0, 1), (1, 1), (1, 0), (1, -1), (0, None)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    r = metrics.calculate_metrics(df).first()
    assert (r["true_negatives"], r["false_positives"], r["false_negatives"], r["true_positives"]) == (1, 2, 2, 1)
    assert r["invalid_predictions"] == 2 and r["n"] == 6
    assert r["accuracy"] == pytest.approx(2 / 6)
    s = metrics.error_summary(df).first()
    assert (s["n_errors"], s["n_false_positives"], s["n_false_negatives"]) == (4, 1, 1)


def test_metric_bounds_random(spark):
    df = spark.range(2000).select((F.col("id") % 2).cast("int").alias("label"),
                                  ((F.col("id") * 7919) % 3 - 1).cast("int").alias("prediction"),
                                  (F.col("id") % 5).alias("g"))
    for r in metrics.calculate_metrics(df, ["g"]).collect():
        assert r["true_negatives"] + r["false_positives"] + r["false_negatives"] + r["true_positives"] == r["n"]
        for c in ("accuracy", "precision", "recall", "f1_score", "precision_macro", "recall_macro", "f1_macro"):
            assert 0.0 <= r[c] <= 1.0
