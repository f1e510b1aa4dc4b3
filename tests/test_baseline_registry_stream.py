"""Supervised baseline, registry joins and streaming metrics."""

import os
import time

from pyspark.sql import functions as F

from tests.conftest import SF01
from textbench import testbed
from textbench.operators import registry, trained
from textbench.operators.metrics import calculate_metrics
from textbench.streaming import metrics_stream


def test_trained_baseline(spark):
    c = testbed.corpus(spark, SF01)
    out = trained.run_baselines(spark, c, ["quality", "toxic"], sample_size=100).collect()
    assert len(out) == 4
    for r in out:
        assert r["error"] is None, r["error"]
        assert r["strategy"] == "fine_tuned"
        assert r["n"] == 100
        assert r["true_negatives"] + r["false_positives"] + r["false_negatives"] + r["true_positives"] == 100
        assert 0.0 <= r["f1_score"] <= 1.0 and r["training_time"] > 0


def test_backend_lookup_and_resolution(spark):
    models = spark.createDataFrame([("Qwen/Qwen2-7B-Instruct",), ("lucianosb/boto-9B-it",)], "model string")
    look = {r["model"]: r for r in registry.backend_lookup(models, registry.registry_frame(spark)).collect()}
    assert look["Qwen/Qwen2-7B-Instruct"]["backend_name"] == "qwen2:7b-instruct"
    assert look["lucianosb/boto-9B-it"]["backend_name"] is None
    assert "not in the back-end registry" in look["lucianosb/boto-9B-it"]["error"]
    configured = spark.createDataFrame([("sabia", "hf.co/TheBloke/sabia-7B-GGUF:latest"),
                                        ("qwen", "qwen2:7b-instruct"), ("none", "missing:1b")],
                                       "model string, backend_name string")
    available = spark.createDataFrame([("other:1b", 0), ("https://huggingface.co/TheBloke/sabia-7B-GGUF", 1),
                                       ("hf.co/thebloke/sabia-7b-gguf:q4", 2), ("qwen2:7b-instruct", 3)],
                                      "name string, position int")
    res = {r["model"]: r["resolved"] for r in registry.resolve_backend_names(configured, available).collect()}
    assert res == {"sabia": "https://huggingface.co/TheBloke/sabia-7B-GGUF", "qwen": "qwen2:7b-instruct",
                   "none": "missing:1b"}


def test_streaming_metrics_match_batch(spark, scratch):
    src = os.path.join(scratch, "scored")
    rows = [("m", "s", "d", i, i % 2, (i * 7) % 3 - 1, 0.01, None) for i in range(200)]
    df = spark.createDataFrame(rows, metrics_stream.SCORED_SCHEMA)
    df.where("doc_id < 100").write.parquet(os.path.join(src, "batch=0"))
    seen = {}

    def sink(batch, epoch):
        seen["last"] = batch.collect()

    q = metrics_stream.start_metrics_stream(spark, src, sink, name=f"test_{int(time.time())}")
    try:
        q.processAllAvailable()
        first = seen["last"][0]
        assert first["n"] == 100
        df.where("doc_id >= 100").write.parquet(os.path.join(src, "batch=1"))
        q.processAllAvailable()
    finally:
        q.stop()
    final = seen["last"][0]
    batch = calculate_metrics(df, ["model"]).first()
    assert final["n"] == 200
    for c in ("accuracy", "precision", "recall", "f1_score", "f1_macro", "invalid_predictions"):
        assert final[c] == batch[c]
