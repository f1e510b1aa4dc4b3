"""Newest results, generation options, baseline resume and documents, model info."""

import os

import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SF001
from textbench import testbed
from textbench.operators import registry, scoring, trained
from textbench.sources import results


def test_latest_results(spark):
    df = spark.createDataFrame([
        ("m", "s", "d", "2026-01-01T00:00:00.000000", None, 1),
        ("m", "s", "d", "2026-01-02T00:00:00.000000", None, 2),
        ("m", "s", "d", "2026-01-03T00:00:00.000000", "boom", 3),
        ("m", "s", "e", "2026-01-01T00:00:00.000000", None, 4)],
        "model string, strategy string, dataset string, timestamp string, error string, v int")
    got = {r["dataset"]: r["v"] for r in results.latest_results(df).collect()}
    assert got == {"d": 2, "e": 4}
    assert {r["v"] for r in results.latest_results(df, successful_only=False).collect()} == {3, 4}


def test_generation_options_reach_factory(spark):
    def factory(options):
        def gen(prompts: pd.Series) -> pd.Series:
            return prompts.map(lambda p: f"t={options['temperature']} n={options['max_new_tokens']}")
        return gen
    m = scoring.PythonModel("py", factory, options={"max_new_tokens": 7})
    df = spark.createDataFrame([("py", "x")], "model string, prompt string")
    r = scoring.score(df, [m]).first()
    assert r["response"] == "t=0.1 n=7" and r["error"] is None


def test_python_model_row_errors_and_fallback(spark):
    def bad():
        def gen(prompts):
            if (prompts == "boom").any():
                raise RuntimeError("model down")
            return prompts.map(lambda p: "Falsa")
        return gen

    def fallback():
        return lambda prompts: prompts.map(lambda p: "Verdadeira")
    df = spark.createDataFrame([("py", "ok"), ("py", "boom")], "model string, prompt string")
    out = {r["prompt"]: r for r in scoring.score(df, [scoring.PythonModel("py", bad)]).collect()}
    assert out["ok"]["response"] == "Falsa" and out["boom"]["error"].startswith("RuntimeError")
    out = {r["prompt"]: r for r in scoring.score(df, [scoring.PythonModel("py", bad, fallback_factory=fallback)])
           .collect()}
    assert out["boom"]["response"] == "Verdadeira" and out["boom"]["error"] is None


def test_model_info(spark):
    info = {r["model"]: r for r in registry.model_info(spark, ["Qwen/Qwen2-1.5B-Instruct", "x/unknown"]).collect()}
    assert info["Qwen/Qwen2-1.5B-Instruct"]["backend_name"] == "qwen2:1.5b-instruct"
    assert info["Qwen/Qwen2-1.5B-Instruct"]["num_parameters"] == 1.5
    assert info["x/unknown"]["backend_name"] is None


def test_baseline_resume_and_documents(spark, scratch):
    c = testbed.corpus(spark, SF001, ["toxic"])
    spec = [trained.BaselineSpec("spark-ml/tfidf-naive-bayes", "naive_bayes", reg_params=[1.0])]
    flat = trained.run_baselines(spark, c, ["toxic"], spec, sample_size=100)
    docs = trained.baseline_results(flat)
    path = os.path.join(scratch, "results")
    results.write_results(docs, path)
    back = results.read_results(spark, path).collect()
    assert len(back) == 1 and back[0]["strategy"] == "fine_tuned"
    assert back[0]["metrics"]["training_time"] > 0 and back[0]["training_config"]["classifier"] == "naive_bayes"
    again = trained.run_baselines(spark, c, ["toxic"], spec, sample_size=100,
                                  done=results.read_results(spark, path))
    assert again.count() == 0
