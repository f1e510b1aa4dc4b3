"""Evaluation while training, kept models, and the metric that chooses between them."""

import os

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from textbench.operators import metrics, trained
from textbench.operators.model_store import ModelStore
from textbench.sources import results

CONFIG = {"num_features": 64, "max_iterations": 25}


def _corpus(spark, noise=0.35, n=400, word="spam"):
    """Labels follow one word, and a third of them are turned by a hash: trees that go
    on learn the noise of the fit rows."""
    d = spark.range(n).select(F.lit("d").alias("dataset"), F.col("id").alias("doc_id"))
    truth = F.col("doc_id") % 2
    turned = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1000)) < int(noise * 1000)
    words = F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(40))) for k in range(6)])
    return d.select("*", F.when(turned, 1 - truth).otherwise(truth).cast("int").alias("label"),
                    F.concat(F.when(truth == 1, F.lit(word + " ")).otherwise("ham "), words).alias("text"))


TREES = trained.BaselineSpec("trees", "boosted_trees", reg_params=[0.5])


def test_trees_stop_at_the_best_iteration(spark, scratch):
    corpus = _corpus(spark)
    splits = trained.prepare_splits(spark, corpus, "d", None, CONFIG)
    whole = GBTClassifier(featuresCol="features", labelCol="_y", stepSize=0.5, maxDepth=4, maxIter=25, seed=42) \
        .fit(splits["fit"])
    losses = whole.evaluateEachIteration(splits["val"])
    assert min(losses) < losses[-1] - 0.05  # later iterations overfit
    flat = trained.run_baselines(spark, corpus, ["d"], [TREES], sample_size=None, config=CONFIG)
    path = os.path.join(scratch, "results")
    results.write_results(trained.baseline_results(flat), path)
    used = results.read_results(spark, path).first()["training_config"]
    assert used["best_iteration"] == len(used["history"]) < 25 and used["converged"]
    kept = [h["validation_loss"] for h in used["history"]]
    assert kept == sorted(kept, reverse=True) and kept[-1] < losses[-1]
    assert [h["iteration"] for h in used["history"]] == list(range(1, len(kept) + 1))
    assert used["metric"] == "f1_score" and used["validation_score"] == used["validation_f1"]
    splits["vectors"].unpersist()


def _count_fits(monkeypatch):
    fits, whole = [], trained.fit_classifier

    def counted(spec, reg, splits, config):
        fits.append((spec.name, reg))
        return whole(spec, reg, splits, config)
    monkeypatch.setattr(trained, "fit_classifier", counted)
    return fits


def test_a_run_that_failed_after_the_fit_uses_the_kept_model(spark, scratch, monkeypatch):
    fits = _count_fits(monkeypatch)
    corpus, path = _corpus(spark, n=200), os.path.join(scratch, "models")
    spec = trained.BaselineSpec("lr", reg_params=[0.1, 1.0])
    run = lambda c=corpus, s=spec, **kw: trained.run_baselines(
        spark, c, ["d"], [s], sample_size=None, config=CONFIG | kw, models_path=path).first()

    def fails(*_, **__):
        raise RuntimeError("lost after the fit")
    with monkeypatch.context() as m:
        m.setattr(trained, "calculate_metrics", fails)
        assert "lost after the fit" in run()["error"]
    assert len(fits) == 2
    again = run()
    assert again["error"] is None and again["reused"] and len(fits) == 2
    fresh = trained.run_baselines(spark, corpus, ["d"], [spec], sample_size=None, config=CONFIG).first()
    assert not fresh["reused"] and fresh["model_path"] is None
    assert all(again[k] == fresh[k] for k in ("f1_score", "true_positives", "reg_param", "validation_f1", "iterations"))
    n = len(fits)
    assert not run(_corpus(spark, n=200, word="other"))["reused"] and len(fits) == n + 2   # other rows
    assert not run(seed=7)["reused"] and len(fits) == n + 4                                # other settings
    assert not run(s=trained.BaselineSpec("lr", reg_params=[0.1]))["reused"] and len(fits) == n + 5
    assert run()["reused"] and len(fits) == n + 5


def test_the_newest_readable_model_is_taken(spark, scratch, monkeypatch):
    corpus, path = _corpus(spark, n=120), os.path.join(scratch, "models")
    spec = trained.BaselineSpec("nb", "naive_bayes", reg_params=[1.0])
    run = lambda: trained.run_baselines(spark, corpus, ["d"], [spec], sample_size=None, config=CONFIG,
                                        models_path=path).first()
    first = run()["model_path"]
    store = ModelStore(spark, path)
    model, info, _ = store.newest("nb", "d")
    fingerprint = store.registry().first()["fingerprint"]
    second = store.save(model, "nb", "d", fingerprint, info)
    assert run()["model_path"] == second
    os.rename(second, second + "-damaged")
    assert run()["model_path"] == first
    os.rename(first, first + "-damaged")
    fits = _count_fits(monkeypatch)
    assert run()["model_path"] not in (first, second) and len(fits) == 1
    # the kept pipeline reads texts
    out = store.newest("nb", "d")[0].transform(trained._prep(corpus))
    assert out.select("prediction").distinct().count() == 2
    assert store.newest("nb", "other") is None


def test_a_metric_of_ones_own_chooses_another_model(spark):
    corpus = _corpus(spark, noise=0.45)
    metrics.register_metric("caution", lambda: F.count_if(F.col("prediction") == 0) / F.count(F.lit(1)))
    metrics.register_metric("alarms", lambda: F.avg("prediction"), more_is_better=False)
    spec = trained.BaselineSpec("lr", reg_params=[0.0, 0.02, 5.0, 50.0])
    by = {m: trained.run_baselines(spark, corpus, ["d"], [spec], sample_size=None, config=CONFIG | {"metric": m}).first()
          for m in ("f1_score", "caution", "alarms")}
    assert by["f1_score"]["reg_param"] != by["caution"]["reg_param"] == by["alarms"]["reg_param"]
    assert by["caution"]["metric"] == "caution" and by["caution"]["validation_score"] > 0
    assert by["caution"]["validation_f1"] < by["f1_score"]["validation_f1"]
    with pytest.raises(ValueError, match="already"):
        metrics.register_metric("f1_score", lambda: F.lit(1))
    bad = trained.run_baselines(spark, corpus, ["d"], [spec], sample_size=None, config=CONFIG | {"metric": "none"}).first()
    assert "unknown metric" in bad["error"]


def test_fit_reads_as_many_partitions_as_cores(spark, monkeypatch):
    """An optimiser pass sends a vector of all features for each partition: their number
    must not grow with the input's.  Texts are read once for a dataset."""
    read = spark.sparkContext.accumulator(0)
    words = F.udf(lambda text: read.add(1) or text)
    corpus = _corpus(spark).repartition(64)
    texts = corpus.select("doc_id", words("text").alias("text"))
    splits = trained.prepare_splits(spark, corpus.drop("text"), "d", None, CONFIG, texts)
    assert read.value == 400  # 800 when the fit of the IDF read them on its own
    fitted = []

    class Fitted:
        def fit(self, rows):
            fitted.append(rows.rdd.getNumPartitions())
    monkeypatch.setattr(trained, "classifier", lambda *a: Fitted())
    splits["vectors"] = splits["vectors"].repartition(64)
    splits["fit"] = splits["vectors"].where("split = 'train'")
    for spec in (trained.DEFAULT_BASELINES[0], TREES):
        trained.fit_classifier(spec, 0.1, splits, CONFIG)
    assert max(fitted) <= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(trained, "FIT_BYTES", 1 << 9)
    more = trained.prepare_splits(spark, corpus, "d", None, CONFIG)
    assert more["parts"] > spark.sparkContext.defaultParallelism
