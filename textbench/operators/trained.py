"""Supervised baseline: a distributed text classifier trained per dataset.

Re-aims the fine-tuned transformer baseline as a ``pyspark.ml`` pipeline
(tokenizer -> hashed term frequencies -> IDF -> linear classifier).  The
hold-out split, the validation carve-out, model selection on validation
F1 and the result document follow the benchmark's protocol; training and
prediction are ordinary distributed ML jobs.  Whole texts are featurised
(a bag-of-words model has no sequence limit).

Boosted trees are evaluated on the validation rows after each iteration while they
train; training stops when that loss rises, the trees up to the best iteration are
kept, and the losses of each iteration are in the result document.  Candidates are
compared by a named metric of the validation rows (``metric``: F1 by default, or one
given to :func:`textbench.operators.metrics.register_metric`).  With ``models_path``
fitted models are kept and used again for the same rows and settings.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FINE_TUNED_STRATEGY, TRAINING_CONFIG
from ..functions.text import coerce_text
from ..sources.datasets import attach_text
from ..sources.results import TRAINING_CONFIG_TYPE
from .fingerprint import digests, settings_digest
from .metrics import calculate_metrics, metric_value, more_is_better
from .model_store import ModelStore
from .sampling import three_way_assignment


@dataclass
class BaselineSpec:
    name: str
    classifier: str = "logreg"          # "logreg", "naive_bayes" or "boosted_trees"
    reg_params: list = field(default_factory=lambda: [0.0, 0.1])  # smoothing, for trees the step sizes
    num_features: int | None = None     # instead of the configured number; trees want few
    max_depth: int = 4                  # of trees


DEFAULT_BASELINES = [BaselineSpec("spark-ml/tfidf-logreg"),
                     BaselineSpec("spark-ml/tfidf-naive-bayes", "naive_bayes", reg_params=[1.0])]

#: Most bytes of text whose vectors one partition of the rows to fit has, where there are enough rows.
FIT_BYTES = 512 << 20


def featurizer(num_features: int) -> Pipeline:
    """Whole text -> lower-case word tokens -> hashed term counts -> TF-IDF."""
    tok = RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=r"\W+", toLowercase=True, minTokenLength=1)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="features")
    return Pipeline(stages=[tok, tf, idf])


def classifier(spec: BaselineSpec, reg: float, config: dict):
    if spec.classifier == "naive_bayes":
        return NaiveBayes(featuresCol="features", labelCol="_y", smoothing=reg, modelType="multinomial")
    if spec.classifier == "boosted_trees":
        return GBTClassifier(featuresCol="features", labelCol="_y", stepSize=reg or 0.1, maxDepth=spec.max_depth,
                             maxIter=int(config["max_iterations"]), seed=int(config["seed"]),
                             validationIndicatorCol="_validation", validationTol=0.0)
    return LogisticRegression(featuresCol="features", labelCol="_y", regParam=reg, elasticNetParam=0.0,
                              maxIter=int(config["max_iterations"]))


def _prep(df: DataFrame) -> DataFrame:
    return df.select("*", coerce_text("text").alias("_text"), F.col("label").cast("double").alias("_y"))


def prepare_splits(spark: SparkSession, corpus: DataFrame, dataset: str, sample_size: int | None,
                   config: dict | None = None, texts: DataFrame | None = None) -> dict:
    """Feature vectors of one dataset's fit, validation and test rows.

    The split (:func:`three_way_assignment`) is decided on keys and labels, and
    the texts join once: term counts are persisted before the IDF is fitted.  The
    featurizer (IDF) is fitted on the fit rows only, once per dataset; keys and
    vectors of all three parts are persisted, never the texts: every classifier and
    regularisation value of the dataset reads them, and ML training reads its input
    once per optimiser pass.

    Each optimiser pass sends a vector of all features for every partition: the rows
    to fit are read in as many partitions as there are cores, more only where one
    would have over ``FIT_BYTES`` of text."""
    config = dict(TRAINING_CONFIG) | (config or {})
    data = corpus.where(F.col("dataset") == dataset)
    split = three_way_assignment(data if texts is None else data.select("dataset", "doc_id", "label"), sample_size,
                                 float(config["test_size"]), int(config["seed"]))
    rows = _prep(split if texts is None else attach_text(split, texts))
    t0 = time.perf_counter()
    *counting, idf = featurizer(int(config["num_features"])).getStages()
    counted = PipelineModel(counting).transform(rows).select(
        "split", "dataset", "doc_id", "label", "_y", "_tf", F.xxhash64("_text").alias("_hash"),
        F.octet_length("_text").alias("_bytes"),
        (F.col("split") == "validation").alias("_validation")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        text_bytes = counted.agg(F.sum("_bytes")).first()[0] or 0
        parts = max(spark.sparkContext.defaultParallelism, -(-text_bytes // FIT_BYTES))
        idf_model = idf.fit(counted.where("split = 'train'").coalesce(parts))
        feat_model = PipelineModel([*counting, idf_model])
        vectors = idf_model.transform(counted).select(
            "split", "dataset", "doc_id", "label", "_y", "features", "_hash", "_validation").persist(
            StorageLevel.MEMORY_AND_DISK)
        digest = digests(vectors, ["doc_id", "label", "_hash"], ["split"])  # reads all vectors
    finally:
        counted.unpersist()
    return {"vectors": vectors, "featurize_time": time.perf_counter() - t0, "featurizer": feat_model,
            "digest": sorted((k[0], v) for k, v in digest.items() if k[0] != "test"),
            "parts": parts, "fit": vectors.where("split = 'train'"), "val": vectors.where("split = 'validation'"),
            "test": vectors.where("split = 'test'")}


def _optimiser(model, config: dict) -> tuple[int | None, bool | None]:
    """Iterations that a fit took and whether it ended before the limit; a
    closed-form classifier has neither."""
    try:
        iterations = int(model.summary.totalIterations) if hasattr(model, "summary") else model.getNumTrees
    except Exception:
        return None, None
    return iterations, iterations < int(config["max_iterations"])


def _history(spec: BaselineSpec, model, splits: dict) -> list[tuple]:
    """(iteration, loss on the fit rows, loss on the validation rows) of every kept
    iteration; linear models report the first only."""
    if spec.classifier == "boosted_trees":
        losses = [model.evaluateEachIteration(splits[part]) for part in ("fit", "val")]
        return [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(*losses))]
    if spec.classifier == "logreg":
        return [(i, float(loss), None) for i, loss in enumerate(model.summary.objectiveHistory)]
    return []


def fit_classifier(spec: BaselineSpec, reg: float, splits: dict, config: dict):
    """One fit.  Trees see the validation rows, marked, to stop by their loss; the
    model then has the trees up to the best iteration."""
    rows = splits["fit"]
    if spec.classifier == "boosted_trees":
        rows = splits["vectors"].where("split != 'test'")
    return classifier(spec, reg, config).fit(rows.coalesce(splits["parts"]))


def fit_best(spec: BaselineSpec, splits: dict, config: dict) -> tuple:
    """Fits each regularisation value, keeps the best by the validation metric (first
    on ties), and reports what the fit was."""
    metric = config.get("metric", "f1_score")
    sign = 1 if more_is_better(metric) else -1
    best, best_score, best_reg = None, None, None
    for reg in spec.reg_params:
        model = fit_classifier(spec, reg, splits, config)
        score = metric_value(_predicted(model, splits["val"]), metric)
        if best is None or score is not None and (best_score is None or sign * score > sign * best_score):
            best, best_score, best_reg = model, score, reg
    iterations, converged = _optimiser(best, config)
    history = _history(spec, best, splits)
    return best, {
        "reg_param": float(best_reg), "metric": metric, "validation_score": best_score,
        "validation_f1": best_score if metric == "f1_score" else metric_value(_predicted(best, splits["val"]), "f1_score"),
        "iterations": iterations, "converged": converged, "history": history,
        "best_iteration": iterations if spec.classifier == "boosted_trees" else None}


def _predicted(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("dataset", "doc_id", "label", F.col("prediction").cast("int").alias("prediction"))


def train_and_evaluate(spec: BaselineSpec, splits: dict, config: dict | None = None, store: ModelStore | None = None,
                       dataset: str = "") -> tuple[DataFrame, dict]:
    """Fit (or take from ``store`` the model that was fitted on the same rows with
    the same settings) and predict the test rows."""
    config = dict(TRAINING_CONFIG) | (config or {})
    t0 = time.perf_counter()
    settings = {k: v for k, v in config.items() if k != "test_size"}
    fingerprint = settings_digest(spec, settings, splits["digest"])
    found = store.newest(spec.name, dataset, fingerprint) if store else None
    if found:
        pipeline, info, path = found
        best = pipeline.stages[-1]
        info["history"] = [tuple(x) for x in info["history"]]
        training_time = info.pop("training_time")
    else:
        best, info = fit_best(spec, splits, config)
        training_time = time.perf_counter() - t0 + splits["featurize_time"]
        path = store.save(PipelineModel([*splits["featurizer"].stages, best]), spec.name, dataset, fingerprint,
                          info | {"training_time": training_time}) if store else None
    t1 = time.perf_counter()
    pred = _predicted(best, splits["test"]).persist(StorageLevel.MEMORY_AND_DISK)
    n = pred.count()
    predict_time = time.perf_counter() - t1
    info |= {"training_time": training_time, "per_row_time": predict_time / max(n, 1), "n_test": n,
             "classifier": spec.classifier, "num_features": int(config["num_features"]),
             "max_iterations": int(config["max_iterations"]) if info["iterations"] is not None else None,
             "seed": int(config["seed"]), "test_size": float(config["test_size"]),
             "model_path": path, "reused": found is not None}
    return pred, info


def run_baselines(spark: SparkSession, corpus: DataFrame, datasets: list[str], specs: list | None = None,
                  sample_size: int | None = 1000, config: dict | None = None, done: DataFrame | None = None,
                  parallelism: int = 4, texts: DataFrame | None = None, on_result=None,
                  models_path: str | None = None) -> DataFrame:
    """Flat result rows (same shape as the grid's) for every pending baseline x
    dataset; a failing experiment becomes an error row, the others go on.
    ``done``: earlier results; baselines with a successful result are skipped.
    ``texts``: splits are decided on the keys of ``corpus``, texts join after.
    ``on_result(flat)``: called with each baseline's row as it ends, to save it.
    ``models_path``: a shared folder in which fitted models are kept; a run that
    finds one of the same rows and settings there predicts with it."""
    config = dict(TRAINING_CONFIG) | (config or {})
    specs = specs or DEFAULT_BASELINES
    finished = set()
    if done is not None:
        finished = {(r["model"], r["dataset"]) for r in
                    done.where(F.col("error").isNull() & (F.col("strategy") == FINE_TUNED_STRATEGY))
                    .select("model", "dataset").distinct().collect()}  # one row per experiment
    saving = Lock()
    store = ModelStore(spark, models_path) if models_path else None

    def ended(name, ds, error, metrics=None, info=None):
        row = {"model": name, "strategy": FINE_TUNED_STRATEGY, "dataset": ds, "error": error,
               "sample_size": sample_size, **{k: v for k, v in (metrics or {}).items() if k in _FLAT_COLUMNS},
               **{k: v for k, v in (info or {}).items() if k in _FLAT_COLUMNS}}
        if info:
            row |= {"avg_inference_time": info["per_row_time"],
                    "total_inference_time": info["per_row_time"] * info["n_test"]}
        row = tuple(row.get(c) for c in _FLAT_COLUMNS)
        if on_result is not None:
            with saving:  # one writer at a time in the result folder
                on_result(spark.createDataFrame([row], _FLAT_SCHEMA))
        return row

    def one_dataset(ds):
        todo = [s for s in specs if (s.name, ds) not in finished]
        if not todo:
            return []
        out_rows = []
        for n in sorted({s.num_features or int(config["num_features"]) for s in todo}):
            sized = config | {"num_features": n}
            group = [s for s in todo if (s.num_features or int(config["num_features"])) == n]
            try:
                splits = prepare_splits(spark, corpus, ds, sample_size, sized, texts)
            except Exception as e:
                out_rows += [ended(spec.name, ds, f"{type(e).__name__}: {e}") for spec in group]
                continue

            def one_spec(spec, splits=splits, sized=sized):
                try:
                    pred, info = train_and_evaluate(spec, splits, sized, store, ds)
                    m = calculate_metrics(pred.withColumn("model", F.lit(spec.name)), ["model", "dataset"]).first()
                    pred.unpersist()
                except Exception as e:  # one failed experiment does not stop the grid
                    return ended(spec.name, ds, f"{type(e).__name__}: {e}")
                return ended(spec.name, ds, None, m.asDict(), info)

            # the classifiers of a dataset share its persisted vectors
            with ThreadPoolExecutor(max_workers=max(1, min(len(group), parallelism))) as inner:
                out_rows += list(inner.map(one_spec, group))
            splits["vectors"].unpersist()
        return out_rows

    # datasets are independent experiments: their (small) jobs run side by
    # side so the executors are not left idle between optimiser passes
    with ThreadPoolExecutor(max_workers=max(1, min(len(datasets), parallelism))) as pool:
        rows = [r for part in pool.map(one_dataset, datasets) for r in part]
    return spark.createDataFrame(rows, _FLAT_SCHEMA)


_FLAT_SCHEMA = ("model string, strategy string, dataset string, error string, sample_size long, n long, "
                "accuracy double, precision double, recall double, f1_score double, precision_macro double, "
                "recall_macro double, f1_macro double, invalid_predictions long, invalid_rate double, "
                "true_negatives long, false_positives long, false_negatives long, true_positives long, "
                "avg_inference_time double, total_inference_time double, training_time double, "
                "classifier string, num_features int, reg_param double, max_iterations int, iterations int, "
                "converged boolean, validation_f1 double, seed int, test_size double, metric string, "
                "validation_score double, best_iteration int, "
                "history array<struct<iteration:int,train_loss:double,validation_loss:double>>, "
                "model_path string, reused boolean")
_FLAT_COLUMNS = [c.split(" ")[0] for c in _FLAT_SCHEMA.split(", ")]


def baseline_results(flat: DataFrame) -> DataFrame:
    """Flat baseline rows -> result documents: metrics with the training time,
    and as ``training_config`` what the run used."""
    from ..plans.grid import as_results
    docs = as_results(flat.withColumn("confusion_matrix", F.array(F.array("true_negatives", "false_positives"),
                                                                  F.array("false_negatives", "true_positives"))))
    names = TRAINING_CONFIG_TYPE.fieldNames()
    used = flat.select("model", "strategy", "dataset", "training_time", F.struct(*names).alias("training_config"))
    m = docs.schema["metrics"].dataType.fieldNames()
    ok = F.col("error").isNull()
    metrics = F.when(ok, F.struct(
        *[(F.col("training_time") if f == "training_time" else F.col(f"metrics.{f}")).alias(f) for f in m]))
    return (docs.join(used, ["model", "strategy", "dataset"]).withColumn("metrics", metrics).drop("training_time")
            .withColumn("training_config", F.when(ok, F.col("training_config"))))
