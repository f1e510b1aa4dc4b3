"""The benchmark grid as Spark jobs.

``pending = models x strategies x datasets`` minus cells that already have a
successful result -> balanced test sample and few-shot examples per dataset,
drawn on keys in one pass -> texts attached to the drawn rows in one probe ->
few-shot block per dataset -> prompts per (strategy, dataset) -> crossed with
the models of each cell -> scored -> parsed -> one ``groupBy`` for all metrics.

The resumable benchmark runs the pending cells in waves, one per model: scored
rows go to a fixed place beside the results and documents are written after
each wave, so a failure loses at most the wave it meets.  Rows and documents
carry a fingerprint of the prompts, labels, model and options they come from, and
are used again only under the same one.  Everything broadcast is bounded by the
grid size or by ``sample_size``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXPERIMENT_CONFIG
from ..functions.parsing import extract_prediction
from ..functions.prompts import build_prompt_by_strategy, check_strategies, few_shot_block
from ..functions.text import iso_timestamp
from ..operators.fingerprint import digests, settings_digest
from ..operators.metrics import METRIC_NAMES, counter_aggs, metric_columns, timing_aggs
from ..operators.sampling import sample_with_examples
from ..operators.scoring import OPTIONS_TYPE, ExprModel, generation_options, score
from ..session import scratch_path
from ..sources.datasets import attach_text
from ..sources.results import GENERATION_TYPE

KEYS = ["model", "strategy", "dataset"]

NO_EXAMPLES_ERROR = "few-shot examples unavailable: the pool outside the test set is too small"
EMPTY_SAMPLE_ERROR = "empty sample"


def experiment_grid(spark: SparkSession, models: list[str], strategies: list[str], datasets: list[str]) -> DataFrame:
    """models x strategies x datasets: a parameter table of
    ``len(models) * len(strategies) * len(datasets)`` rows in one partition
    (it is joined by broadcast everywhere it is used)."""
    cells = [(m, s, d) for m in models for s in strategies for d in datasets]
    return spark.createDataFrame(cells, "model string, strategy string, dataset string").coalesce(1)


def successful_keys(results: DataFrame) -> DataFrame:
    return results.where(F.col("error").isNull()).select(*KEYS).distinct()


def pending_cells(grid: DataFrame, results: DataFrame | None) -> DataFrame:
    """Cells without a successful result: missing, failed or unreadable."""
    if results is None:
        return grid
    return grid.join(successful_keys(results), KEYS, "left_anti")


def reusable_results(grid: DataFrame, results: DataFrame) -> DataFrame:
    """Successful results that belong to the grid and are kept as they are."""
    return results.where(F.col("error").isNull()).join(grid.select(*KEYS), KEYS, "left_semi")


def drawn_rows(corpus: DataFrame, sample_size: int, seed: int, n_examples: int,
               texts: DataFrame | None = None, datasets: int | None = None) -> DataFrame:
    """Test rows and examples of every dataset with their texts, in one frame
    (see :func:`textbench.operators.sampling.sample_with_examples`).

    ``texts`` (``doc_id, text``): rows are drawn on the keys and labels of
    ``corpus`` and the texts attached afterwards, in one probe of the text
    table; else ``corpus`` has the texts."""
    keys = corpus.select("dataset", "doc_id", "label") if texts is not None else corpus
    drawn = sample_with_examples(keys, sample_size, n_examples, seed)
    if texts is None:
        return drawn
    return attach_text(drawn, texts, at_most=None if datasets is None else datasets * (sample_size + n_examples))


def strategy_prompts(drawn: DataFrame, cells: DataFrame, n_examples: int, max_text_length: int) -> DataFrame:
    """One row per (strategy, dataset, test row) with its prompt.  Few shot cells
    whose dataset lacks examples carry ``prompt_error``."""
    test = drawn.where("_test").select("dataset", "doc_id", "text", "label")
    block = few_shot_block(drawn.where("NOT _test"), by=["dataset"], max_text_length=max_text_length)
    sd = cells.select("strategy", "dataset").distinct()
    return (test.join(F.broadcast(sd), "dataset")
            .join(F.broadcast(block), "dataset", "left")
            .withColumn("prompt", build_prompt_by_strategy("text", "strategy", "examples_text", max_text_length))
            .withColumn("prompt_error", F.when((F.col("strategy") == "few_shot")
                                               & (F.coalesce(F.col("n_examples"), F.lit(0)) < n_examples),
                                               F.lit(NO_EXAMPLES_ERROR)))
            .drop("examples_text", "n_examples", "text"))


def grid_prompts(drawn: DataFrame, cells: DataFrame, n_examples: int, max_text_length: int) -> DataFrame:
    """One row per (model, strategy, dataset, test row) with its prompt: prompts
    are built once per (strategy, dataset) and only then crossed with the models."""
    rows = strategy_prompts(drawn, cells, n_examples, max_text_length)
    return rows.join(F.broadcast(cells), ["strategy", "dataset"])


def score_grid(prompts: DataFrame, models: list, timing: str = "wall", partitions: int | None = None,
               row_options: Column | None = None) -> DataFrame:
    """Prompts scored and parsed.  ``row_options``: generation options of each row, a
    struct over the columns of ``prompts``; all rows get ``options``, what they were
    asked with."""
    if row_options is None:
        row_options = F.struct(F.lit(None).cast("int").alias("max_new_tokens"))
    prompts = prompts.withColumn("options", row_options)
    ok = prompts.where(F.col("prompt_error").isNull()).drop("prompt_error")
    scored = score(ok, models, timing=timing, partitions=partitions, options_col="options")
    bad = prompts.where(F.col("prompt_error").isNotNull()).select(
        *[c for c in prompts.columns if c not in ("prompt_error", "options")],
        F.lit(None).cast("string").alias("response"),
        F.lit(None).cast("double").alias("inference_time"),
        F.col("prompt_error").alias("error"), F.lit(None).cast(OPTIONS_TYPE).alias("options"))
    return scored.unionByName(bad).withColumn("prediction", extract_prediction("response"))


def cell_metrics(predictions: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per cell: counters, metrics, timing and the cell's error.  A
    single failing row fails its cell (``max(error)``); a cell without rows
    fails with ``empty sample``.  Metrics of failed cells are NULL."""
    agg = predictions.groupBy(*KEYS).agg(*counter_aggs(), *timing_aggs(), F.max("error").alias("_row_error"))
    joined = cells.select(*KEYS).join(agg, KEYS, "left")
    err = F.coalesce(F.col("_row_error"), F.when(F.col("n").isNull(), F.lit(EMPTY_SAMPLE_ERROR)))
    ok = err.isNull()
    mcols = [F.when(ok, c) for c in metric_columns()]
    mcols = [c.alias(n) for c, n in zip(mcols, METRIC_NAMES)]
    return joined.select(*KEYS, err.alias("error"), F.when(ok, F.col("n")).alias("n"), *mcols,
                         F.when(ok, F.col("avg_inference_time")).alias("avg_inference_time"),
                         F.when(ok, F.col("total_inference_time")).alias("total_inference_time"))


def run_grid(spark: SparkSession, corpus: DataFrame, models: list, strategies: list[str], datasets: list[str],
             sample_size: int = EXPERIMENT_CONFIG["test_sample_size"], seed: int = EXPERIMENT_CONFIG["random_seed"],
             n_examples: int = EXPERIMENT_CONFIG["few_shot_examples"], max_text_length: int = 2000,
             timing: str = "wall", done: DataFrame | None = None, predictions_path: str | None = None,
             partitions: int | None = None, model_names: list[str] | None = None,
             texts: DataFrame | None = None, drawn: DataFrame | None = None,
             row_options: Column | None = None) -> DataFrame:
    """Flat metrics for every pending cell of the grid, in one job.

    ``model_names``: the configured models (default: the registered ones);
    a configured model missing from ``models`` yields error rows for its
    cells, the other cells are unaffected.
    ``done``: earlier results; their successful cells are skipped (resume).
    ``texts``: see :func:`drawn_rows` (sample on keys, attach texts after);
    ``drawn``: such rows, if they are there already; else they are drawn first and
    written to the shared scratch folder, so that texts are read once however many
    kinds of models the rows are scored with.
    ``row_options``: see :func:`score_grid`.
    ``predictions_path``: when given, scored rows are written there (a
    table in shared storage, partitioned by cell) and the metrics are read
    from it, so model calls are never repeated after a lost executor."""
    check_strategies(strategies)
    grid = experiment_grid(spark, model_names or [m.name for m in models], strategies, datasets)
    cells = pending_cells(grid, done)
    if drawn is None:
        drawn = _written(drawn_rows(corpus, sample_size, seed, n_examples, texts, len(datasets)), "drawn")
    preds = score_grid(grid_prompts(drawn, cells, n_examples, max_text_length), models, timing, partitions, row_options)
    if predictions_path:
        write_predictions(preds, predictions_path)
        preds = read_predictions(spark, predictions_path, preds.schema).join(F.broadcast(cells), KEYS, "left_semi")
    return cell_metrics(preds, cells).withColumn("sample_size", F.lit(sample_size).cast("long"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Scored rows by cell; only the cells in ``predictions`` are replaced."""
    (predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS)
     .parquet(path))


def read_predictions(spark: SparkSession, path: str, schema) -> DataFrame:
    """Scored rows, the keys as text."""
    return spark.read.schema(schema).parquet(path)


def as_results(flat: DataFrame, models: list | None = None) -> DataFrame:
    """Flat cell metrics -> result documents (``metrics`` struct, timestamp, and
    the generation options of the ``models`` that were called)."""
    metric_fields = METRIC_NAMES + ["avg_inference_time", "total_inference_time"]
    metrics = F.when(F.col("error").isNull(), F.struct(
        *[F.col(c) for c in metric_fields],
        F.lit(None).cast("double").alias("vram_usage_gb"),
        F.lit(None).cast("double").alias("training_time")))
    generation = F.lit(None).cast(GENERATION_TYPE)
    for m in models or []:
        options = generation_options(m) | {"backend_name": m.backend_name}
        used = F.struct(*[F.lit(options.get(f.name)).cast(f.dataType).alias(f.name) for f in GENERATION_TYPE.fields])
        generation = F.when(F.col("model") == m.name, used).otherwise(generation)
    return flat.select(*KEYS, "sample_size", iso_timestamp().alias("timestamp"), "error",
                       metrics.alias("metrics"), generation.alias("generation"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def model_digest(name: str, models: list, timing: str, row_options: Column | None = None) -> str:
    """What a configured model would answer with: its rule or code, its options and
    the name its back end knows; a model that is not registered has its name only."""
    found = [m for m in models if m.name == name]
    if not found:
        return settings_digest("unregistered", name)
    m = found[0]
    what = m.sql if isinstance(m, ExprModel) else [m.factory, m.fallback_factory]
    options = None if row_options is None else row_options._jc.toString()
    return settings_digest(type(m).__name__, name, what, generation_options(m), timing, options)


def experiment_fingerprints(prompts: DataFrame, cells: list[tuple], models: list, timing: str,
                            row_options: Column | None = None) -> dict[tuple, str]:
    """{cell: fingerprint} from the rows that the cell asks about (ids, labels and
    whole prompts, and with them texts, examples and templates) and its model."""
    rows = digests(prompts, ["doc_id", "label", "prompt", "prompt_error"], ["strategy", "dataset"])
    of_model = {name: model_digest(name, models, timing, row_options) for name in {c[0] for c in cells}}
    return {c: settings_digest(of_model[c[0]], rows.get((c[1], c[2]))) for c in cells}


def run_benchmark(spark: SparkSession, corpus: DataFrame, models: list, strategies: list[str],
                  datasets: list[str], results_path: str, model_names: list[str] | None = None,
                  predictions_path: str | None = None, sample_size: int = EXPERIMENT_CONFIG["test_sample_size"],
                  seed: int = EXPERIMENT_CONFIG["random_seed"],
                  n_examples: int = EXPERIMENT_CONFIG["few_shot_examples"], max_text_length: int = 2000,
                  timing: str = "wall", texts: DataFrame | None = None, row_options: Column | None = None,
                  **grid_options) -> DataFrame:
    """Resumable benchmark: cells with a successful document under
    ``results_path`` are kept, every other cell (missing, failed, corrupt) is
    run and its document rewritten in place.

    Pending cells run in waves, one per model.  A wave's scored rows are
    written to ``predictions_path`` (default: beside the results, in a folder
    named by the settings) and its documents right after, so a job that ends early keeps every finished wave, and a rerun
    takes cells whose rows were all scored without an error from that table and
    calls no model for them.

    Documents and scored rows hold the fingerprint of their experiment
    (:func:`experiment_fingerprints`); those of another corpus, sample, prompt,
    model, rule or options count as missing.  A document without one (written
    elsewhere) is kept.  Returns the result documents of the whole grid."""
    from ..sources.datasets import _exists
    from ..sources.results import read_results, write_results

    check_strategies(strategies)
    settings = settings_digest(sample_size, seed, n_examples, max_text_length, timing)
    predictions_path = predictions_path or f"{results_path.rstrip('/')}_predictions/{settings[:12]}"
    done = read_results(spark, results_path) if _exists(spark, results_path) else None
    names = model_names or [m.name for m in models]
    grid = experiment_grid(spark, names, strategies, datasets)
    every = [(m, s, d) for m in names for s in strategies for d in datasets]
    drawn = _written(drawn_rows(corpus, sample_size, seed, n_examples, texts, len(datasets)), "drawn")
    prompts = _written(strategy_prompts(drawn, grid, n_examples, max_text_length), "prompts")
    fingerprint = experiment_fingerprints(prompts, every, models, timing, row_options)
    kept = set()
    if done is not None:  # one row per experiment
        kept = {c for c, f in _fingerprints(done.where(F.col("error").isNull())) if f in (None, fingerprint.get(c))}
    pending = [c for c in every if c not in kept]
    if pending:
        expected = {r["dataset"]: r["n"] for r in drawn.where("_test").groupBy("dataset")
                    .agg(F.count(F.lit(1)).alias("n")).collect()}
        schema = prediction_schema(corpus)
        scored = (_scored_cells(read_predictions(spark, predictions_path, schema))
                  if _exists(spark, predictions_path) else {})
        for name in names:
            wave = [c for c in pending if c[0] == name]
            ready = [c for c in wave if expected.get(c[2]) and scored.get((*c, fingerprint[c])) == expected[c[2]]]
            asked = [c for c in wave if c not in ready]
            if asked:
                cells = _cells(spark, asked, fingerprint)
                rows = prompts.join(F.broadcast(cells), ["strategy", "dataset"])
                preds = score_grid(rows, [m for m in models if m.name == name], timing,
                                   grid_options.get("partitions"), row_options)
                write_predictions(preds, predictions_path)
            if wave:
                cells = _cells(spark, wave, fingerprint)
                rows = _scored_rows(spark, predictions_path, schema).join(F.broadcast(cells), [*KEYS, "fingerprint"], "left_semi")
                flat = cell_metrics(rows, cells).withColumn("sample_size", F.lit(sample_size).cast("long"))
                write_results(as_results(flat, models).join(F.broadcast(cells), KEYS), results_path)
    return read_results(spark, results_path).join(grid.select(*KEYS), KEYS, "left_semi")


def _scored_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The scored rows at ``path``; none where nothing could be asked yet."""
    from ..sources.datasets import _exists
    return read_predictions(spark, path, schema) if _exists(spark, path) else spark.createDataFrame([], schema)


def _fingerprints(results: DataFrame) -> list[tuple]:
    rows = results.select(*KEYS, "fingerprint").distinct().collect()
    return [(tuple(r[k] for k in KEYS), r["fingerprint"]) for r in rows]


def prediction_schema(corpus: DataFrame) -> str:
    """Columns of the scored rows; the keys are text."""
    options = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in OPTIONS_TYPE.fields)
    return (f"doc_id {corpus.schema['doc_id'].dataType.simpleString()}, label int, prompt string, fingerprint string, "
            f"options struct<{options}>, response string, inference_time double, error string, prediction int, "
            "model string, strategy string, dataset string")


def _cells(spark: SparkSession, cells: list[tuple], fingerprint: dict[tuple, str]) -> DataFrame:
    rows = [(*c, fingerprint[c]) for c in cells]
    return spark.createDataFrame(rows, ", ".join(f"{k} string" for k in [*KEYS, "fingerprint"])).coalesce(1)


def _scored_cells(predictions: DataFrame) -> dict:
    """{(cell, fingerprint): rows} of cells whose scored rows have no error: one row per experiment."""
    rows = predictions.groupBy(*KEYS, "fingerprint").agg(
        F.count(F.lit(1)).alias("n"), F.count("error").alias("bad")).collect()
    return {(*(r[k] for k in KEYS), r["fingerprint"]): r["n"] for r in rows if not r["bad"]}
