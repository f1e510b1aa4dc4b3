"""End-to-end jobs (what a cluster user submits).

``benchmark_job`` runs the resumable model grid and then the supervised
baseline (also resumable, same result folder), and writes the report over
all successful documents.  ``main`` is the ``spark-submit`` entry point
for corpora kept as a text table plus a label table.

    spark-submit -m textbench.plans.jobs --documents s3://.../documents \\
        --labels s3://.../labels --datasets datasets.json --results s3://.../results \\
        --report s3://.../report --models mypackage.backends:models

``--models module:function`` names a function that returns the list of models
(:class:`textbench.operators.scoring.PythonModel` or ``ExprModel``).
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession

from ..config import EXPERIMENT_CONFIG, PROMPTING_STRATEGIES
from ..operators import trained
from ..sources.datasets import corpus_keys_from_tables
from ..sources.results import read_results, successful_results, write_flat_results, write_results
from .grid import run_benchmark
from .report import generate_report


def benchmark_job(spark: SparkSession, corpus: DataFrame, models: list, datasets: list[str], results_path: str,
                  report_dir: str | None = None, strategies: list[str] | None = None,
                  model_names: list[str] | None = None, baselines: list | None = None,
                  sample_size: int = EXPERIMENT_CONFIG["test_sample_size"], texts: DataFrame | None = None,
                  models_path: str | None = None, training_config: dict | None = None, flat_path: str | None = None,
                  **grid_options) -> DataFrame:
    """Grid (resume) -> baselines (resume) -> report; returns the report rows.
    ``texts`` (``doc_id, text``): samples and splits are drawn on the keys of
    ``corpus`` and texts attached to the drawn rows.  Every document is written
    as its wave or baseline ends, and every fitted baseline is kept under
    ``models_path`` (default: beside the results).  ``flat_path``: a folder that gets
    each document as one named file, too."""
    strategies = strategies or PROMPTING_STRATEGIES
    run_benchmark(spark, corpus, models, strategies, datasets, results_path, model_names=model_names,
                  sample_size=sample_size, texts=texts, **grid_options)
    if baselines is not None:
        trained.run_baselines(spark, corpus, datasets, baselines, sample_size=sample_size, config=training_config,
                              models_path=models_path or f"{results_path.rstrip('/')}_models",
                              done=read_results(spark, results_path), texts=texts,
                              on_result=lambda flat: write_results(trained.baseline_results(flat), results_path))
    if flat_path:
        write_flat_results(read_results(spark, results_path), flat_path)
    ok = successful_results(spark, results_path)
    if report_dir:
        return generate_report(ok, report_dir)
    from .analysis import report_rows
    return report_rows(ok)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description="Run the benchmark grid, the baselines and the report.")
    ap.add_argument("--documents", required=True, help="Parquet table with doc_id and the text column")
    ap.add_argument("--labels", required=True, help="Parquet table with doc_id and the label columns")
    ap.add_argument("--datasets", required=True, help="JSON file: name -> {text_column, label_column, label_mapping}")
    ap.add_argument("--results", required=True)
    ap.add_argument("--report")
    ap.add_argument("--sample-size", type=int, default=EXPERIMENT_CONFIG["test_sample_size"])
    ap.add_argument("--no-baselines", action="store_true")
    ap.add_argument("--models", required=True, help="module:function returning the list of models")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("textbench").getOrCreate()
    configs = json.loads("\n".join(r["value"] for r in spark.read.text(a.datasets, wholetext=True).collect()))
    run_job(spark, spark.read.parquet(a.documents), spark.read.parquet(a.labels), configs, load_models(a.models),
            a.results, a.report, baselines=None if a.no_baselines else trained.DEFAULT_BASELINES,
            sample_size=a.sample_size)


def load_models(name: str) -> list:
    """The models that ``module:function`` returns."""
    module, _, function = name.partition(":")
    if not function:
        raise ValueError("--models must be module:function")
    return list(getattr(importlib.import_module(module), function)())


def run_job(spark: SparkSession, documents: DataFrame, labels: DataFrame, configs: dict, models: list, results: str,
            report: str | None = None, **options) -> DataFrame:
    """:func:`benchmark_job` over a text table and a label table: rows are drawn
    on keys and labels, the text table is only streamed past the drawn rows."""
    keys = corpus_keys_from_tables(documents, labels, configs)
    column = {c.get("text_column", "text") for c in configs.values()}
    if len(column) != 1:
        raise ValueError("the datasets of one job share a text column")
    texts = documents.select("doc_id", documents[column.pop()].alias("text"))
    return benchmark_job(spark, keys, models, list(configs), results, report, texts=texts, **options)


if __name__ == "__main__":
    main()
