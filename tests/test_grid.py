"""Grid job, result documents, resume semantics and report."""

import os

from pyspark.sql import functions as F

from tests.conftest import SF001
from textbench import testbed
from textbench.plans import analysis, grid, report
from textbench.sources import results


def _run(spark, path, models=None):
    return grid.run_benchmark(spark, testbed.corpus(spark, SF001), models or testbed.rule_models(),
                              testbed.STRATEGIES, list(testbed.TABLE_DATASETS), path,
                              model_names=testbed.MODEL_NAMES, sample_size=100, timing="prompt_length")


def test_grid_results_and_resume(spark, scratch):
    path = os.path.join(scratch, "results")
    first = _run(spark, path)
    assert first.count() == len(testbed.MODEL_NAMES) * 3 * 2
    failed = {tuple(r) for r in first.where("error IS NOT NULL").select(*grid.KEYS).collect()}
    assert {m for m, _, _ in failed} == {testbed.UNMAPPED_MODEL}
    stamps = {tuple(r[:3]): r[3] for r in first.select(*grid.KEYS, "timestamp").collect()}
    # second run: successful cells are reused untouched, failed ones rerun
    second = _run(spark, path)
    for r in second.select(*grid.KEYS, "timestamp", "error").collect():
        if r["error"] is None:
            assert stamps[tuple(r[:3])] == r["timestamp"]
    # a registry fix makes the failed cells succeed on the next run
    from textbench.operators.scoring import ExprModel
    fixed = testbed.rule_models() + [ExprModel(testbed.UNMAPPED_MODEL, "'Falsa'")]
    third = _run(spark, path, fixed)
    assert third.where("error IS NOT NULL").count() == 0


def test_corrupt_document_is_not_done(spark, scratch):
    path = os.path.join(scratch, "results")
    _run(spark, path)
    # an undecodable document for a cell of a third dataset
    cell = os.path.join(path, "model=rules%2Fparity-1.5B", "strategy=zero_shot", "dataset=extra")
    os.makedirs(cell)
    with open(os.path.join(cell, "part-00000.json"), "w") as fh:
        fh.write("{not json\n")
    df = results.read_results(spark, path, include_corrupt=True)
    bad = df.where(F.col("_corrupt_record").isNotNull()).select(*grid.KEYS, "timestamp").collect()
    assert [tuple(r[:3]) for r in bad] == [("rules/parity-1.5B", "zero_shot", "extra")]
    g = grid.experiment_grid(spark, testbed.MODEL_NAMES, testbed.STRATEGIES, ["quality", "toxic", "extra"])
    pending = {tuple(r) for r in grid.pending_cells(g, results.read_results(spark, path)).collect()}
    assert ("rules/parity-1.5B", "zero_shot", "extra") in pending
    assert ("rules/parity-1.5B", "zero_shot", "quality") not in pending


def test_report_and_markdown(spark, scratch):
    path = os.path.join(scratch, "results")
    res = _run(spark, path)
    rep = report.generate_report(res, os.path.join(scratch, "report"))
    assert rep.count() == res.count()
    md_dir = os.path.join(scratch, "report", "benchmark_report_md")
    text = "".join(open(os.path.join(md_dir, f)).read() for f in sorted(os.listdir(md_dir)) if f.startswith("part"))
    assert text.startswith(report.MD_TITLE)
    assert "### Chain Of Thought" in text and "- **Melhor Modelo:** " in text
    best = analysis.best_overall(rep).collect()
    assert len(best) == 1 and best[0]["error"] is None


def test_all_null_best_is_empty(spark):
    df = spark.createDataFrame([("m", "s", "d", None)], "model string, strategy string, dataset string, f1_score double")
    assert analysis.best_overall(df).count() == 0
    b = analysis.best_per_group(df, "model", "strategy").first()
    assert b["best_strategy"] is None


def test_predictions_table_gives_same_metrics(spark, scratch):
    c = testbed.corpus(spark, SF001)
    kw = dict(model_names=testbed.MODEL_NAMES, sample_size=100, timing="prompt_length")
    direct = grid.run_grid(spark, c, testbed.rule_models(), testbed.STRATEGIES, ["quality"], **kw)
    path = os.path.join(scratch, "predictions")
    via = grid.run_grid(spark, c, testbed.rule_models(), testbed.STRATEGIES, ["quality"], predictions_path=path, **kw)
    cols = ["model", "strategy", "dataset", "error", "n", "f1_score", "true_positives", "invalid_predictions"]
    assert sorted(map(tuple, direct.select(*cols).collect()), key=str) == \
        sorted(map(tuple, via.select(*cols).collect()), key=str)
    assert os.path.isdir(os.path.join(path, "model=rules%2Fparity-1.5B"))


def test_benchmark_job_end_to_end(spark, scratch):
    from textbench.operators import trained
    from textbench.plans import jobs
    c = testbed.corpus(spark, SF001)
    path = os.path.join(scratch, "results")
    nb = [trained.BaselineSpec("spark-ml/tfidf-naive-bayes", "naive_bayes", reg_params=[1.0])]
    rep = jobs.benchmark_job(spark, c, testbed.rule_models(), ["toxic"], path, os.path.join(scratch, "report"),
                             model_names=testbed.MODEL_NAMES, baselines=nb, sample_size=100, timing="prompt_length")
    rows = rep.collect()
    strategies = {r["strategy"] for r in rows}
    assert strategies == {"zero_shot", "few_shot", "chain_of_thought", "fine_tuned"}
    assert all(r["error"] is None for r in rows)
    assert len(rows) == 4 * 3 + 1  # registered rule models x strategies + one baseline


def test_empty_sample_and_row_failure_isolation(spark):
    from textbench.operators.scoring import ExprModel, PythonModel
    c = testbed.corpus(spark, SF001, ["quality"])  # no rows for "toxic"

    def flaky():
        def gen(prompts):
            if prompts.str.contains("Raciocínio:").any():  # chain-of-thought prompts fail
                raise RuntimeError("backend timeout")
            return prompts.map(lambda p: "Falsa")
        return gen
    models = [ExprModel("rules/always-1B", "'Falsa'"), PythonModel("rules/flaky-2B", flaky)]
    g = grid.run_grid(spark, c, models, testbed.STRATEGIES, ["quality", "toxic"], sample_size=100,
                      timing="prompt_length")
    cells = {(r["model"], r["strategy"], r["dataset"]): r for r in g.collect()}
    assert len(cells) == 2 * 3 * 2
    for (m, s, d), r in cells.items():
        if d == "toxic":
            assert r["error"] == grid.EMPTY_SAMPLE_ERROR and r["f1_score"] is None
        elif m == "rules/flaky-2B" and s == "chain_of_thought":
            assert r["error"].startswith("RuntimeError") and r["accuracy"] is None
        else:
            assert r["error"] is None and r["n"] == 61
