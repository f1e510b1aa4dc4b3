"""Nothing lost, nothing silently wrong: isolation, resume, ids, labels, documents."""

import hashlib
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from textbench import testbed
from textbench.functions import prompts
from textbench.operators import profile, sampling, scoring
from textbench.plans import grid, jobs, report
from textbench.sources import datasets, results


def _rows(spark, names, n=4):
    return spark.createDataFrame([(m, f"p{i}") for m in names for i in range(n)], "model string, prompt string")


def test_back_end_that_cannot_be_opened_fails_its_own_rows(spark):
    def broken():
        raise OSError("no such device")

    def good():
        return lambda prompts: prompts.map(lambda p: "Falsa")
    models = [scoring.PythonModel("bad", broken), scoring.PythonModel("good", good),
              scoring.PythonModel("saved", broken, fallback_factory=good)]
    got = scoring.score(_rows(spark, ["bad", "good", "saved"]), models).collect()
    assert {r["error"] for r in got if r["model"] == "bad"} == {"OSError: no such device"}
    assert all(r["error"] is None and r["response"] == "Falsa" for r in got if r["model"] != "bad")


def test_short_answer_batch_is_an_error(spark):
    def short():
        return lambda prompts: pd.Series([] if len(prompts) == 1 else ["Falsa"])
    got = scoring.score(_rows(spark, ["m"]), [scoring.PythonModel("m", short)], partitions=1).collect()
    assert all(r["response"] is None and "0 answers for 1 prompts" in r["error"] for r in got)


def test_null_prompt_and_times(spark):
    df = spark.createDataFrame([("e", None), ("e", "x"), ("p", None), ("p", "x"), (None, "x")],
                               "model string, prompt string")
    models = [scoring.ExprModel("e", "'Falsa'"), scoring.PythonModel("p", lambda: lambda s: s, per_row=True)]
    got = {(r["model"], r["prompt"]): r for r in scoring.score(df, models).collect()}
    assert got["e", None]["error"] == got["p", None]["error"] == scoring.NO_PROMPT_ERROR
    assert got["e", "x"]["inference_time"] is None  # not measured
    assert got["p", "x"]["inference_time"] >= 0
    assert "not in the back-end registry" in got[None, "x"]["error"]


def test_unknown_strategy_is_refused(spark):
    with pytest.raises(ValueError, match="zero_shott"):
        grid.run_grid(spark, testbed.corpus_keys(spark, SF001), testbed.rule_models(), ["zero_shott"], ["quality"])
    with pytest.raises(ValueError):
        prompts.build_prompt("text", "nope")
    bad = spark.createDataFrame([("t", None)], "text string, label int")
    with pytest.raises(Exception, match="label of 0 or 1"):
        bad.select(prompts.example_line("text", "label")).collect()


def test_interrupted_benchmark_keeps_finished_waves(spark, scratch):
    calls = os.path.join(scratch, "calls")
    os.makedirs(calls)

    def model(name, fail=False):
        def factory():
            def generate(p):
                for _ in range(len(p)):
                    open(os.path.join(calls, f"{name}-{os.urandom(6).hex()}"), "w").close()
                return p.map(lambda _: "Falsa")
            return generate
        return scoring.PythonModel(name, factory)
    count = lambda name: sum(f.startswith(name) for f in os.listdir(calls))
    c, t = testbed.corpus_keys(spark, SF001), testbed.texts(spark, SF001)
    args = (["zero_shot"], ["toxic"], os.path.join(scratch, "results"))
    kw = dict(sample_size=20, texts=t)
    whole, stop = grid.write_predictions, []

    def second_wave_fails(predictions, path):
        if stop:
            raise KeyboardInterrupt
        stop.append(1)
        whole(predictions, path)
    grid.write_predictions = second_wave_fails
    try:
        with pytest.raises(KeyboardInterrupt):
            grid.run_benchmark(spark, c, [model("one"), model("two")], *args, **kw)
    finally:
        grid.write_predictions = whole
    first = count("one")
    assert first > 0 and count("two") == 0
    out = grid.run_benchmark(spark, c, [model("one"), model("two")], *args, **kw).collect()
    assert count("one") == first and count("two") == first
    assert len(out) == 2 and all(r["error"] is None for r in out)
    assert out[0]["generation"]["max_new_tokens"] == 256
    # documents lost, scored rows there: no model is called again
    grid.run_benchmark(spark, c, [model("one"), model("two")], ["zero_shot"], ["toxic"],
                       os.path.join(scratch, "other"), predictions_path=_only(os.path.join(scratch, "results_predictions")),
                       **kw)
    assert count("one") == first and count("two") == first


def _only(folder):
    (name,) = os.listdir(folder)
    return os.path.join(folder, name)


def test_job_runs_given_models(spark, scratch):
    docs, labels = testbed.table(spark, SF001, "documents"), testbed.table(spark, SF001, "labels")
    assert [m.name for m in jobs.load_models("textbench.testbed:rule_models")] == list(testbed.RULE_SQL)
    out = jobs.run_job(spark, docs, labels, {"toxic": testbed.TABLE_DATASETS["toxic"]},
                       [scoring.ExprModel("rules/always-1B", "'Falsa'")], os.path.join(scratch, "r"),
                       strategies=["zero_shot"], sample_size=20)
    assert [r["model"] for r in out.collect()] == ["rules/always-1B"]


def test_ids_of_landed_rows_do_not_depend_on_the_read(spark, scratch):
    rows = spark.createDataFrame([(f"text {i // 2}", i % 3 % 2) for i in range(200)], "text string, label int")
    rows.repartition(8).write.json(f"{scratch}/d.json")
    reg = {"d": {"text_column": "text", "label_column": "label", "label_mapping": {"0": 0, "1": 1}}}
    read = lambda: datasets.read_dataset(spark, "d", scratch, reg, schema="text string, label int",
                                         multi_line_json=False)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    draws = []
    try:
        for size in ("1k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            c = read()
            assert c.select("doc_id").distinct().count() == 200
            draws.append(sorted((r["doc_id"], r["text"]) for r in sampling.balanced_sample(c, 20, 42).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert draws[0] == draws[1] and len(draws[0]) == 20


def test_unmapped_labels_are_counted(spark):
    raw = spark.createDataFrame([("d", "fake"), ("d", "odd"), ("d", "odd"), ("d", None)], "dataset string, label string")
    c = datasets.apply_label_mapping(raw, {"fake": 1, "true": 0})
    got = {(r["label_raw"], r["n"]) for r in datasets.unmapped_labels(c).collect()}
    assert got == {("odd", 2), (None, 1)}


def test_result_keys_stay_text_and_flat_documents_are_read(spark, scratch):
    flat = spark.createDataFrame([("m", "s", "007", None, 5)], "model string, strategy string, dataset string, "
                                                               "error string, sample_size long")
    path = os.path.join(scratch, "results")
    results.write_results(flat.withColumn("timestamp", F.lit("2026-01-01")), path)
    back = results.read_results(spark, path)
    assert [r["dataset"] for r in back.collect()] == ["007"]
    g = grid.experiment_grid(spark, ["m"], ["s"], ["007"])
    assert grid.pending_cells(g, back).count() == 0
    folder = os.path.join(scratch, "flat")
    os.makedirs(folder)
    doc = {"model": "a/b-7B", "strategy": "zero_shot", "dataset": "007", "timestamp": "2026-01-01T00:00:00",
           "error": None, "metrics": {"f1_score": 0.5, "confusion_matrix": [[1, 2], [3, 4]]}}
    with open(os.path.join(folder, "one.json"), "w") as fh:
        json.dump(doc, fh, indent=2)
    with open(os.path.join(folder, "two.json"), "w") as fh:
        fh.write("{broken")
    (r,) = results.read_flat_results(spark, folder).collect()
    assert (r["model"], r["dataset"], r["metrics"]["f1_score"]) == ("a/b-7B", "007", 0.5)
    both = results.read_flat_results(spark, folder, include_corrupt=True).cache()
    assert results.corrupt_documents(both).count() == 1


def test_whiskers_end_at_the_box(spark):
    df = spark.createDataFrame([("g", v) for v in (0, 0, 0, 100)], "g string, v int")
    for r in (profile.integer_box_stats(df, "v", ["g"]).first(), profile.box_stats(df, "v", ["g"]).first()):
        assert (r["q3"], r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (25.0, 0.0, 25.0, 1)


def test_error_text_cannot_break_the_report_table(spark):
    df = spark.createDataFrame([("m", "s", "d", None, "a|b\nc")],
                               "model string, strategy string, dataset string, f1_score double, error string")
    for c in report.TABLE_COLS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    lines = [r["line"] for r in report.markdown_lines(df).where("section = 2").collect()]
    assert len(lines) == 1 and "a\\|b c" in lines[0] and "\n" not in lines[0]


def test_fixed_prompt_texts():
    """The md5 values in FIXTURES.md: a changed byte in a fixed text is seen here."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with open(os.path.join(here, "FIXTURES.md"), encoding="utf-8") as fh:
        stated = dict(line.strip("| \n").split(" | ") for line in fh if line.startswith("| prompt:"))
    texts = {"prompt:system": prompts.SYSTEM_PROMPT, "prompt:few_shot_example": prompts.FEW_SHOT_EXAMPLE_TEMPLATE}
    texts |= {f"prompt:{k}": v for k, v in prompts.TEMPLATES.items()}
    assert stated == {k: hashlib.md5(v.encode()).hexdigest() for k, v in texts.items()}
