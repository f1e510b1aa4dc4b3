"""Results and scored rows are used again under the same question only; options of
each call; calls in flight."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from textbench import testbed
from textbench.operators import fingerprint, scoring
from textbench.plans import grid
from textbench.sources import results


def _counting(folder, name, rule="Verdadeira", options=None, version=0):
    def factory():
        def generate(prompts):
            for _ in range(len(prompts)):
                open(os.path.join(folder, f"{name}-{os.urandom(6).hex()}"), "w").close()
            return prompts.map(lambda _: rule)
        return generate
    return scoring.PythonModel(name, factory, options=options or {})


def _calls(folder):
    return len(os.listdir(folder))


def _corpus(spark, shift=""):
    rows = [("d", i, f"text {i} {shift}", i % 2) for i in range(60)]
    return spark.createDataFrame(rows, "dataset string, doc_id long, text string, label int")


def _run(spark, path, models, corpus, **kw):
    return grid.run_benchmark(spark, corpus, models, ["zero_shot", "few_shot"], ["d"], path, sample_size=10, **kw)


def test_other_texts_rules_and_options_are_asked_anew(spark, scratch):
    calls, path = os.path.join(scratch, "calls"), os.path.join(scratch, "results")
    os.makedirs(calls)
    first = _run(spark, path, [_counting(calls, "m")], _corpus(spark)).collect()
    n = _calls(calls)
    assert n == 20 and all(r["metrics"]["true_negatives"] == 5 and r["fingerprint"] for r in first)
    # nothing has changed: neither with documents nor with scored rows only
    _run(spark, path, [_counting(calls, "m")], _corpus(spark)).collect()
    os.rename(path, path + "-away")
    _run(spark, path, [_counting(calls, "m")], _corpus(spark)).collect()
    assert _calls(calls) == n
    # every text, the rule and the temperature have changed, the documents are gone
    os.rename(path, path + "-away-again")
    other = _counting(calls, "m", "Falsa", {"temperature": 0.9})
    new = _run(spark, path, [other], _corpus(spark, "new")).collect()
    assert _calls(calls) == 2 * n
    assert all(r["metrics"]["true_positives"] == 5 and r["metrics"]["true_negatives"] == 0 for r in new)
    assert all(r["generation"]["temperature"] == 0.9 for r in new)


@pytest.mark.parametrize("change", ["text", "label", "rule", "options", "row options"])
def test_a_document_of_another_question_is_run_again(spark, scratch, change):
    path = os.path.join(scratch, "results")
    model = scoring.ExprModel("m", "'Verdadeira'")
    before = {r["strategy"]: r for r in _run(spark, path, [model], _corpus(spark)).collect()}
    corpus, kw = _corpus(spark), {}
    if change == "text":
        corpus = corpus.withColumn("text", F.when(F.col("doc_id") < 60, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    elif change == "label":
        corpus = corpus.withColumn("label", 1 - F.col("label"))
    elif change == "rule":
        model = scoring.ExprModel("m", "'Falsa'")
    elif change == "options":
        model = scoring.ExprModel("m", "'Verdadeira'", options={"top_p": 0.5})
    else:
        kw["row_options"] = F.struct(F.lit(7).alias("max_new_tokens"))
    after = {r["strategy"]: r for r in _run(spark, path, [model], corpus, **kw).collect()}
    for s in before:
        assert after[s]["fingerprint"] != before[s]["fingerprint"] and after[s]["timestamp"] > before[s]["timestamp"]


def test_examples_count_for_few_shot_cells_only(spark, scratch):
    path = os.path.join(scratch, "results")
    model = scoring.ExprModel("m", "'Verdadeira'")
    before = {r["strategy"]: r["fingerprint"] for r in _run(spark, path, [model], _corpus(spark)).collect()}
    after = {r["strategy"]: r["fingerprint"] for r in _run(spark, path, [model], _corpus(spark), n_examples=2).collect()}
    assert before["zero_shot"] == after["zero_shot"] and before["few_shot"] != after["few_shot"]


def test_a_document_without_fingerprint_is_kept(spark, scratch):
    path = os.path.join(scratch, "results")
    docs = _run(spark, path, [scoring.ExprModel("m", "'Verdadeira'")], _corpus(spark)).drop("fingerprint").collect()
    other = os.path.join(scratch, "older")
    results.write_results(results.read_results(spark, path).drop("fingerprint"), other)
    again = _run(spark, other, [scoring.ExprModel("m", "'Falsa'")], _corpus(spark)).drop("fingerprint").collect()
    assert sorted(map(str, again)) == sorted(map(str, docs))


def test_digests_of_rows_and_functions(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "")], "i int, t string")
    one = lambda df: df.agg(fingerprint.rows_digest(["i", "t"]).alias("x")).first()["x"]
    assert one(d) == one(d.repartition(4)) == one(d.orderBy(F.desc("i")))
    assert one(d) != one(d.distinct()) and one(d) != one(d.fillna("")) and one(d) != one(d.limit(0))

    def make(k):
        def inner(x):
            return x + k
        return inner
    assert fingerprint.settings_digest(make(1)) == fingerprint.settings_digest(make(1))
    assert fingerprint.settings_digest(make(1)) != fingerprint.settings_digest(make(2))
    assert fingerprint.settings_digest(lambda x: x + 1) != fingerprint.settings_digest(lambda x: x + 2)
    assert fingerprint.settings_digest({"a": 1, "b": [2]}) == fingerprint.settings_digest({"b": [2], "a": 1})


# --------------------------------------------------------------------------- options of each call

def _rows(spark):
    rows = [(i, "m" if i % 2 else "e", f"p{i}", 5 if i % 3 == 0 else None) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, model string, prompt string, k int")
    return d.withColumn("options", F.struct(F.col("k").alias("max_new_tokens"), F.lit(None).cast("double").alias("top_p")))


@pytest.mark.parametrize("takes_options", [True, False])
def test_options_of_each_row_reach_the_call(spark, takes_options):
    def with_options():
        return lambda prompts, options: prompts.map(lambda p: f"{p}:{options['max_new_tokens']}:{options['temperature']}")

    def made_with(options):
        return lambda prompts: prompts.map(lambda p: f"{p}:{options['max_new_tokens']}:{options['temperature']}")
    model = scoring.PythonModel("m", with_options if takes_options else made_with, options={"temperature": 0.7})
    expr = scoring.ExprModel("e", "concat(prompt, ':', options.max_new_tokens, ':', options.temperature)")
    out = scoring.score(_rows(spark), [model, expr], options_col="options").collect()
    assert len(out) == 30
    for r in out:
        tokens, heat = 5 if r["doc_id"] % 3 == 0 else 256, 0.7 if r["model"] == "m" else 0.1
        assert r["response"] == f"p{r['doc_id']}:{tokens}:{heat}" and r["error"] is None
        assert r["options"].asDict() == {"max_new_tokens": tokens, "temperature": heat, "top_p": 0.9,
                                         "do_sample": True, "repetition_penalty": 1.1}


def test_grid_records_options_of_each_row(spark, scratch):
    path = os.path.join(scratch, "scored")
    tokens = F.when(F.col("strategy") == "zero_shot", 4).otherwise(512)
    grid.run_grid(spark, _corpus(spark), [scoring.ExprModel("m", "'Falsa'")], ["zero_shot", "few_shot"], ["d"],
                  sample_size=10, predictions_path=path, row_options=F.struct(tokens.alias("max_new_tokens"))).collect()
    got = spark.read.parquet(path).select("strategy", "options.max_new_tokens", "options.top_p").distinct().collect()
    assert sorted(map(tuple, got)) == [("few_shot", 512, 0.9), ("zero_shot", 4, 0.9)]


# --------------------------------------------------------------------------- calls in flight

def test_calls_in_flight_keep_order_and_own_times(spark):
    def factory():
        def generate(prompts):
            time.sleep(0.4 if prompts.iloc[0].endswith("0") else 0.05)
            return prompts.map(str.upper)
        return generate
    d = spark.createDataFrame([(i, "m", f"row {i}") for i in range(40)], "doc_id long, model string, prompt string")
    start = time.time()
    out = scoring.score(d, [scoring.PythonModel("m", factory, concurrency=8)], partitions=1).collect()
    took = time.time() - start
    assert [r["response"] for r in sorted(out)] == [f"ROW {i}" for i in range(40)]
    slow = [r["inference_time"] for r in out if r["doc_id"] % 10 == 0]
    fast = [r["inference_time"] for r in out if r["doc_id"] % 10]
    assert min(slow) >= 0.4 and min(fast) >= 0.05 and sorted(fast)[len(fast) // 2] < 0.3
    assert took < sum(slow) + sum(fast) + 20  # the session may be starting workers


def test_window_is_bounded_and_rows_fail_alone(spark, scratch):
    def factory():
        import threading
        flying, lock = [0, 0], threading.Lock()

        def generate(prompts):
            with lock:
                flying[0] += 1
                flying[1] = max(flying)
            time.sleep(0.02)
            with lock:
                flying[0] -= 1
            if prompts.iloc[0] == "p7":
                raise RuntimeError("refused")
            return prompts.map(lambda p: str(flying[1]))
        return generate
    d = spark.createDataFrame([(i, "m", f"p{i}") for i in range(30)], "doc_id long, model string, prompt string")
    out = {r["doc_id"]: r for r in scoring.score(d, [scoring.PythonModel("m", factory, concurrency=3, backoff=0.01)],
                                                 partitions=1).collect()}
    assert out[7]["error"] == "RuntimeError: refused" and out[7]["response"] is None
    assert {int(r["response"]) for i, r in out.items() if i != 7} <= {1, 2, 3}
    assert all(r["error"] is None for i, r in out.items() if i != 7)


def test_failed_calls_are_tried_again_with_growing_pauses(spark):
    def factory():
        tries = {}

        def generate(prompts):
            p = prompts.iloc[0]
            tries.setdefault(p, []).append(time.time())
            if len(prompts) > 1 or len(tries[p]) < (3 if p == "late" else 9 if p == "never" else 1):
                raise RuntimeError(f"try {len(tries[p])}")
            pauses = [b - a for a, b in zip(tries[p], tries[p][1:])]
            return prompts.map(lambda _: f"{len(tries[p])} {all(y > x for x, y in zip(pauses, pauses[1:]))}")
        return generate
    d = spark.createDataFrame([(0, "m", "now"), (1, "m", "late"), (2, "m", "never")], "doc_id long, model string, prompt string")
    model = scoring.PythonModel("m", factory, concurrency=2, retries=2, backoff=0.1)
    out = {r["doc_id"]: r for r in scoring.score(d, [model], partitions=1).collect()}
    assert out[0]["response"] == "1 True" and out[1]["response"] == "3 True"
    assert out[1]["inference_time"] < 0.1  # the try that answered, without pauses
    assert out[2]["error"] == "RuntimeError: try 3"
