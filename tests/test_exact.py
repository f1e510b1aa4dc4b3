"""Quantiles by refinement, ids of equal rows, named flat documents, fitted values."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textbench.functions.text import display_title
from textbench.operators import quantiles
from textbench.plans import analysis
from textbench.sources import datasets, results


def _frame(spark, groups, kind="double"):
    rows = [(g, float(v) if kind == "double" and v is not None else v) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, f"g string, x {kind}").repartition(5)


def _expected(vs):
    vs = np.array([v for v in vs if v is not None and v == v], float)
    q1, q2, q3 = np.quantile(vs, [.25, .5, .75])
    inside = vs[(vs >= q1 - 1.5 * (q3 - q1)) & (vs <= q3 + 1.5 * (q3 - q1))]
    return len(vs), q1, q2, q3, min(q1, inside.min()), max(q3, inside.max()), len(vs) - len(inside)


@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_quantiles_by_refinement(spark, kind):
    r = np.random.default_rng(1)
    groups = {
        "even": r.integers(0, 50, 700).tolist(), "one": [7], "same": [3] * 500, None: r.integers(-9, 9, 90).tolist(),
        "skewed": [int(x) for x in np.exp(r.normal(8, 4, 900))], "far": [0] * 300 + [10 ** 15] + [5] * 301,
        "hot": [1] * 600 + r.integers(0, 10 ** 9, 40).tolist(),
    }
    if kind == "double":
        groups |= {"real": r.normal(size=800).tolist(), "wide": (10.0 ** r.uniform(-300, 300, 400)).tolist(),
                   "odd": [float("nan"), None, 1.0, 2.0, -1e308, 1e308]}
    d = _frame(spark, groups, kind)
    for small, buckets in ((20, 16), (10_000, 1024)):
        out = {x["g"]: x for x in quantiles.box_statistics(d, "x", ["g"], small, buckets).collect()}
        assert out.keys() == groups.keys()
        for g, vs in groups.items():
            assert np.allclose(tuple(out[g])[1:], _expected(vs), rtol=1e-12, atol=0), g


def test_quantile_plans_hold_no_window_over_values(spark):
    d = _frame(spark, {"a": range(50)}, "bigint")
    for by in (["g"], []):
        out = quantiles.box_statistics(d, "x", by)
        assert "Window" not in out._jdf.queryExecution().toString() and out.first()["median"] == 24.5


def test_ids_of_equal_rows_in_parallel(spark):
    rows = [("hot", 1, {"k": 1})] * 5000 + [(f"t{i % 700}", i % 3, {"k": i % 2}) for i in range(2000)] + [(None, None, None)] * 3
    d = spark.createDataFrame(rows, "text string, label int, m map<string,int>")
    for frame in (d.drop("m"), d):
        whole = sorted(map(str, datasets.content_ids(frame.repartition(1)).collect()))
        assert len(whole) == len(rows) and datasets.content_ids(frame).select("doc_id").distinct().count() == len(rows)
        assert whole == sorted(map(str, datasets.content_ids(frame.repartition(8)).collect()))
        assert whole == sorted(map(str, datasets.content_ids(frame.repartition(8), copies_a_task=300).collect()))
    out = datasets.content_ids(d.drop("m"), copies_a_task=300)
    tasks = out.where("text = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 3
    assert "Window" not in out._jdf.queryExecution().toString()
    clash = spark.createDataFrame([("a", 1, 2), ("a", 1, 2)], "h1 string, n int, part int")
    assert datasets.content_ids(clash).select("h1", "n", "part").collect() == [("a", 1, 2)] * 2


def test_named_flat_documents(spark, scratch):
    rows = [("org/m-1.5B", "zero_shot", "d", 10, "2026-01-01T00:00:00", None, (0.5,)),
            ("org/m: x?é", "few_shot", "d%1", 10, "2026-01-01T00:00:00", "failed: \"x\"", None)]
    docs = spark.createDataFrame(rows, "model string, strategy string, dataset string, sample_size long, timestamp string, "
                                       "error string, metrics struct<f1_score: double>")
    path = os.path.join(scratch, "flat")
    names = results.write_flat_results(docs, path)
    assert names == sorted(n for n in os.listdir(path) if not n.startswith(".")) and "org_m-1.5B_zero_shot_d.json" in names
    with open(os.path.join(path, "org_m-1.5B_zero_shot_d.json")) as f:
        body = json.load(f)
    assert "error" not in body and body["metrics"]["f1_score"] == 0.5 and body["model"] == "org/m-1.5B"
    back = results.read_flat_results(spark, path).select("model", "strategy", "dataset", "error", "metrics.f1_score")
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((r[0], r[1], r[2], r[5], r[6] and r[6][0])) for r in rows)
    # written again: the old document is replaced, nothing else is left behind
    results.write_flat_results(docs.withColumn("sample_size", F.lit(11)), path)
    assert results.read_flat_results(spark, path).select("sample_size").distinct().collect() == [(11,)]
    assert [n for n in os.listdir(path) if n.endswith(".tmp")] == []
    with pytest.raises(ValueError, match="share the file name"):
        results.write_flat_results(docs.union(docs.withColumn("model", F.regexp_replace("model", "/", "_"))), path)


def test_inventory_of_results(spark, scratch):
    path = os.path.join(scratch, "results")
    rows = [("m", s, "d", 10, "2026-01-01T00:00:00", e) for s, e in (("a", None), ("b", "failed"), ("c", None))]
    results.write_results(spark.createDataFrame(rows, "model string, strategy string, dataset string, sample_size long, "
                                                      "timestamp string, error string"), path)
    folder = os.path.join(path, "model=m", "strategy=c", "dataset=d")
    for name in os.listdir(folder):
        if name.endswith(".json"):
            with open(os.path.join(folder, name), "w") as f:
                f.write("{broken\n")
        elif name.endswith(".crc"):
            os.rename(os.path.join(folder, name), os.path.join(scratch, name))
    assert tuple(results.result_inventory(spark, path).first()) == (3, 2, 1, 1, 1)


def test_fitted_values_lie_on_the_trend(spark):
    rows = [(f"m-{p}B", s, "d", a, b, None) for p, s, a, b in
            ((1, "x", .5, 1.0), (2, "x", .6, 3.0), (7, "y", None, 2.0), (7, "x", .9, 9.5))] + [("m", "x", "d", .1, .1, None)]
    report = spark.createDataFrame(rows, "model string, strategy string, dataset string, f1_score double, accuracy double, error string")
    got = analysis.fitted_values(report, ["f1_score", "accuracy"]).collect()
    assert len(got) == 8
    for metric, column in (("f1_score", 3), ("accuracy", 4)):
        points = [(float(r[0][2:-1]), r[column]) for r in rows[:4] if r[column] is not None]
        slope, intercept = np.polyfit(*zip(*points), 1)
        for r in got:
            if r["metric"] == metric:
                assert r["fitted"] == pytest.approx(slope * r["num_parameters"] + intercept)


def test_titles_are_those_of_python(spark):
    r = random.Random(3)
    texts = ["zero_shot", "gpt-4o mini", "they're bill's", "1st_run2go", "ÉCOLE été", "", "a", "__x__", "UPPER lower"]
    texts += ["".join(r.choice("abZé19-_' .") for _ in range(r.randint(0, 12))) for _ in range(200)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in d.select("t", display_title("t").alias("x")).collect():
        assert row["x"] == row["t"].replace("_", " ").title()
