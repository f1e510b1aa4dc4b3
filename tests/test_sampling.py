"""Properties of samples and splits on the driver's tables."""

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001, SF01
from textbench import testbed
from textbench.operators import sampling


def test_balanced_sample_sizes(spark):
    c = testbed.corpus(spark, SF01)
    s = sampling.balanced_sample(c, 101, 42)
    counts = {(r["dataset"], r["label"]): r["count"] for r in s.groupBy("dataset", "label").count().collect()}
    sizes = {(r["dataset"], r["label"]): r["count"] for r in c.groupBy("dataset", "label").count().collect()}
    for k, n in counts.items():
        assert n == min(50, sizes[k])
    assert s.select("dataset", "doc_id").distinct().count() == s.count()


def test_small_class_takes_all(spark):
    c = testbed.corpus(spark, SF001, ["quality"])
    s = sampling.balanced_sample(c, 100, 42)
    assert s.where("label = 1").count() == 11


def test_sample_same_for_partitioning(spark):
    c = testbed.corpus(spark, SF01)
    a = {tuple(r) for r in sampling.balanced_sample(c, 100, 42).select("dataset", "doc_id").collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        b = {tuple(r) for r in sampling.balanced_sample(c.repartition(13), 100, 42)
             .select("dataset", "doc_id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_sample_matches_brute_force(spark):
    c = testbed.corpus(spark, SF01, ["toxic"])
    keyed = sampling.with_key(c.where("label IN (0, 1)"), 42).toPandas()
    keyed = keyed.sort_values(["sample_key", "doc_id"])
    want = set(keyed.groupby("label").head(7)["doc_id"])
    got = {r[0] for r in sampling.balanced_sample(c, 14, 42).select("doc_id").collect()}
    assert got == want


def test_stratified_split_quotas(spark):
    c = testbed.corpus(spark, SF01, ["quality"])
    a = sampling.stratified_assignment(c, 0.2, 42)
    rows = a.groupBy("split", "label").count().collect()
    test = {r["label"]: r["count"] for r in rows if r["split"] == "test"}
    assert test == {1: 12, 0: 68}
    assert sum(test.values()) == math.ceil(0.2 * 399)
    assert a.count() == 399 and a.select("doc_id").distinct().count() == 399


def test_holdout_and_validation(spark):
    c = testbed.corpus(spark, SF01)
    a = sampling.holdout_assignment(spark, c, 100, 0.2, 42)
    t = a.where("split = 'test'")
    assert t.count() == 200 and a.count() == 798
    x1 = {tuple(r) for r in sampling.balanced_sample(c, 100, 42).select("dataset", "doc_id").collect()}
    assert {tuple(r) for r in t.select("dataset", "doc_id").collect()} == x1
    small = testbed.corpus(spark, SF001)  # 87 rows < 100: stratified 20 %
    b = sampling.holdout_assignment(spark, small, 100, 0.2, 42)
    assert b.where("split = 'test'").groupBy("dataset").count().where(F.col("count") != 18).count() == 0


def test_few_shot_examples_exclude_test(spark):
    c = testbed.corpus(spark, SF01)
    test = sampling.balanced_sample(c, 100, 42)
    ex = sampling.few_shot_examples(c, test, 3, 42)
    assert ex.groupBy("dataset").count().where("count != 3").count() == 0
    assert ex.join(test, ["dataset", "doc_id"], "left_semi").count() == 0
    bal = sampling.balanced_few_shot_examples(c, test, 3, 42)
    assert bal.groupBy("dataset", "label").count().where("count != 1").count() == 0


def test_one_pass_draw_equals_two_pass(spark):
    for sf in (SF001, SF01):
        c = testbed.corpus(spark, sf)
        t1 = sampling.balanced_sample(c, 100, 42)
        e1 = sampling.few_shot_examples(c, t1, 3, 42)
        drawn = sampling.sample_with_examples(c, 100, 3, 42)
        t2, e2 = drawn.where("_test"), drawn.where("NOT _test")
        key = ["dataset", "doc_id"]
        assert {tuple(r) for r in t1.select(*key).collect()} == {tuple(r) for r in t2.select(*key).collect()}
        assert ({tuple(r) for r in e1.select(*key, "example_rank").collect()}
                == {tuple(r) for r in e2.select(*key, "example_rank").collect()})
        e3 = sampling.few_shot_examples(c, 100, 3, 42)
        assert ({tuple(r) for r in e1.select(*key, "example_rank").collect()}
                == {tuple(r) for r in e3.select(*key, "example_rank").collect()})


def _labels(spark):
    rows = [("d", i, f"t{i}", [0, 1, None][i % 3]) for i in range(60)]
    return spark.createDataFrame(rows, "dataset string, doc_id long, text string, label int")


def test_unlabelled_rows_are_never_drawn(spark):
    c = _labels(spark)
    drawn = sampling.sample_with_examples(c, 10, 3, 42).collect()
    assert len(drawn) == 13 and all(r["label"] in (0, 1) for r in drawn)
    assert all(r["label"] in (0, 1) for r in sampling.simple_sample(c, 50, 42).collect())
    assert all(r["label"] in (0, 1) for r in sampling.few_shot_examples(c, 10, 3, 42).collect())


def test_too_small_class_is_an_error(spark):
    c = _labels(spark).where("label = 1 OR label IS NULL")
    with pytest.raises(ValueError, match="class 0 has 0"):
        sampling.balanced_few_shot_examples(c, None, 3, 42)


def test_cutoffs_against_brute_force(spark):
    c = sampling.with_key(_labels(spark), 7)
    rows = sorted((r["sample_key"], r["doc_id"]) for r in c.collect())
    for n in (0, 1, 17, 60, 1000):
        got = sampling.first_n_by_key(c, ["dataset"], n)
        assert sorted((r["sample_key"], r["doc_id"]) for r in got.collect()) == rows[:n]
    tied = c.withColumn("sample_key", F.lit("0" * 32))
    assert sorted(r["doc_id"] for r in sampling.first_n_by_key(tied, ["dataset"], 5).collect()) == [0, 1, 2, 3, 4]
