"""File sources: CSV with quoted newlines, JSON arrays, format fallback, label maps."""

import json
import os

import pytest

from textbench.sources import datasets

REG = {"news": {"text_column": "Noticia", "label_column": "Label", "label_mapping": {"fake": 1, "real": 0}}}


def test_csv_quoted_newline_and_mapping(spark, scratch):
    with open(os.path.join(scratch, "news.csv"), "w") as fh:
        fh.write('Noticia,Label\n"linha um\nlinha dois",fake\n"outra",real\n"sem rótulo",talvez\n')
    df = datasets.read_dataset(spark, "news", scratch, REG)
    rows = sorted((r["text"], r["label"]) for r in df.collect())
    assert rows == [("linha um\nlinha dois", 1), ("outra", 0), ("sem rótulo", None)]
    assert set(df.columns) >= {"text", "label", "dataset", "doc_id", "label_raw"}


def test_json_array_and_format_order(spark, scratch):
    with open(os.path.join(scratch, "news.json"), "w") as fh:
        json.dump([{"Noticia": "a", "Label": "fake"}, {"Noticia": "b", "Label": "real"}], fh)
    spark.createDataFrame([("p", "fake")], "Noticia string, Label string").write.parquet(
        os.path.join(scratch, "news.parquet"))
    df = datasets.read_dataset(spark, "news", scratch, REG)  # json wins over parquet
    assert sorted(r["text"] for r in df.collect()) == ["a", "b"]


def test_missing_dataset_errors(spark, scratch):
    with pytest.raises(FileNotFoundError):
        datasets.load_local_dataset(spark, "absent", scratch)
    with pytest.raises(ValueError):
        datasets.read_dataset(spark, "unknown", scratch, REG)


def test_numeric_labels_pass_through(spark):
    df = spark.createDataFrame([("x", 0), ("y", 1), ("z", 7)], "text string, label int")
    out = datasets.apply_label_mapping(df, {"fake": 1, "true": 0})
    assert [r["label"] for r in out.orderBy("text").collect()] == [0, 1, None]
