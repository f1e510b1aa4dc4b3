"""Corpora and models defined over the driver's test tables.

Datasets: text from ``documents``, labels from ``labels`` joined on
``doc_id``.  ``quality`` labels a low-quality document as class 1 (map
1 -> 0, 0 -> 1); ``toxic`` uses the flag as is.

Models: deterministic rule responders.  Their answer is a SQL expression
over ``prompt`` written in the subset shared by Spark SQL and DuckDB, so the
same text drives the Spark job and the SQL oracle.  Names carry a
parameter size so the analysis has something to read.  One of them runs in
Python through ``mapInPandas`` to exercise the real model boundary, and one
has no back-end entry (its cells fail, as a missing registry entry does).
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .operators.scoring import ExprModel, PythonModel
from .sources.datasets import corpora_from_tables, corpus_keys_from_tables

TABLE_DATASETS = {
    "quality": {"text_column": "text", "label_column": "quality", "label_mapping": {"1": 0, "0": 1}},
    "toxic": {"text_column": "text", "label_column": "toxic", "label_mapping": {"0": 0, "1": 1}},
}

STRATEGIES = ["zero_shot", "few_shot", "chain_of_thought"]

# rule model -> answer expression (Spark SQL and DuckDB)
RULE_SQL = {
    "rules/parity-1.5B": "CASE WHEN length(prompt) % 2 = 0 THEN 'Falsa' ELSE 'Verdadeira' END",
    "rules/hash-4b": "CASE WHEN substr(md5(prompt), 1, 1) < '8' THEN 'Classificação: Falsa' ELSE 'Verdadeira.' END",
    "rules/steps-7B": ("CASE WHEN length(prompt) % 5 = 0 THEN 'não sei' "
                       "WHEN length(prompt) % 3 = 0 THEN 'Passo 1: fonte. Classificação: Verdadeira' "
                       "ELSE 'A notícia parece VERÍDICA' END"),
    "rules/never-8B": "'Não sei responder'",
}
UNMAPPED_MODEL = "rules/unmapped-9B"
PYTHON_MODELS = {"rules/hash-4b"}

MODEL_NAMES = list(RULE_SQL) + [UNMAPPED_MODEL]


def _hash_model_factory():
    def generate(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: "Classificação: Falsa"
                           if hashlib.md5(p.encode("utf-8")).hexdigest()[0] < "8" else "Verdadeira.")
    return generate


def rule_models() -> list:
    """The registered models; the unmapped one is deliberately absent."""
    out = []
    for name, sql in RULE_SQL.items():
        if name in PYTHON_MODELS:
            out.append(PythonModel(name, _hash_model_factory))
        else:
            out.append(ExprModel(name, sql))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """``dataset, doc_id, text, label`` for the table datasets."""
    docs, labs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    names = names or list(TABLE_DATASETS)
    return corpora_from_tables(docs, labs, {n: TABLE_DATASETS[n] for n in names})


def corpus_keys(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """``dataset, doc_id, label`` (no text) for the table datasets."""
    docs, labs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    names = names or list(TABLE_DATASETS)
    return corpus_keys_from_tables(docs, labs, {n: TABLE_DATASETS[n] for n in names})


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")
