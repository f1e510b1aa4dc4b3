"""Corpus pipeline: five stages over ``documents``, each writing Parquet that
the next one reads.

1. ``line_quality`` (operator 1): rejected documents go, lines above their host's
   limit are removed from the rest.
2. ``near_duplicates`` (operator 3): one document of each group of five-word shingles
   at a similarity of 0.8 or more stays.
3. ``decontamination`` (operator 7): documents that hold a benchmark item go.
4. ``personal_data`` (operator 9): spans are masked in the text.
5. ``encoding`` (operator 4): ids of each text and their decoding, as digests.

Stages 1 to 4 return the columns of their input.  Rows with a null ``doc_id``
pass stages 1 to 4 as far as no decision names them, and are encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textbench.llm import byte_bpe, decontaminate, line_quality, minhash, pii
from textbench.llm.common import documents, written


def line_quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.keep_documents(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_personal_data(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs)


STAGES = [
    ("line_quality", line_quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("encoding", encoding_stage),
]

#: SQL cannot express MinHash groups or BPE ids; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
