"""Incremental metrics over a growing table of scored rows.

A long benchmark writes scored rows batch by batch (for example one folder
per experiment, as ``run_grid(predictions_path=...)`` does).  This module
reads that folder as a stream and keeps the per-experiment counters as a
streaming aggregate, so the running metrics of every experiment are
refreshed as rows arrive, without rescanning finished batches.  The
counters are additive, which is what makes the aggregate incremental;
state is one row of longs per experiment.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import METRIC_NAMES, counter_aggs, metric_columns, timing_aggs
from ..session import checkpoint_dir

KEYS = ["model", "strategy", "dataset"]

SCORED_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("prediction", T.IntegerType()),
    T.StructField("inference_time", T.DoubleType()),
    T.StructField("error", T.StringType()),
])


def scored_stream(spark: SparkSession, path: str, schema: T.StructType = SCORED_SCHEMA,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def streaming_cell_metrics(scored: DataFrame) -> DataFrame:
    """Running metrics per experiment (complete-mode aggregate)."""
    agg = scored.groupBy(*KEYS).agg(*counter_aggs(), *timing_aggs(), F.max("error").alias("error"))
    ok = F.col("error").isNull()
    mcols = [F.when(ok, c).alias(n) for c, n in zip(metric_columns(), METRIC_NAMES)]
    return agg.select(*KEYS, "error", "n", *mcols, "avg_inference_time", "total_inference_time")


def start_metrics_stream(spark: SparkSession, scored_path: str, sink, name: str = "cell_metrics",
                         trigger_seconds: int | None = None):
    """Start the stream; ``sink(batch_df, epoch_id)`` receives the full
    current table of experiment metrics each micro-batch, for display or a
    progress table.  These are running figures: result documents, which mark a
    cell as done, are written by the benchmark alone.  The checkpoint lives under the session's shared checkpoint folder."""
    ckpt = os.path.join(checkpoint_dir(spark), f"stream-{name}")
    q = (streaming_cell_metrics(scored_stream(spark, scored_path))
         .writeStream.outputMode("complete").option("checkpointLocation", ckpt)
         .foreachBatch(sink).queryName(name))
    if trigger_seconds:
        q = q.trigger(processingTime=f"{trigger_seconds} seconds")
    return q.start()
