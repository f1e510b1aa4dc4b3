"""Result documents and report sinks.

Results are JSON documents partitioned by ``model/strategy/dataset``: one
folder per experiment, rewritten in place by dynamic partition overwrite,
so a rerun replaces exactly the cells it recomputed.  Documents kept flat, one
indented JSON file per experiment with the keys in the body, are read as well
(:func:`read_flat_results`) and written (:func:`write_flat_results`).  Reading is tolerant: an undecodable document is
kept as ``_corrupt_record`` and treated as "not done" (its cell is rerun),
never as a failure of the whole read; :func:`corrupt_documents` lists them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["model", "strategy", "dataset"]

METRICS_TYPE = T.StructType([
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("precision_macro", T.DoubleType()),
    T.StructField("recall_macro", T.DoubleType()),
    T.StructField("f1_macro", T.DoubleType()),
    T.StructField("invalid_predictions", T.LongType()),
    T.StructField("invalid_rate", T.DoubleType()),
    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("true_negatives", T.LongType()),
    T.StructField("false_positives", T.LongType()),
    T.StructField("false_negatives", T.LongType()),
    T.StructField("true_positives", T.LongType()),
    T.StructField("avg_inference_time", T.DoubleType()),
    T.StructField("total_inference_time", T.DoubleType()),
    T.StructField("vram_usage_gb", T.DoubleType()),
    T.StructField("training_time", T.DoubleType()),
])

#: What a baseline run used: settings, and what the optimiser did.
TRAINING_CONFIG_TYPE = T.StructType([
    T.StructField("classifier", T.StringType()),
    T.StructField("num_features", T.IntegerType()),
    T.StructField("reg_param", T.DoubleType()),
    T.StructField("max_iterations", T.IntegerType()),
    T.StructField("iterations", T.IntegerType()),
    T.StructField("converged", T.BooleanType()),
    T.StructField("validation_f1", T.DoubleType()),
    T.StructField("seed", T.IntegerType()),
    T.StructField("test_size", T.DoubleType()),
    T.StructField("metric", T.StringType()),
    T.StructField("validation_score", T.DoubleType()),
    T.StructField("best_iteration", T.IntegerType()),
    T.StructField("history", T.ArrayType(T.StructType([
        T.StructField("iteration", T.IntegerType()),
        T.StructField("train_loss", T.DoubleType()),
        T.StructField("validation_loss", T.DoubleType())]))),
    T.StructField("model_path", T.StringType()),
    T.StructField("reused", T.BooleanType()),
])

#: The generation options a model was called with.
GENERATION_TYPE = T.StructType([
    T.StructField("max_new_tokens", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("top_p", T.DoubleType()),
    T.StructField("do_sample", T.BooleanType()),
    T.StructField("repetition_penalty", T.DoubleType()),
    T.StructField("backend_name", T.StringType()),
])

# document body; the three keys come from the partition folders
DOCUMENT_SCHEMA = T.StructType([
    T.StructField("sample_size", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("metrics", METRICS_TYPE),
    T.StructField("training_config", TRAINING_CONFIG_TYPE),
    T.StructField("generation", GENERATION_TYPE),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def conform(results: DataFrame) -> DataFrame:
    """Bring a result frame to the document schema (missing fields NULL)."""
    cols = [F.col(k) for k in KEYS]
    for f in DOCUMENT_SCHEMA.fields:
        if f.name == "_corrupt_record":
            continue
        if f.name in results.columns:
            c = F.col(f.name)
            if isinstance(f.dataType, T.StructType):
                have = {x.name for x in results.schema[f.name].dataType.fields}
                c = F.when(F.col(f.name).isNotNull(), F.struct(*[
                    (F.col(f"{f.name}.{x.name}") if x.name in have else F.lit(None)).cast(x.dataType).alias(x.name)
                    for x in f.dataType.fields]))
            cols.append(c.cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return results.select(*cols)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON document per experiment under ``model=/strategy=/dataset=``;
    only the partitions present in ``results`` are replaced."""
    (conform(results).repartition(*KEYS).write.mode("overwrite").partitionBy(*KEYS)
     .option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").json(path))


def _without_corrupt(df: DataFrame) -> DataFrame:
    # Spark refuses scans whose only needed column is the corrupt-record
    # column (e.g. under count()); the always-true length test keeps a data
    # column in the scan without changing the result
    ok = F.col("_corrupt_record").isNull() & (F.length(F.coalesce("timestamp", "error", F.lit(""))) >= 0)
    return df.where(ok).drop("_corrupt_record")


def read_results(spark: SparkSession, path: str, include_corrupt: bool = False) -> DataFrame:
    """All result documents under ``path`` with the key columns restored
    from the folders, as text (a dataset ``007`` stays ``007``).  Undecodable
    documents are dropped (they count as not done) unless ``include_corrupt``."""
    schema = T.StructType(DOCUMENT_SCHEMA.fields + [T.StructField(k, T.StringType()) for k in KEYS])
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").option("basePath", path).json(path))
    df = df.select(*KEYS, *DOCUMENT_SCHEMA.fieldNames())
    return df if include_corrupt else _without_corrupt(df)


def flat_name(model: str, strategy: str, dataset: str) -> str:
    """File name of an experiment's flat document: the keys joined by ``_``, ``/`` of
    the model as ``_``, other characters that a path may not hold as ``%XX``."""
    from urllib.parse import quote
    return "_".join(quote(k, safe=" ") for k in (model.replace("/", "_"), strategy, dataset)) + ".json"


def _plain(value):
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def write_flat_results(results: DataFrame, path: str) -> list[str]:
    """One indented document ``{model}_{strategy}_{dataset}.json`` for each experiment,
    keys in the body, no ``error`` key on success; returns the names.

    A document is written under a hidden name and renamed over the old one on the
    file system of ``path``, so that a reader sees the old or the new one whole.
    The rows, one for each experiment, come to the driver."""
    spark = results.sparkSession
    docs = {}
    for row in conform(results).collect():
        body = {k: v for k, v in _plain(row).items() if v is not None}
        name = flat_name(row["model"], row["strategy"], row["dataset"])
        if name in docs:
            raise ValueError(f"two experiments share the file name '{name}'")
        docs[name] = json.dumps(body, indent=2, ensure_ascii=False).encode()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    make = jvm.org.apache.hadoop.fs.Path
    folder = make(path)
    fs = folder.getFileSystem(conf)
    fs.mkdirs(folder)
    for name, body in docs.items():
        hidden, target = make(folder, f".{uuid.uuid4().hex}.tmp"), make(folder, name)
        out = fs.create(hidden, False)
        try:
            out.write(body)
        finally:
            out.close()
        _replace(spark, fs, hidden, target)
    return sorted(docs)


def _replace(spark: SparkSession, fs, hidden, target) -> None:
    """Renames over an existing file, in one step where the file system can."""
    jvm = spark.sparkContext._jvm
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    hidden, target = fs.makeQualified(hidden), fs.makeQualified(target)
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    except Exception:  # a file system without one
        fs.delete(target, False)
        if not fs.rename(hidden, target):
            raise OSError(f"cannot rename to {target.toString()}") from None
        return
    context.rename(hidden, target, overwrite)


def read_flat_results(spark: SparkSession, path: str, include_corrupt: bool = False) -> DataFrame:
    """Result documents kept flat: JSON files, indented or not, one document
    each, with ``model``, ``strategy`` and ``dataset`` in the body."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + DOCUMENT_SCHEMA.fields)
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True)
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return df if include_corrupt else _without_corrupt(df)


def corrupt_documents(results: DataFrame) -> DataFrame:
    """Keys and text of undecodable documents, of a read with ``include_corrupt``."""
    return (results.select(*KEYS, "timestamp", "_corrupt_record").where(F.col("_corrupt_record").isNotNull())
            .drop("timestamp"))


def successful_results(spark: SparkSession, path: str) -> DataFrame:
    return read_results(spark, path).where(F.col("error").isNull())


def result_inventory(spark: SparkSession, path: str) -> DataFrame:
    """What lies under ``path``: files, documents that can be read, successful and
    failed ones, and undecodable ones."""
    schema = T.StructType(DOCUMENT_SCHEMA.fields + [T.StructField(k, T.StringType()) for k in KEYS])
    docs = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("basePath", path).json(path).select(F.col("_metadata.file_path").alias("file"), "timestamp", "error",
                                                        F.col("_corrupt_record").alias("corrupt")))
    good = F.col("corrupt").isNull()
    # the scan needs a column of the document besides the corrupt one
    seen = F.length(F.coalesce("timestamp", "error", F.lit(""))) >= 0
    return docs.where(seen).agg(
        F.count_distinct("file").alias("files"), F.count_if(good).alias("loaded"),
        F.count_if(good & F.col("error").isNull()).alias("successful"),
        F.count_if(good & F.col("error").isNotNull()).alias("failed"), F.count_if(~good).alias("undecodable"))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header, every field quoted.  ``single_file`` only for
    frames that are small by construction (a report)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_scored(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Scored test rows, partitioned by experiment (Parquet by default)."""
    w = df.write.mode("overwrite").partitionBy(*[k for k in KEYS if k in df.columns])
    if fmt == "csv":
        w.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def latest_results(results: DataFrame, successful_only: bool = True) -> DataFrame:
    """Newest document per experiment in an append-only result table (ISO
    timestamps sort as text).  Among documents of one time a successful one
    goes before a failed one, then the larger sample."""
    from pyspark.sql import Window
    r = results.where(F.col("error").isNull()) if successful_only else results
    order = [F.desc_nulls_last("timestamp"), F.col("error").isNotNull()]
    if "sample_size" in results.columns:
        order.append(F.desc_nulls_last("sample_size"))
    w = Window.partitionBy(*KEYS).orderBy(*order)
    return r.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
