"""Model registry lookups as joins over small tables.

* :func:`backend_lookup` — configured model -> back-end model name (left
  join); a model without an entry gets an error message instead.
* :func:`resolve_backend_names` — match each configured back-end name to
  the names a serving back end lists: an exact match first, else a match
  of the normalised names (hub URL vs ``hf.co/``, tag dropped, case), the
  first listed name winning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BACKEND_MODEL_MAPPING, MODEL_CONFIGS
from ..functions.text import model_parameters, normalize_backend_name


def registry_frame(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    m = BACKEND_MODEL_MAPPING if mapping is None else mapping
    return spark.createDataFrame(list(m.items()), "model string, backend_name string")


def backend_lookup(models: DataFrame, registry: DataFrame) -> DataFrame:
    """``model, backend_name, error``: the registry side is broadcast (one
    row per configured model)."""
    j = models.select("model").distinct().join(F.broadcast(registry), "model", "left")
    err = F.when(F.col("backend_name").isNull(),
                 F.concat(F.lit("model '"), F.col("model"), F.lit("' is not in the back-end registry")))
    return j.select("model", "backend_name", err.alias("error"))


def resolve_backend_names(configured: DataFrame, available: DataFrame) -> DataFrame:
    """``configured``: ``model, backend_name``; ``available``: ``name,
    position`` (listing order).  Returns ``model, backend_name, resolved``
    where ``resolved`` is the exact name if listed, else the first listed
    name with the same normalised form, else the configured name."""
    av = available.groupBy("name").agg(F.min("position").alias("position"))  # a name may be listed twice
    exact = configured.join(F.broadcast(av.withColumnRenamed("name", "backend_name")), "backend_name", "left") \
        .select("model", "backend_name", F.when(F.col("position").isNotNull(), F.col("backend_name"))
                .alias("_exact"))
    norm = av.withColumn("_n", normalize_backend_name("name"))
    loose = (configured.withColumn("_n", normalize_backend_name("backend_name"))
             .join(F.broadcast(norm), "_n")
             .withColumn("_rk", F.row_number().over(Window.partitionBy("model").orderBy("position")))
             .where("_rk = 1").select("model", F.col("name").alias("_loose")))
    return exact.join(loose, "model", "left").select(
        "model", "backend_name", F.coalesce("_exact", "_loose", "backend_name").alias("resolved"))


def attach_backends(spark: SparkSession, models: list, available: DataFrame | None = None,
                    mapping: dict | None = None) -> list:
    """The models with the back-end name each is called by: the registry's entry,
    resolved against the names that the back end lists (``available``, if given).
    Models without an entry are left out, so their cells get the registry error.
    One row per configured model comes to the driver."""
    from dataclasses import replace
    names = spark.createDataFrame([(m.name,) for m in models], "model string")
    looked = backend_lookup(names, registry_frame(spark, mapping)).where("error IS NULL").select("model", "backend_name")
    if available is not None:
        looked = resolve_backend_names(looked, available).select("model", F.col("resolved").alias("backend_name"))
    found = {r["model"]: r["backend_name"] for r in looked.collect()}
    return [replace(m, backend_name=found[m.name]) for m in models if m.name in found]


def model_info(spark: SparkSession, models: list[str], configs: dict | None = None,
               mapping: dict | None = None) -> DataFrame:
    """Static description of each configured model: back-end name,
    quantization, generation limit and parameter count read from the name.
    (Joined to the report on ``model``; nothing is measured here.)"""
    cfg = MODEL_CONFIGS if configs is None else configs
    mp = BACKEND_MODEL_MAPPING if mapping is None else mapping
    rows = [(m, mp.get(m), (cfg.get(m) or {}).get("quantization"), (cfg.get(m) or {}).get("max_new_tokens"))
            for m in models]
    df = spark.createDataFrame(rows, "model string, backend_name string, quantization string, max_new_tokens int")
    return df.withColumn("num_parameters", model_parameters("model"))


def report_with_models(report: DataFrame, info: DataFrame) -> DataFrame:
    """Report rows with the description of their model (one row per model)."""
    return report.join(F.broadcast(info), "model", "left")
