"""Fitted models kept in shared storage, and found again by what they were fitted on.

``<path>/fitted/<id>`` holds a saved pipeline (featurizer and classifier); a row of
``<path>/registry`` is written after it is complete, so an interrupted save is never
listed.  A model is used again for the same name, dataset and fingerprint (rows and
settings); of several the newest that can be read is taken.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso_timestamp

REGISTRY = "model string, dataset string, fingerprint string, path string, info string, saved_at string"


class ModelStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def registry(self) -> DataFrame:
        """One row for each saved model."""
        from ..sources.datasets import _exists
        place = f"{self.path}/registry"
        if not _exists(self.spark, place):
            return self.spark.createDataFrame([], REGISTRY)
        return self.spark.read.schema(REGISTRY).json(place)

    def save(self, model: PipelineModel, name: str, dataset: str, fingerprint: str, info: dict) -> str:
        """Saves a fitted pipeline and then lists it; ``info``: what the fit reported."""
        path = f"{self.path}/fitted/{uuid.uuid4().hex}"
        model.write().save(path)
        row = [(name, dataset, fingerprint, path, json.dumps(info))]
        self.spark.createDataFrame(row, "model string, dataset string, fingerprint string, path string, info string") \
            .withColumn("saved_at", iso_timestamp()).coalesce(1).write.mode("append").json(f"{self.path}/registry")
        return path

    def newest(self, name: str, dataset: str, fingerprint: str | None = None) -> tuple[PipelineModel, dict, str] | None:
        """The newest readable model of an experiment (of a fingerprint, if one is
        given), its info and its path; None if there is none."""
        rows = self.registry().where((F.col("model") == name) & (F.col("dataset") == dataset))
        if fingerprint is not None:
            rows = rows.where(F.col("fingerprint") == fingerprint)
        unreadable: list[str] = []
        while True:
            newest = rows.where(~F.col("path").isin(unreadable) if unreadable else F.lit(True)) \
                .agg(F.max_by(F.struct("path", "info"), F.struct("saved_at", "path")).alias("r")).first()["r"]
            if newest is None:
                return None
            try:
                return PipelineModel.load(newest["path"]), json.loads(newest["info"]), newest["path"]
            except Exception:  # removed or damaged: the one before it
                unreadable.append(newest["path"])
