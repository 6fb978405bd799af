"""Saving and loading a learned dictionary."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from otindex.plans.dictionary import DictionaryModel
from otindex.spec import DictionarySpec

TABLES = ("topics", "weights", "history")


def save_model(
    model: DictionaryModel, path: str, docs_pred: DataFrame | None = None, mode: str = "errorifexists"
) -> None:
    """Write the tables of a model, its parameters and, if given, its reconstructed documents."""
    for name in TABLES:
        getattr(model, name).write.mode(mode).parquet(f"{path}/{name}")
    spark = model.topics.sparkSession
    params = spark.createDataFrame([(json.dumps(asdict(model.spec)),)], "value string")
    params.write.mode(mode).text(f"{path}/params")
    if docs_pred is not None:
        docs_pred.write.mode(mode).parquet(f"{path}/docs_pred")


def load_model(spark: SparkSession, path: str) -> DictionaryModel:
    params = json.loads(spark.read.text(f"{path}/params").first()[0])
    params.pop("max_words", None)  # of models saved when the vocabulary had a limit
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    return DictionaryModel(**tables, spec=DictionarySpec(**params))
