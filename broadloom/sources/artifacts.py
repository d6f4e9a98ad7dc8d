"""Stored scalers and models: Parquet tables instead of serialized objects."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from broadloom.operators.network import LAYERS_SCHEMA, WEIGHTS_SCHEMA
from broadloom.operators.scalers import PARAMS_SCHEMA
from broadloom.sources.tables import TableNotFound


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as failure:
        if failure.getCondition() == "PATH_NOT_FOUND":
            raise TableNotFound(path) from failure
        raise


def save_params(params: DataFrame, path: str, *, mode: str = "append") -> None:
    """Scalers are added side by side, told apart by their name."""
    params.write.mode(mode).parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, PARAMS_SCHEMA)


def save_model(layers: DataFrame, weights: DataFrame, path: str, *, mode: str = "append") -> None:
    """Weights are partitioned by model, so that loading one model reads only its files."""
    weights.write.mode(mode).partitionBy("model").parquet(f"{path}/weights")
    layers.write.mode(mode).parquet(f"{path}/layers")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(model_layers, model_weights)`` of all stored models."""
    layers = _read(spark, f"{path}/layers", LAYERS_SCHEMA)
    return layers, _read(spark, f"{path}/weights", WEIGHTS_SCHEMA)
