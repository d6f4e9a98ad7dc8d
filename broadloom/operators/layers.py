"""Questions about stored models, asked of their layer table.

``model_layers(model, layer_idx, name, kind, units, activation, ...)`` has one row
per layer; every operator answers for all models in one grouped pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_dense() -> Column:
    return F.lower("name").contains("dense")


def catalog(layers: DataFrame, excluded: DataFrame) -> DataFrame:
    """Stored models, each flagged as excluded or not."""
    listed = layers.select("model").distinct()
    skip = excluded.select("model").distinct().withColumn("excluded", F.lit(True))
    return listed.join(skip, "model", "left").withColumn(
        "excluded", F.coalesce("excluded", F.lit(False))
    )


def active_models(layers: DataFrame, excluded: DataFrame) -> DataFrame:
    return layers.select("model").distinct().join(excluded, "model", "left_anti")


def catalog_counts(layers: DataFrame, excluded: DataFrame) -> DataFrame:
    return catalog(layers, excluded).agg(
        F.count("*").alias("models"),
        F.count_if("excluded").alias("excluded"),
        F.count_if(~F.col("excluded")).alias("to_process"),
    )


def _narrowest() -> Column:
    """Layer of the fewest units among the dense ones; the first wins ties."""
    order = F.when(is_dense(), F.struct("units", "layer_idx"))
    return F.min_by(F.struct("layer_idx", "units"), order)


def detect_bottleneck(layers: DataFrame) -> DataFrame:
    """``model, layer_idx, units``; models without a dense layer get nulls."""
    return (
        layers.groupBy("model")
        .agg(_narrowest().alias("b"))
        .select("model", F.col("b.layer_idx").alias("layer_idx"), F.col("b.units").alias("units"))
    )


def bottleneck_or_middle(layers: DataFrame) -> DataFrame:
    """As ``detect_bottleneck``, with the middle layer where there is no dense one."""
    middle = F.floor(F.count("*") / 2).cast("int")
    chosen = layers.groupBy("model").agg(_narrowest().alias("b"), middle.alias("middle"))
    chosen = chosen.select(
        "model",
        F.coalesce("b.layer_idx", "middle").alias("layer_idx"),
        F.col("b").isNull().alias("fallback"),
    )
    return chosen.join(layers.select("model", "layer_idx", "units"), ["model", "layer_idx"])


def dense_layers(layers: DataFrame) -> DataFrame:
    return layers.filter(F.col("kind") == "dense").select("model", "layer_idx", "name", "units")


def widths(layers: DataFrame) -> DataFrame:
    """Input and output width and number of dense layers of each model."""
    return layers.groupBy("model").agg(
        F.min_by("units", "layer_idx").alias("input_width"),
        F.max_by("units", "layer_idx").alias("output_width"),
        F.count_if(F.col("kind") == "dense").alias("dense_layers"),
    )


def layer_with_units(layers: DataFrame, units: int) -> DataFrame:
    """The last dense layer of the wanted width; null where a model has none."""
    match = (F.col("kind") == "dense") & (F.col("units") == units)
    order = F.when(match, F.col("layer_idx"))
    return layers.groupBy("model").agg(
        F.max(order).alias("layer_idx"), F.max_by("name", order).alias("name")
    )
