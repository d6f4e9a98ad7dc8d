"""The mirrored autoencoder: its tables, and inference on blocks of rows.

A model is two tables: ``model_layers`` and ``model_weights(model, layer_idx, part,
row_idx, w)`` with one row per kernel row or per vector. Workers see it as a list of
stages ``{part: array}``; a stage is a dense layer with its activation and, but for
the output, its normalisation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.operators.blocks import map_features, map_features_each
from broadloom.operators.held import MAX_HELD, hold

LAYERS_SCHEMA = (
    "model string, layer_idx int, name string, kind string, units int, "
    "activation string, is_bottleneck boolean"
)
WEIGHTS_SCHEMA = "model string, layer_idx int, part string, row_idx int, w array<double>"

# Fixed value: added to the variance by batch normalisation.
NORM_EPSILON = 1e-3

# Weights up to this many doubles are held by every Python worker, larger kernels are mapped.
MAX_PARAMS = MAX_HELD

PARTS = ("kernel", "bias", "gamma", "beta", "moving_mean", "moving_var")


class ModelTooLarge(ValueError):
    """The weights exceed what a training worker may hold."""


def layer_rows(
    model: str, n_features: int, layer_config: Sequence[int], encoding_dim: int
) -> list[tuple]:
    """The layer table of one autoencoder, in order."""
    rows: list[tuple] = [(model, 0, "input_layer", "input", n_features, None, False)]
    counts = {"dense": 0, "batch_normalization": 0, "dropout": 0}

    def add(kind: str, units: int, activation: str | None, bottleneck: bool = False) -> None:
        suffix = f"_{counts[kind]}" if counts[kind] else ""
        rows.append((model, len(rows), kind + suffix, kind, units, activation, bottleneck))
        counts[kind] += 1

    hidden = [*layer_config, encoding_dim, *reversed(layer_config)]
    for position, units in enumerate(hidden):
        add("dense", units, "relu", position == len(layer_config))
        add("batch_normalization", units, None)
        add("dropout", units, None)
    add("dense", n_features, "linear")
    return rows


def layers_table(
    spark: SparkSession,
    models: Iterable[tuple[str, int, Sequence[int], int]],
) -> DataFrame:
    rows = [row for m in models for row in layer_rows(*m)]
    return spark.createDataFrame(rows, LAYERS_SCHEMA)


def weight_rows(model: str, stages: Sequence[dict[str, np.ndarray]]) -> list[tuple]:
    """Weight table rows of one model; stage s is the dense layer at index 1 + 3 s."""
    rows = []
    for s, stage in enumerate(stages):
        for part in PARTS:
            if part not in stage:
                continue
            block = stage[part] if part == "kernel" else stage[part][None, :]
            for i, row in enumerate(block):
                rows.append((model, 1 + 3 * s, part, i, [float(x) for x in row]))
    return rows


def load_stages(
    layers: DataFrame,
    weights: DataFrame,
    model: str,
    *,
    through: int | None = None,
    max_params: int = MAX_PARAMS,
) -> list[dict]:
    """Read the stages up to layer ``through``.

    Kernels are arrays in memory as long as all stages have at most ``max_params`` weights; in
    larger models they are mapped from files. Both work the same wherever stages are used.
    """
    mine = weights.filter(F.col("model") == model)
    if through is not None:
        mine = mine.filter(F.col("layer_idx") <= through)
    sizes = mine.groupBy("layer_idx").agg(F.sum(F.size("w")).alias("n")).orderBy("layer_idx").collect()
    if not sizes:
        raise LookupError(f"no stored weights for model {model!r}")
    limit = max_params if sum(r["n"] for r in sizes) <= max_params else 0
    activation = {
        r["layer_idx"]: r["activation"]
        for r in layers.filter((F.col("model") == model) & (F.col("kind") == "dense")).collect()
    }
    stages = []
    for r in sizes:
        parts = mine.filter(F.col("layer_idx") == r["layer_idx"])
        vectors = parts.filter("part <> 'kernel'").collect()
        stage: dict = {v["part"]: np.array(v["w"]) for v in vectors}
        stage["kernel"] = hold(parts.filter("part = 'kernel'"), "row_idx", "w", limit)
        stages.append({**stage, "relu": activation.get(r["layer_idx"]) == "relu"})
    return stages


def _normalise(h: np.ndarray, stage: dict) -> np.ndarray:
    spread = np.sqrt(stage["moving_var"] + NORM_EPSILON)
    return stage["gamma"] * (h - stage["moving_mean"]) / spread + stage["beta"]


def run_stages(
    block: np.ndarray, stages: Sequence[dict], *, encode: bool, normalised: bool = False
) -> np.ndarray:
    """Inference: stored normalisation statistics, no dropout.

    With ``encode`` the result is the activation of the last given dense layer, before its
    normalisation unless ``normalised``.
    """
    h = block
    for s, stage in enumerate(stages):
        h = h @ stage["kernel"] + stage["bias"]
        if stage["relu"]:
            h = np.maximum(h, 0.0)
        if encode and not normalised and s == len(stages) - 1:
            break
        if "gamma" in stage:
            h = _normalise(h, stage)
    return h


def reconstruct(matrix: DataFrame, stages: Sequence[dict], *, output: str = "pred") -> DataFrame:
    """Append the model output of each row."""
    shared = matrix.sparkSession.sparkContext.broadcast(list(stages))
    return map_features(matrix, lambda x: run_stages(x, shared.value, encode=False), output)


def encode(
    matrix: DataFrame,
    stages: Sequence[dict],
    *,
    output: str = "encoded",
    error: str | None = "encode_error",
    drop_features: bool = True,
    normalised: bool = False,
) -> DataFrame:
    """Append the bottleneck activations of each row.

    Row-local, so the plan has no exchange and the metadata stays with its row. Rows
    that cannot be encoded are flagged in ``error`` instead of being written as zeros.
    """
    shared = matrix.sparkSession.sparkContext.broadcast(list(stages))
    dropped = ("features",) if drop_features else ()
    return map_features(
        matrix,
        lambda x: run_stages(x, shared.value, encode=True, normalised=normalised),
        output,
        width=stages[0]["kernel"].shape[0],
        error=error,
        drop=dropped,
    )


def encode_each(
    matrix: DataFrame,
    models: Sequence[tuple[Sequence[dict], bool]],
    number: str,
    *,
    output: str = "encoded",
    error: str = "encode_error",
) -> DataFrame:
    """The rows once for each model, given by its stages and whether its output is normalised.

    One pass over the table feeds all of them; ``number`` tells the place of the model in the list.
    """
    shared = matrix.sparkSession.sparkContext.broadcast([(list(stages), normalised) for stages, normalised in models])

    def kernel(stages: list[dict], normalised: bool):
        return lambda x: run_stages(x, stages, encode=True, normalised=normalised)

    def kernels():
        return [(kernel(*model), model[0][0]["kernel"].shape[0]) for model in shared.value]

    return map_features_each(matrix, kernels, output, error, number)
