"""Check a table, scale it with a stored scaler and encode it with a stored model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from broadloom.operators import compat, layers, network, scalers
from broadloom.operators import matrix as m
from broadloom.session import remove_path, scratch_path
from broadloom.sources import tables
from broadloom.sources.sinks import write_encoded

# Fixed value: the scaler of a model that names none.
DEFAULT_SCALER = "robustscaler_tuned"


class NoBottleneck(ValueError):
    """The model has no dense layer to read the encoding from."""


def bottleneck_layer(model_layers: DataFrame, model: str, *, fallback: bool = False) -> tuple[int, int]:
    """``(layer_idx, units)`` of the encoding layer.

    Models written by this library mark their bottleneck; others are searched for
    the first narrowest dense layer, or with ``fallback`` the middle layer.
    """
    mine = model_layers.filter(F.col("model") == model)
    marked = mine.filter("is_bottleneck").select("layer_idx", "units").first()
    if marked is not None:
        return marked["layer_idx"], marked["units"]
    find = layers.bottleneck_or_middle if fallback else layers.detect_bottleneck
    found = find(mine).first()
    if found is None or found["layer_idx"] is None:
        raise NoBottleneck(model)
    return found["layer_idx"], found["units"]


def encode_matrix(
    matrix: DataFrame,
    params: DataFrame,
    scaler: str | None,
    model_layers: DataFrame,
    weights: DataFrame,
    model: str,
    *,
    null_policy: str = "zero",
    on_missing: str = "raise",
    fallback: bool = False,
    max_params: int = network.MAX_PARAMS,
) -> DataFrame:
    """Append ``encoded`` to the metadata of each row.

    Without a scaler the data is encoded unscaled. Row-local for models of any size: the plan
    has no exchange, rows need no key, and a row that cannot be encoded is flagged alone. Where
    the middle layer stands in for a bottleneck and is no dense layer, its own output is
    taken, that is with the normalisation.
    """
    stages, normalised, _ = _load(model_layers, weights, model, fallback, max_params)
    prepared = _prepare(matrix, params, scaler, null_policy, on_missing)
    return network.encode(prepared, stages, normalised=normalised)


def _prepare(
    matrix: DataFrame, params: DataFrame, scaler: str | None, null_policy: str, on_missing: str
) -> DataFrame:
    prepared = m.as_float64(m.as_float32(m.fill_nulls(matrix, null_policy)))
    if scaler is None:
        return prepared
    return scalers.transform(prepared, params, scaler, on_missing=on_missing)


def _load(
    model_layers: DataFrame, weights: DataFrame, model: str, fallback: bool, max_params: int
) -> tuple[list[dict], bool, int]:
    """Stages up to the bottleneck, whether its normalised output is meant, and its units."""
    layer, units = bottleneck_layer(model_layers, model, fallback=fallback)
    stages = network.load_stages(model_layers, weights, model, through=layer, max_params=max_params)
    of_layer = (F.col("model") == model) & (F.col("layer_idx") == layer)
    kind = model_layers.filter(of_layer).select("kind").first()["kind"]
    return stages, kind != "dense", units


def encode_table(
    df: DataFrame,
    params: DataFrame,
    scaler: str,
    model_layers: DataFrame,
    weights: DataFrame,
    model: str,
    *,
    metadata: Sequence[str] = m.METADATA,
    exclude: Sequence[str] = (),
    keep: Sequence[str] = (),
    output: str | None = None,
    named: bool = True,
) -> DataFrame:
    """Gate, scale and encode a columnar table; optionally write the result."""
    expected = compat.expected_features(params, scaler)
    compat.gate(df.schema, expected, [*metadata, *keep], exclude)
    matrix = m.to_matrix(df, metadata, exclude=exclude, keep=keep)
    encoded = encode_matrix(matrix, params, scaler, model_layers, weights, model)
    _, units = bottleneck_layer(model_layers, model)
    if output is not None:
        write_encoded(encoded, output, width=units if named else None)
    return encoded


def encode_csv(
    spark: SparkSession,
    path: str,
    params: DataFrame,
    scaler: str,
    model_layers: DataFrame,
    weights: DataFrame,
    model: str,
    *,
    metadata: Sequence[str] = m.METADATA,
    exclude: Sequence[str] = (),
    keep: Sequence[str] = (),
    output: str | None = None,
    named: bool = True,
) -> DataFrame:
    """Gate, scale and encode a very wide CSV, whose features are read as one array."""
    text, names = tables.read_text_matrix(spark, path, metadata, keep)
    skipped = {i for i, n in enumerate(names) if n in set(exclude)}
    cells = text.select(F.posexplode("cells").alias("feature_idx", "value"))
    if skipped:
        cells = cells.filter(~F.col("feature_idx").isin(skipped))
    bad = compat.non_numeric_features(cells)
    kept = [n for i, n in enumerate(names) if i not in skipped]
    expected = compat.expected_features(params, scaler)
    compat.gate_names(kept if skipped else names, expected, bad if not skipped else None)
    if skipped and not bad.isEmpty():
        raise compat.Incompatible(f"{bad.count()} non-numeric feature columns")
    matrix, _ = tables.read_feature_csv(spark, path, metadata, exclude=exclude, keep=keep)
    encoded = encode_matrix(matrix, params, scaler, model_layers, weights, model)
    _, units = bottleneck_layer(model_layers, model)
    if output is not None:
        write_encoded(encoded, output, width=units if named else None)
    return encoded


STATUS_SCHEMA = "model string, scaler string, output string, rows bigint, failed_rows bigint, error string"


def encode_all(
    matrix: DataFrame,
    params: DataFrame,
    model_layers: DataFrame,
    weights: DataFrame,
    output_dir: str,
    *,
    excluded: Sequence[str] = (),
    explicit: dict[str, str] | None = None,
    default: str = DEFAULT_SCALER,
    include_metadata: bool = True,
    key: str = "row_id",
    named: bool = True,
    null_policy: str = "zero",
    on_missing: str = "raise",
    max_params: int = network.MAX_PARAMS,
) -> DataFrame:
    """Encode with every stored model, each with its own scaler.

    The table is first trimmed to the width of the scaler. It is read and scaled once for all models
    of a scaler; their encodings are stored by model and written from there. A model that
    fails is reported in the status table and does not stop the others. The driver loops over
    scalers and models, never over rows.
    """
    spark = matrix.sparkSession
    skip = spark.createDataFrame([(e,) for e in excluded], "model string")
    chosen = scalers.resolve(
        layers.active_models(model_layers, skip),
        params,
        spark.createDataFrame(list((explicit or {}).items()), "model string, scaler string"),
        default,
    )
    of_scaler: dict[str | None, list[str]] = {}
    for row in chosen.orderBy("model").collect():
        of_scaler.setdefault(row["scaler"], []).append(row["model"])

    # A name that no column of the table bears.
    number = "_" * (1 + max(map(len, [*matrix.columns, "encode_error"])))

    def encoded_together(scaler: str | None, models: list[str], status: list[tuple]) -> None:
        loaded = {}
        for model in models:
            try:
                # The workers hold the models of a scaler together.
                loaded[model] = _load(model_layers, weights, model, True, max_params // len(models))
            except Exception as failure:  # noqa: BLE001 - reported as a row
                status.append(_failed(model, scaler, failure))
        if not loaded:
            return
        try:
            data = matrix
            if scaler is not None:
                data = m.trim(data, compat.expected_features(params, scaler))
            data = _prepare(data, params, scaler, null_policy, on_missing)
            each = network.encode_each(data, [(stages, norm) for stages, norm, _ in loaded.values()], number)
            if not include_metadata:
                each = each.select(*[c for c in each.columns if c in (key, "encoded", "encode_error", number)])
            staged = scratch_path(spark, "encoded-models")
            each.write.partitionBy(number).parquet(staged)
        except Exception as failure:  # noqa: BLE001 - retried below, one model at a time
            if len(loaded) == 1:
                status.append(_failed(next(iter(loaded)), scaler, failure))
            else:
                for model in loaded:
                    encoded_together(scaler, [model], status)
            return
        stored = spark.read.schema(each.schema).parquet(staged)
        for i, (model, (_, _, units)) in enumerate(loaded.items()):
            path = f"{output_dir.rstrip('/')}/{model}"
            try:
                seen = Observation()
                mine = stored.filter(F.col(number) == i).drop(number).observe(
                    seen, F.count(F.lit(1)).alias("n"), F.count("encode_error").alias("bad")
                )
                write_encoded(mine, path, width=units if named else None)
                status.append((model, scaler, path, seen.get["n"], seen.get["bad"], None))
            except Exception as failure:  # noqa: BLE001 - reported as a row
                status.append(_failed(model, scaler, failure))
        remove_path(spark, staged)

    status: list[tuple] = []
    for scaler, models in of_scaler.items():
        encoded_together(scaler, models, status)
    return spark.createDataFrame(sorted(status, key=lambda row: row[0]), STATUS_SCHEMA)


def _failed(model: str, scaler: str | None, failure: Exception) -> tuple:
    return model, scaler, None, None, None, str(failure).splitlines()[0]
