"""Stored models: catalog, bottleneck, inference, training."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadloom.operators import layers, network, scalers, training, wide_training
from broadloom.operators import matrix as m
from broadloom.plans import encoding
from broadloom.plans.tuning import grid_configs, tune
from broadloom.queries import fixtures as fx
from broadloom.queries.matrix_queries import WIDE, WIDE_SQL, wide_table
from broadloom.queries.registry import query
from broadloom.session import materialize, scratch_path
from broadloom.sources import artifacts, tables

_EXCLUDED = """excluded AS (SELECT DISTINCT 'model_' || s_suppkey AS model FROM supplier)"""


def _excluded(spark, sf_dir):
    """Models that bear the number of a supplier are left out."""
    key = F.col("s_suppkey").cast("string")
    return fx.table(spark, sf_dir, "supplier").select(F.concat(F.lit("model_"), key).alias("model"))


@query(
    "a08_model_catalog",
    f"""WITH {fx.PART_LAYERS}, {_EXCLUDED}
SELECT model, model IN (SELECT model FROM excluded) AS excluded FROM (SELECT DISTINCT model FROM layers)""",
)
def a08(spark, sf_dir):
    return layers.catalog(fx.part_layers(spark, sf_dir), _excluded(spark, sf_dir))


@query(
    "a08_catalog_counts",
    f"""WITH {fx.PART_LAYERS}, {_EXCLUDED}, c AS (
  SELECT DISTINCT model, model IN (SELECT model FROM excluded) AS x FROM layers)
SELECT count(*) AS models, count(*) FILTER (WHERE x) AS excluded, count(*) FILTER (WHERE NOT x) AS to_process FROM c""",
)
def a08_counts(spark, sf_dir):
    return layers.catalog_counts(fx.part_layers(spark, sf_dir), _excluded(spark, sf_dir))


# --- training -------------------------------------------------------------


def _scaled(spark, sf_dir):
    matrix = fx.matrix(spark, sf_dir)
    params = materialize(scalers.fit(matrix, "standard"), "params")
    return materialize(scalers.transform(matrix, params, "standard"), "scaled")


@query("g01_autoencoder_fit")
def g01(spark, sf_dir):
    """Loss history of one small network."""
    config = training.Config(1, 8, (32,), learning_rate=0.005)
    fitted = training.fit_grid(_scaled(spark, sf_dir), [config], epochs=3)
    return fitted.history(spark)


@query(
    "g01_wide_fit",
    """SELECT CAST(t AS INTEGER) AS trial_id, CAST(e AS INTEGER) AS epoch, true AS same_loss, true AS same_val_loss,
       true AS below_start, round(s, 6) AS mean_square
FROM (SELECT unnest(range(1, 3)) AS t) CROSS JOIN (SELECT unnest(range(1, 3)) AS e)
CROSS JOIN (SELECT avg(x * x) AS s FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings))""",
)
def g01_wide(spark, sf_dir):
    """Training in feature blocks, as for grids above the limit of a worker, takes the steps of training in memory."""
    matrix = materialize(fx.matrix(spark, sf_dir), "matrix")
    rows = matrix.count()
    shared = {"learning_rate": 0.01, "batch_size": rows, "dropout_rate": 0.0}
    configs = [training.Config(1, 8, (32,), **shared), training.Config(2, 4, (24, 12), **shared)]
    wide = wide_training.fit_wide(matrix, configs, epochs=2, block_features=20).history(spark)
    held = training.fit_grid(matrix, configs, epochs=2, workers=1).history(spark)
    held = held.select("trial_id", "epoch", F.col("loss").alias("l"), F.col("val_loss").alias("v"))
    start = wide.filter("epoch = 1").select("trial_id", F.col("loss").alias("start"))
    square = matrix.select(F.explode("features").alias("x")).agg(F.round(F.avg(F.col("x") * F.col("x")), 6))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9 * F.col(b)
    joined = wide.join(held, ["trial_id", "epoch"]).join(start, "trial_id")
    return joined.select(
        "trial_id",
        "epoch",
        near("loss", "l").alias("same_loss"),
        near("val_loss", "v").alias("same_val_loss"),
        (F.col("loss") <= F.col("start")).alias("below_start"),
        F.lit(square.first()[0]).alias("mean_square"),
    )


@query(
    "g02_grid_run",
    """SELECT CAST(t AS INTEGER) AS trial_id, true AS rmse_fits, true AS improvement_fits, true AS took_time,
       CAST(2 * (64 * a + a) + 0 AS BIGINT) > 0 AS has_params, round(b, 6) + 0.0 AS baseline_mse
FROM (SELECT unnest(range(1, 5)) AS t, 24 AS a)
CROSS JOIN (SELECT avg(v) AS b FROM (SELECT var_pop((x - c) / CASE WHEN s < 1e-14 THEN 1.0 ELSE s END) AS v FROM (
  SELECT feature_idx, x, quantile_cont(x, 0.5) OVER f AS c,
         quantile_cont(x, 0.75) OVER f - quantile_cont(x, 0.25) OVER f AS s
  FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS feature_idx FROM embeddings)
  WINDOW f AS (PARTITION BY feature_idx)) GROUP BY feature_idx))""",
)
def g02(spark, sf_dir):
    """Four configurations trained together: what must hold of every trial row."""
    stored = _grid_trials(spark, sf_dir)
    near = lambda a, b: F.abs(a - b) < 1e-9
    return stored.select(
        "trial_id",
        near(F.col("rmse") * F.col("rmse"), F.col("mse")).alias("rmse_fits"),
        near(F.col("improvement_ratio"), 1 - F.col("mse") / F.col("baseline_mse")).alias("improvement_fits"),
        (F.col("total_training_time") > 0).alias("took_time"),
        (F.col("total_params") > 0).alias("has_params"),
        (F.round("baseline_mse", 6) + 0.0).alias("baseline_mse"),
    )


@query("g02_grid_trials")
def g02_trials(spark, sf_dir):
    """The trial rows themselves."""
    return _grid_trials(spark, sf_dir).withColumn("layer_config", F.to_json("layer_config"))


def _grid_trials(spark, sf_dir):
    path = scratch_path(spark, "trials")
    configs = grid_configs((4, 8), ((24,), (24, 12)), learning_rate=0.005)
    tune(fx.matrix(spark, sf_dir), "robust", configs, path, epochs=2)
    return tables.read_trials(spark, path)


# --- inference ------------------------------------------------------------

_CODED = f"""WITH {fx.CLASS_WEIGHTS}
SELECT row_id, CAST(j AS INTEGER) AS unit, round(e, 6) AS value FROM coded"""


def _stages(spark, sf_dir):
    return network.load_stages(*fx.class_model(spark, sf_dir), fx.CLASS_MODEL)


def _units(df, column):
    return df.select("row_id", F.posexplode(column).alias("unit", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query("g04_reconstruct", _CODED)
def g04(spark, sf_dir):
    """The whole stored network, here ending at its four units."""
    return _units(network.reconstruct(fx.matrix(spark, sf_dir), _stages(spark, sf_dir)), "pred")


@query("g05_encode", _CODED)
def g05(spark, sf_dir):
    return _units(network.encode(fx.matrix(spark, sf_dir), _stages(spark, sf_dir)), "encoded")


@query("g05_encode_blocked", _CODED)
def g05_blocked(spark, sf_dir):
    """The same with mapped kernels, as for very large models; row keys repeat."""
    model_layers, weights = fx.class_model(spark, sf_dir)
    same_key = fx.matrix(spark, sf_dir).withColumnRenamed("row_id", "id").withColumn("row_id", F.lit(1))
    encoded = encoding.encode_matrix(
        m.as_float64(same_key), scalers.empty_params(spark), None,
        model_layers, weights, fx.CLASS_MODEL, max_params=100,
    )
    return _units(encoded.withColumn("row_id", F.col("id")), "encoded")


@query(
    "g05_encode_wide",
    f"""WITH {fx.CELLS}, {WIDE_SQL}, peaks AS (SELECT feature_idx, max(abs(x)) AS s FROM wide GROUP BY feature_idx),
units AS (SELECT unnest(range(0, 4)) AS unit)
SELECT row_id, CAST(unit AS INTEGER) AS unit,
       round(greatest(sum(x / s * (((feature_idx * 7 + unit * 13) % 11 - 5) / 10.0)) + any_value(unit) / 10.0, 0.0), 6) + 0.0 AS value
FROM wide JOIN peaks USING (feature_idx) CROSS JOIN units GROUP BY row_id, unit""",
)
def g05_wide(spark, sf_dir):
    """Gate, scale and encode a table of 2,500 feature columns."""
    wide = wide_table(spark, sf_dir)
    params = materialize(scalers.fit(m.to_matrix(wide, keep=["row_id"]), "maxabs"), "params")
    rows = [("wide", 1, "kernel", i, [((i * 7 + j * 13) % 11 - 5) / 10 for j in range(4)]) for i in range(WIDE)]
    rows.append(("wide", 1, "bias", 0, [j / 10 for j in range(4)]))
    weights = spark.createDataFrame(rows, network.WEIGHTS_SCHEMA)
    model_layers = network.layers_table(spark, [("wide", WIDE, (), 4)])
    encoded = encoding.encode_table(wide, params, "maxabs", model_layers, weights, "wide", keep=["row_id"])
    return _units(encoded, "encoded").withColumn("value", F.col("value") + 0.0)


@query("g04_reconstruct_mapped", _CODED)
def g04_mapped(spark, sf_dir):
    stages = network.load_stages(*fx.class_model(spark, sf_dir), fx.CLASS_MODEL, max_params=100)
    return _units(network.reconstruct(fx.matrix(spark, sf_dir), stages), "pred")


@query(
    "g05_scale_and_encode",
    f"""WITH {fx.CLASS_WEIGHTS}, filled AS (
  SELECT row_id, feature_idx, CASE WHEN (row_id * 64 + feature_idx) % 17 = 0 THEN 0.0 ELSE x END AS x FROM cells),
peaks AS (SELECT feature_idx, max(abs(x)) AS s FROM filled GROUP BY feature_idx),
hidden2 AS (
  SELECT row_id, j, greatest(sum(x / s * w) + any_value(b), 0.0) AS a
  FROM filled JOIN peaks USING (feature_idx) JOIN w1 ON w1.i = feature_idx JOIN b1 USING (j) GROUP BY row_id, j),
normed2 AS (
  SELECT row_id, j, (a - 0.05) / sqrt(0.5 + 0.001) * (1 + j / 10.0) + 0.01 AS h FROM hidden2)
SELECT row_id, CAST(w2.j AS INTEGER) AS unit,
       round(greatest(sum(h * w) + any_value((w2.j % 3) / 10.0), 0.0), 6) AS value
FROM normed2 JOIN w2 ON w2.i = normed2.j GROUP BY row_id, w2.j""",
)
def g05_scaled(spark, sf_dir):
    """Fill, round to single precision, scale with a stored scaler, encode."""
    from broadloom.queries.matrix_queries import scale_and_encode

    return _units(scale_and_encode(spark, sf_dir), "encoded")


_FLAGGED = f"""WITH {fx.CLASS_WEIGHTS}
SELECT c.row_id, CAST(j AS INTEGER) AS unit, round(e, 6) AS value, NULL::VARCHAR AS encode_error
FROM coded c JOIN embeddings v ON v.vec_id = c.row_id WHERE label <> 3
UNION ALL SELECT vec_id, NULL, NULL, 'expected 64 features, found 63' FROM embeddings WHERE label = 3"""


@query("g06_encode_errors", _FLAGGED)
def g06(spark, sf_dir):
    """Rows of one label lack a feature: they are flagged, the others are encoded."""
    return _with_short_rows(spark, sf_dir, network.MAX_PARAMS)


@query("g06_encode_errors_blocked", _FLAGGED)
def g06_mapped(spark, sf_dir):
    """The same with mapped kernels."""
    return _with_short_rows(spark, sf_dir, 100)


def _with_short_rows(spark, sf_dir, max_params):
    short = F.when(F.col("Label") == "3", F.slice("features", 1, 63)).otherwise(F.col("features"))
    ragged = fx.matrix(spark, sf_dir).withColumn("features", short)
    stages = network.load_stages(*fx.class_model(spark, sf_dir), fx.CLASS_MODEL, max_params=max_params)
    encoded = network.encode(ragged, stages)
    return encoded.select(
        "row_id", "encode_error", F.posexplode_outer("encoded").alias("unit", "value")
    ).withColumn("value", F.round("value", 6))


@query(
    "g07_encode_all_models",
    """SELECT 'class_means' AS model, 'class_means_tuned' AS scaler, count(*) AS rows,
       0::BIGINT AS failed_rows, false AS failed FROM embeddings
UNION ALL SELECT 'unreadable', 'robustscaler_tuned', NULL, NULL, true""",
)
def g07(spark, sf_dir):
    """Three stored models: one encodes, one is excluded, one has lost its weights."""
    model_layers, weights = fx.class_model(spark, sf_dir)
    others = model_layers.withColumn("model", F.explode(F.array(F.lit("unreadable"), F.lit("skipped"))))
    matrix = fx.matrix(spark, sf_dir)
    path = scratch_path(spark, "params")
    for name in ("class_means_tuned", "robustscaler_tuned"):
        artifacts.save_params(scalers.named(scalers.fit(matrix, "standard"), name), path)
    status = encoding.encode_all(
        matrix, artifacts.load_params(spark, path), model_layers.unionByName(others), weights,
        scratch_path(spark, "encoded-all"), excluded=["skipped"],
    )
    return status.select(
        "model", "scaler", "rows", "failed_rows", F.col("error").isNotNull().alias("failed")
    )


_SCALED = """peaks AS (SELECT feature_idx, max(abs(x)) AS s FROM cells GROUP BY feature_idx),
scaled AS (
  SELECT row_id, j, greatest(sum(x / s * w) + any_value(b), 0.0) AS a
  FROM cells JOIN peaks USING (feature_idx) JOIN w1 ON w1.i = feature_idx JOIN b1 USING (j) GROUP BY row_id, j),
levelled AS (SELECT row_id, j, (a - 0.05) / sqrt(0.5 + 0.001) * (1 + j / 10.0) + 0.01 AS h FROM scaled),
outputs AS (
  SELECT row_id, w2.j, greatest(sum(h * w) + any_value((w2.j % 3) / 10.0), 0.0) AS e
  FROM levelled JOIN w2 ON w2.i = levelled.j GROUP BY row_id, w2.j)"""


@query(
    "g07_encode_all_values",
    f"""WITH {fx.CLASS_WEIGHTS}, {_SCALED}, factors AS (
  SELECT * FROM (VALUES ('class_means', 1.0), ('doubled', 2.0), ('halved', 0.5)) v(model, f))
SELECT model, row_id, CAST(j AS INTEGER) AS unit, round(e * f, 5) + 0.0 AS value FROM outputs CROSS JOIN factors""",
)
def g07_values(spark, sf_dir):
    """Three models of one scaler, fed by one pass; their encodings as they were written."""
    model_layers, weights = fx.class_model(spark, sf_dir)
    last = F.col("layer_idx") == 4
    for name, factor in (("doubled", 2.0), ("halved", 0.5)):
        of_class = F.col("model") == fx.CLASS_MODEL
        changed = F.when(last, F.transform("w", lambda x: x * factor)).otherwise(F.col("w"))  # noqa: B023
        copied = weights.filter(of_class).withColumn("w", changed).withColumn("model", F.lit(name))
        weights = weights.unionByName(copied)
        model_layers = model_layers.unionByName(model_layers.filter(of_class).withColumn("model", F.lit(name)))
    matrix = fx.matrix(spark, sf_dir)
    params = materialize(scalers.named(scalers.fit(matrix, "maxabs"), "shared"), "params")
    status = encoding.encode_all(
        matrix, params, model_layers, weights, scratch_path(spark, "encoded-all"), default="shared", named=False
    )
    parts = [
        spark.read.parquet(r["output"]).select(F.lit(r["model"]).alias("model"), "row_id", F.posexplode("encoded").alias("unit", "value"))
        for r in status.collect()
    ]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return found.withColumn("value", F.round("value", 5) + 0.0)


# --- layer tables ---------------------------------------------------------

_BOTTLENECK = """dense AS (SELECT * FROM layers WHERE lower(name) LIKE '%dense%'),
narrow AS (SELECT model, arg_min({'i': layer_idx, 'u': units}, {'u': units, 'i': layer_idx}) AS b
           FROM dense GROUP BY model),
counts AS (SELECT model, count(*) AS n FROM layers GROUP BY model)"""


@query(
    "g08_bottleneck",
    f"""WITH {fx.PART_LAYERS}, {_BOTTLENECK}
SELECT c.model, b.i AS layer_idx, b.u AS units FROM counts c LEFT JOIN narrow USING (model)""",
)
def g08(spark, sf_dir):
    return layers.detect_bottleneck(fx.part_layers(spark, sf_dir))


@query(
    "g09_bottleneck_or_middle",
    f"""WITH {fx.PART_LAYERS}, {_BOTTLENECK}, picked AS (
  SELECT c.model, coalesce(b.i, CAST(n // 2 AS INTEGER)) AS layer_idx, b IS NULL AS fallback
  FROM counts c LEFT JOIN narrow USING (model))
SELECT model, layer_idx, fallback, units FROM picked JOIN layers USING (model, layer_idx)""",
)
def g09(spark, sf_dir):
    return layers.bottleneck_or_middle(fx.part_layers(spark, sf_dir))


@query(
    "g10_model_widths",
    f"""WITH {fx.PART_LAYERS} SELECT model, arg_min(units, layer_idx) AS input_width,
       arg_max(units, layer_idx) AS output_width, count(*) FILTER (WHERE kind = 'dense') AS dense_layers
FROM layers GROUP BY model""",
)
def g10(spark, sf_dir):
    return layers.widths(fx.part_layers(spark, sf_dir))


@query(
    "g10_dense_layers",
    f"WITH {fx.PART_LAYERS} SELECT model, layer_idx, name, units FROM layers WHERE kind = 'dense'",
)
def g10_dense(spark, sf_dir):
    return layers.dense_layers(fx.part_layers(spark, sf_dir))


@query(
    "g10_layer_with_units",
    f"""WITH {fx.PART_LAYERS} SELECT model, max(layer_idx) FILTER (WHERE kind = 'dense' AND units = 25) AS layer_idx,
       arg_max(name, layer_idx) FILTER (WHERE kind = 'dense' AND units = 25) AS name
FROM layers GROUP BY model""",
)
def g10_units(spark, sf_dir):
    return layers.layer_with_units(fx.part_layers(spark, sf_dir), 25)


@query(
    "g11_validation_split",
    """SELECT vec_id AS row_id, vec_id >= (SELECT vec_id FROM embeddings ORDER BY vec_id
  OFFSET (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM embeddings) LIMIT 1) AS is_validation
FROM embeddings""",
)
def g11(spark, sf_dir):
    return training.split_by_order(fx.matrix(spark, sf_dir), "row_id").select("row_id", "is_validation")


@query("g11_hash_split")
def g11_hash(spark, sf_dir):
    return training.split(fx.matrix(spark, sf_dir)).groupBy("is_validation").agg(F.count("*").alias("rows"))
