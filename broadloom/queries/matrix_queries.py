"""Sources, projections and schema operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadloom.operators import matrix as m
from broadloom.operators import network, scalers, trials
from broadloom.plans import encoding
from broadloom.queries import fixtures as fx
from broadloom.queries.registry import query
from broadloom.session import scratch_path
from broadloom.sources import artifacts, sinks, tables


def _cells(matrix, *keys):
    return m.to_long(matrix, keys or ("row_id",))


def _csv(spark, sf_dir):
    """The matrix with two holes per row, written as a CSV file with a header."""
    path = scratch_path(spark, "features") + ".csv"
    wide = m.name_columns(fx.matrix_with_nulls(spark, sf_dir), "features", 64, "f")
    wide.write.option("header", True).csv(path)
    return path


@query(
    "a01_feature_table_scan",
    f"WITH {fx.NULL_CELLS} SELECT row_id, CAST(label AS VARCHAR) AS \"Label\", "
    "CAST(feature_idx AS INTEGER) AS feature_idx, x AS value FROM nulled",
)
def a01(spark, sf_dir):
    matrix, _ = tables.read_feature_csv(spark, _csv(spark, sf_dir), ["Label"], keep=["row_id"])
    return _cells(matrix.withColumn("row_id", F.col("row_id").cast("long")), "row_id", "Label")


@query(
    "a01_columnar_csv_scan",
    "SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type, p_size, "
    "p_retailprice FROM part",
)
def a01_columnar(spark, sf_dir):
    path = scratch_path(spark, "part") + ".csv"
    fx.table(spark, sf_dir, "part").write.option("header", True).csv(path)
    return tables.read_table(spark, path)


@query(
    "a02_header_scan",
    "SELECT column_name, CAST(row_number() OVER () - 1 AS INTEGER) AS column_idx, "
    "(SELECT count(*) FROM lineitem) AS table_rows FROM (DESCRIBE lineitem)",
)
def a02(spark, sf_dir):
    path = f"{sf_dir}/lineitem.parquet"
    names = tables.read_header(spark, path)
    listed = F.posexplode(F.array(*[F.lit(n) for n in names])).alias("column_idx", "column_name")
    counted = spark.read.parquet(path).agg(F.count("*").alias("table_rows"))
    return counted.select("table_rows", listed)


@query(
    "a03_prefix_schema",
    f"""WITH {fx.NULL_CELLS} SELECT CAST(feature_idx AS INTEGER) AS feature_idx, 'f' || feature_idx AS feature_name,
       'double' AS dtype, 'double' AS prefix_dtype FROM nulled GROUP BY feature_idx HAVING count(x) > 0""",
)
def a03(spark, sf_dir):
    path = _csv(spark, sf_dir)
    guessed = tables.sample_schema(spark, path)
    text, names = tables.read_text_matrix(spark, path, ["Label"], ["row_id"])
    types = spark.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in guessed.fields],
        "feature_name string, prefix_dtype string",
    )
    return tables.infer_feature_types(text, names).join(types, "feature_name")


@query(
    "a04_projected_scan",
    "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders",
)
def a04(spark, sf_dir):
    wanted = ["o_orderstatus", "o_totalprice", "o_orderkey"]
    return tables.read_columns(spark, f"{sf_dir}/orders.parquet", wanted)


@query(
    "a05_trial_scan",
    f"WITH {fx.REFINED} SELECT trial_id, mse, learning_rate, 'refined' AS source, "
    "CAST(len(layer_config) AS INTEGER) AS layers FROM refined",
)
def a05(spark, sf_dir):
    path = scratch_path(spark, "refined")
    sinks.append_trials(fx.refined_table(spark, sf_dir), path)
    original = tables.read_trials(spark, scratch_path(spark, "absent"), required=False)
    combined = trials.combine(tables.read_trials(spark, path), original)
    return combined.select(
        "trial_id", "mse", "learning_rate", "source", F.size("layer_config").alias("layers")
    )


@query(
    "a06_scaler_store",
    f"""WITH {fx.LINE_CELLS}
SELECT 'standard' AS scaler, CAST(feature_idx AS INTEGER) AS feature_idx,
       round(avg(x), 6) AS center, round(stddev_pop(x), 6) AS scale
FROM line_cells GROUP BY feature_idx
UNION ALL
SELECT 'minmax', feature_idx, round(min(x), 6), round(max(x) - min(x), 6)
FROM line_cells GROUP BY feature_idx""",
)
def a06(spark, sf_dir):
    path = scratch_path(spark, "params")
    artifacts.save_params(scalers.fit(fx.line_matrix(spark, sf_dir), ["standard", "minmax"]), path)
    return artifacts.load_params(spark, path).select(
        "scaler", "feature_idx", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale")
    )


@query(
    "a07_model_load",
    f"""WITH {fx.CLASS_WEIGHTS}
SELECT 1 AS layer_idx, CAST(i AS INTEGER) AS row_idx, CAST(j AS INTEGER) AS unit,
       round(w, 9) AS w FROM w1
UNION ALL SELECT 4, i, j, round(w, 9) FROM w2""",
)
def a07(spark, sf_dir):
    path = scratch_path(spark, "model")
    artifacts.save_model(*fx.class_model(spark, sf_dir), path)
    _, weights = artifacts.load_model(spark, path)
    return weights.filter("part = 'kernel'").select(
        "layer_idx", "row_idx", F.posexplode("w").alias("unit", "w")
    ).withColumn("w", F.round("w", 9))


@query(
    "a09_trial_append",
    f"WITH {fx.REFINED} SELECT source, count(*) AS trials, round(sum(mse), 8) AS total_mse "
    "FROM combined GROUP BY source",
)
def a09(spark, sf_dir):
    path = scratch_path(spark, "trials")
    combined = fx.combined_table(spark, sf_dir)
    sinks.append_trials(combined.filter("source = 'original'"), path)
    sinks.append_trials(combined.filter("source = 'refined'"), path)
    stored = tables.read_trials(spark, path)
    return stored.groupBy("source").agg(
        F.count("*").alias("trials"), F.round(F.sum("mse"), 8).alias("total_mse")
    )


@query(
    "a09_trial_append_once",
    f"WITH {fx.REFINED} SELECT source, count(*) AS trials, round(sum(mse), 8) AS total_mse "
    "FROM combined GROUP BY source",
)
def a09_once(spark, sf_dir):
    """Jobs that are repeated, as after a lost task of a grid, add their rows once."""
    path = scratch_path(spark, "trials")
    combined = fx.combined_table(spark, sf_dir)
    for source in ("original", "refined", "original", "refined"):
        sinks.append_trials(combined.filter(F.col("source") == source), path, job=source)
    stored = tables.read_trials(spark, path)
    return stored.groupBy("source").agg(
        F.count("*").alias("trials"), F.round(F.sum("mse"), 8).alias("total_mse")
    )


@query(
    "a11_encoded_sink",
    f"""WITH {fx.CLASS_WEIGHTS}
SELECT CAST(row_id AS INTEGER) AS row_id,
       round(max(e) FILTER (WHERE j = 0), 6) AS encoded_0, round(max(e) FILTER (WHERE j = 1), 6) AS encoded_1,
       round(max(e) FILTER (WHERE j = 2), 6) AS encoded_2, round(max(e) FILTER (WHERE j = 3), 6) AS encoded_3
FROM coded GROUP BY row_id""",
)
def a11(spark, sf_dir):
    path = scratch_path(spark, "encoded") + ".csv"
    layers, weights = fx.class_model(spark, sf_dir)
    stages = network.load_stages(layers, weights, fx.CLASS_MODEL)
    encoded = network.encode(fx.matrix(spark, sf_dir), stages).select("row_id", "encoded")
    sinks.write_encoded(encoded, path, width=4)
    stored = tables.read_table(spark, path)
    return stored.select("row_id", *[F.round(f"encoded_{i}", 6).alias(f"encoded_{i}") for i in range(4)])


# --- projections ----------------------------------------------------------


@query(
    "b01_metadata_split",
    """SELECT c_custkey, c_mktsegment, c_name, u.feature_idx,
       CASE u.feature_idx WHEN 0 THEN CAST(c_nationkey AS DOUBLE) ELSE c_acctbal END AS value
FROM customer CROSS JOIN (SELECT * FROM (VALUES (0), (1)) v(feature_idx)) u""",
)
def b01(spark, sf_dir):
    meta = ["c_mktsegment", "not_there", "c_name"]
    matrix = m.to_matrix(fx.table(spark, sf_dir, "customer"), meta, keep=["c_custkey"])
    return _cells(matrix, "c_custkey", "c_mktsegment", "c_name")


@query(
    "b02_float64_features",
    f"""WITH {fx.LINE_CELLS}, names AS (SELECT * FROM (VALUES (0, 'l_quantity'),
  (1, 'l_extendedprice'), (2, 'l_discount'), (3, 'l_tax')) v(feature_idx, feature_name))
SELECT CAST(feature_idx AS INTEGER) AS feature_idx, feature_name, count(x) AS n,
       round(sum(x), 2) AS total
FROM line_cells JOIN names USING (feature_idx) GROUP BY feature_idx, feature_name""",
)
def b02(spark, sf_dir):
    line = fx.table(spark, sf_dir, "lineitem")
    index = m.feature_index(spark, line.schema, fx.LINE_META, "float64_only", fx.LINE_SKIP)
    sums = _cells(fx.line_matrix(spark, sf_dir), "l_returnflag").groupBy("feature_idx").agg(
        F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )
    return index.join(sums, "feature_idx").select("feature_idx", "feature_name", "n", "total")


@query(
    "b03_excluded_feature",
    """SELECT 0 AS feature_idx, round(avg(p_size), 8) AS mean FROM part
UNION ALL SELECT 1, round(avg(p_partkey), 8) FROM part""",
)
def b03(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type", "p_size", "p_retailprice", "p_partkey")
    matrix = m.to_matrix(part, ["p_name", "p_brand", "p_type"], exclude=["p_retailprice"])
    return m.to_long(matrix).groupBy("feature_idx").agg(F.round(F.avg("value"), 8).alias("mean"))


@query(
    "b04_null_fill",
    f"WITH {fx.NULL_CELLS} SELECT row_id, CAST(feature_idx AS INTEGER) AS feature_idx, "
    "coalesce(x, 0.0) AS value FROM nulled",
)
def b04(spark, sf_dir):
    return _cells(m.fill_nulls(fx.matrix_with_nulls(spark, sf_dir), "zero"))


@query(
    "b05_float32_cast",
    "SELECT o_orderkey, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS value FROM orders",
)
def b05(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    matrix = m.as_float64(m.as_float32(m.to_matrix(orders, (), keep=["o_orderkey"])))
    return _cells(matrix, "o_orderkey").select("o_orderkey", "value")


@query(
    "b06_clip",
    f"WITH {fx.CELLS} SELECT row_id, CAST(feature_idx AS INTEGER) AS feature_idx, "
    "greatest(-0.1, least(x, 0.1)) AS value FROM cells",
)
def b06(spark, sf_dir):
    return _cells(m.clip(fx.matrix(spark, sf_dir), -0.1, 0.1))


@query(
    "b07_assemble",
    """SELECT s_suppkey, 0 AS feature_idx, s_acctbal AS value FROM supplier
UNION ALL SELECT s_suppkey, 1, CAST(s_nationkey AS DOUBLE) FROM supplier""",
)
def b07(spark, sf_dir):
    supplier = fx.table(spark, sf_dir, "supplier").select("s_acctbal", "s_suppkey", "s_name", "s_nationkey")
    return _cells(m.to_matrix(supplier, ["s_name"], keep=["s_suppkey"]), "s_suppkey")


# Column j of the wide table is feature j % 64 times a power of two.
WIDE = 2500
WIDE_SQL = f"""wide AS (
  SELECT row_id, j AS feature_idx, x * pow(2, (j // 64) % 8) AS x
  FROM cells JOIN (SELECT unnest(range(0, {WIDE})) AS j) ON feature_idx = j % 64)"""


def wide_table(spark, sf_dir):
    """One column per feature, far more than one generated method can hold."""
    columns = [f"double(embedding[{j % 64}]) * {2 ** (j // 64 % 8)}.0D as f{j}" for j in range(WIDE)]
    return fx.table(spark, sf_dir, "embeddings").selectExpr("vec_id as row_id", "string(label) as Label", *columns)


@query(
    "b07_assemble_wide",
    f"""WITH {fx.CELLS}, {WIDE_SQL}
SELECT CAST(feature_idx AS INTEGER) AS feature_idx, count(*) AS rows, round(sum(x), 5) + 0.0 AS total
FROM wide GROUP BY feature_idx""",
)
def b07_wide(spark, sf_dir):
    cells = m.to_long(m.to_matrix(wide_table(spark, sf_dir), keep=["row_id"]))
    return cells.groupBy("feature_idx").agg(
        F.count("*").alias("rows"), (F.round(F.sum("value"), 5) + 0.0).alias("total")
    )


@query(
    "a11_named_outputs_wide",
    f"""WITH {fx.CELLS}
SELECT CAST(unit AS INTEGER) AS unit, count(*) AS rows, round(sum(x), 6) + 0.0 AS total
FROM cells JOIN (SELECT unnest(range(0, 1024)) AS unit) ON feature_idx = unit % 64 GROUP BY unit""",
)
def a11_wide(spark, sf_dir):
    """1,024 named outputs, written and read again."""
    path = scratch_path(spark, "encoded-wide")
    matrix = fx.matrix(spark, sf_dir)
    encoded = matrix.select("row_id", F.flatten(F.array_repeat("features", 16)).alias("encoded"))
    sinks.write_encoded(encoded, path, width=1024)
    stored = spark.read.parquet(path)
    named = stored.selectExpr(f"array({', '.join(f'encoded_{i}' for i in range(1024))}) as features")
    return m.to_long(named).groupBy(F.col("feature_idx").alias("unit")).agg(
        F.count("*").alias("rows"), (F.round(F.sum("value"), 6) + 0.0).alias("total")
    )


@query(
    "b08_positional_trim",
    f"WITH {fx.CELLS} SELECT row_id, CAST(feature_idx AS INTEGER) AS feature_idx, x AS value "
    "FROM cells WHERE feature_idx < 10",
)
def b08(spark, sf_dir):
    return _cells(m.trim(fx.matrix(spark, sf_dir), 10, strict=True))


def _encoded(spark, sf_dir):
    layers, weights = fx.class_model(spark, sf_dir)
    return network.encode(
        fx.matrix(spark, sf_dir), network.load_stages(layers, weights, fx.CLASS_MODEL)
    )


@query(
    "b09_attach_encoding",
    f"""WITH {fx.CLASS_WEIGHTS}
SELECT e.row_id, CAST(v.label AS VARCHAR) AS "Label", CAST(j AS INTEGER) AS unit, round(e, 6) AS value
FROM coded e JOIN embeddings v ON v.vec_id = e.row_id""",
)
def b09(spark, sf_dir):
    return _encoded(spark, sf_dir).select(
        "row_id", "Label", F.posexplode("encoded").alias("unit", "value")
    ).withColumn("value", F.round("value", 6))


@query(
    "b10_named_columns",
    f"""WITH {fx.CLASS_WEIGHTS}
SELECT row_id,
       round(max(e) FILTER (WHERE j = 0), 6) AS encoded_0, round(max(e) FILTER (WHERE j = 1), 6) AS encoded_1,
       round(max(e) FILTER (WHERE j = 2), 6) AS encoded_2, round(max(e) FILTER (WHERE j = 3), 6) AS encoded_3
FROM coded GROUP BY row_id""",
)
def b10(spark, sf_dir):
    rounded = F.transform("encoded", lambda x: F.round(x, 6))
    return m.name_columns(_encoded(spark, sf_dir).select("row_id", rounded.alias("encoded")), "encoded", 4)


@query(
    "b11_trial_filter",
    f"WITH {fx.TRIALS} SELECT trial_id, encoding_dim, r2_score FROM timed "
    "WHERE encoding_dim <= 32 AND r2_score > 0.2 ORDER BY encoding_dim, trial_id",
)
def b11(spark, sf_dir):
    kept = trials.acceptable(fx.trial_table(spark, sf_dir), 32, 0.2)
    return kept.select("trial_id", "encoding_dim", "r2_score")


@query(
    "b12_default_settings",
    f"WITH {fx.TRIALS} SELECT trial_id, 0.001::DOUBLE AS learning_rate, "
    "CAST(16 AS INTEGER) AS batch_size, 0.2::DOUBLE AS dropout_rate FROM timed",
)
def b12(spark, sf_dir):
    return trials.with_defaults(fx.trial_table(spark, sf_dir)).select(
        "trial_id", "learning_rate", "batch_size", "dropout_rate"
    )


@query(
    "b13_source_tag",
    f"WITH {fx.REFINED} SELECT source, trial_id, mse FROM combined",
)
def b13(spark, sf_dir):
    return fx.combined_table(spark, sf_dir).select("source", "trial_id", "mse")


_LIST_TEXT = """texts AS (
  SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN '[]' ELSE
         '[' || o_custkey || ', ' || o_orderkey % 997 || ', ' || o_custkey % 101 || ']' END AS t,
         o_custkey % 5 = 0 AS empty, o_custkey AS a, o_orderkey % 997 AS b, o_custkey % 101 AS c
  FROM orders)"""


def _list_texts(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    numbers = F.concat_ws(", ", "o_custkey", F.col("o_orderkey") % 997, F.col("o_custkey") % 101)
    text = F.when(F.col("o_custkey") % 5 == 0, "[]").otherwise(F.concat(F.lit("["), numbers, F.lit("]")))
    return orders.select("o_orderkey", text.alias("layer_config"))


@query(
    "b14_parse_layer_list",
    f"""WITH {_LIST_TEXT} SELECT o_orderkey, 0 AS position, CAST(a AS INTEGER) AS units FROM texts WHERE NOT empty
UNION ALL SELECT o_orderkey, 1, CAST(b AS INTEGER) FROM texts WHERE NOT empty
UNION ALL SELECT o_orderkey, 2, CAST(c AS INTEGER) FROM texts WHERE NOT empty""",
)
def b14(spark, sf_dir):
    parsed = trials.prepare(_list_texts(spark, sf_dir))
    return parsed.select("o_orderkey", F.posexplode("layer_config").alias("position", "units"))


@query(
    "b15_deepest_layer",
    f"WITH {_LIST_TEXT} SELECT o_orderkey, CAST(CASE WHEN empty THEN 0 ELSE least(a, b, c) END "
    "AS INTEGER) AS deepest_layer FROM texts",
)
def b15(spark, sf_dir):
    return trials.prepare(_list_texts(spark, sf_dir)).select("o_orderkey", "deepest_layer")


@query(
    "b16_model_size",
    f"WITH {fx.TRIALS} SELECT trial_id, encoding_dim * num_layers AS model_size FROM timed",
)
def b16(spark, sf_dir):
    return fx.trial_table(spark, sf_dir).select("trial_id", trials.model_size().alias("model_size"))


@query(
    "b17_exact_config",
    f"WITH {fx.REFINED} SELECT source, trial_id, mse FROM combined "
    "WHERE encoding_dim = 64 AND layer_config = [4096, 2048]",
)
def b17(spark, sf_dir):
    found = trials.select_config(fx.combined_table(spark, sf_dir), 64, [4096, 2048])
    return found.select("source", "trial_id", "mse")


@query(
    "b19_encoding_preview",
    f"""WITH {fx.CLASS_WEIGHTS}
SELECT row_id, CAST(j AS INTEGER) AS unit, round(e, 6) AS value
FROM coded WHERE j < 3 AND row_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 5)""",
)
def b19(spark, sf_dir):
    ordered = _encoded(spark, sf_dir).orderBy("row_id")
    return m.preview(ordered, "encoded", 5, 3).select(
        "row_id", F.posexplode("encoded").alias("unit", "value")
    ).withColumn("value", F.round("value", 6))


def scale_and_encode(spark, sf_dir, **options):
    """The production path on the matrix with holes: fill, scale, encode."""
    layers, weights = fx.class_model(spark, sf_dir)
    holes = fx.matrix_with_nulls(spark, sf_dir)
    params = scalers.fit(m.as_float64(m.as_float32(m.fill_nulls(holes))), "maxabs")
    path = scratch_path(spark, "params")
    artifacts.save_params(params, path)
    return encoding.encode_matrix(
        holes, artifacts.load_params(spark, path), "maxabs", layers, weights, fx.CLASS_MODEL, **options
    )
