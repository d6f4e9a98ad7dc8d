"""Fitting, applying, comparing and resolving scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadloom.functions import numeric as nm
from broadloom.operators import matrix as m
from broadloom.operators import scalers
from broadloom.queries import fixtures as fx
from broadloom.queries.registry import query
from broadloom.session import materialize, scratch_path
from broadloom.sources import artifacts


def _scaled_cells(matrix, kind, places=8, **options):
    params = materialize(scalers.fit(matrix, kind), "params")
    scaled = scalers.transform(matrix, params, kind, **options)
    value = F.round(F.col("value"), places) + 0.0
    return m.to_long(scaled, ["row_id"]).withColumn("value", value)


def _sql(params: str, value: str, source: str = fx.CONST_CELLS, cells: str = "with_const", places=8) -> str:
    return f"""WITH {source}, params AS (
  SELECT feature_idx, {params} FROM {cells} GROUP BY feature_idx)
SELECT row_id, CAST(feature_idx AS INTEGER) AS feature_idx, round({value}, {places}) + 0.0 AS value
FROM {cells} JOIN params USING (feature_idx)"""


STANDARD = ("avg(x) AS c, stddev_pop(x) AS s0", "(x - c) / CASE WHEN s0 < 1e-14 THEN 1.0 ELSE s0 END")
ROBUST = (
    "quantile_cont(x, 0.5) AS c, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS s0",
    STANDARD[1],
)
MAXABS = ("0.0 AS c, max(abs(x)) AS s0", STANDARD[1])
MINMAX = ("min(x) AS c, max(x) - min(x) AS s0", STANDARD[1])


@query("c01_standard_scaler", _sql(*STANDARD))
def c01(spark, sf_dir):
    return _scaled_cells(fx.matrix_with_constant(spark, sf_dir), "standard")


@query("c02_robust_scaler", _sql(*ROBUST))
def c02(spark, sf_dir):
    return _scaled_cells(fx.matrix_with_constant(spark, sf_dir), "robust")


# The likelihood of an exponent is concave, so its slope changes sign once. One level evaluates
# the slope at 17 points and keeps the interval between the last positive and the first other one.
def _slope_level(n: int, low: str, step: float) -> str:
    source = "points" if n == 0 else f"points JOIN low{n - 1} USING (feature_idx)"
    return f"""cand{n} AS (
  SELECT feature_idx, x, {low} + s.s * {step!r} AS lam FROM {source}
  CROSS JOIN (SELECT unnest(range(0, 17)) AS s) s),
bent{n} AS (
  SELECT feature_idx, lam, sign(x) * ln(1 + abs(x)) AS j, {yj_sql('x', 'lam')} AS y,
         {yj_slope_sql('x', 'lam')} AS dy FROM cand{n}),
slope{n} AS (
  SELECT feature_idx, lam, sum(j) - count(*) * covar_pop(y, dy) / var_pop(y) AS slope
  FROM bent{n} GROUP BY feature_idx, lam),
low{n} AS (
  SELECT feature_idx, coalesce(max(lam) FILTER (WHERE slope > 0), min(lam)) AS lam
  FROM slope{n} GROUP BY feature_idx)"""


def yj_slope_sql(x: str, lam: str) -> str:
    """Derivative of the transform by its exponent."""
    log, power = f"ln(1 + abs({x}))", f"CASE WHEN {x} >= 0 THEN {lam} ELSE 2 - ({lam}) END"
    return f"""CASE WHEN abs({power}) < 1e-4
      THEN {log} * {log} * (0.5 + ({power}) * {log} / 3 + ({power}) * ({power}) * {log} * {log} / 8)
      ELSE (exp(({power}) * {log}) * (({power}) * {log} - 1) + 1) / (({power}) * ({power})) END"""


def yj_sql(x: str, lam: str) -> str:
    return f"""CASE WHEN {x} >= 0 THEN
      CASE WHEN abs({lam}) < 1e-9 THEN ln(1 + {x}) ELSE (pow(1 + {x}, {lam}) - 1) / {lam} END
    ELSE CASE WHEN abs(2 - {lam}) < 1e-9 THEN -ln(1 - {x})
      ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END END"""


def exponents_sql(points: str, levels: int = 8, width: float = 3.0) -> str:
    """``lambdas``: the exponents between 1 - width and 1 + width, far beyond five places."""
    step = 2 * width / 16
    ctes = [f"points AS ({points})", _slope_level(0, f"1.0 - {width!r}", step)]
    for n in range(1, levels):
        step /= 16
        ctes.append(_slope_level(n, "lam", step))
    return ", ".join(ctes) + (
        f", lambdas AS (SELECT feature_idx, lam + {step / 2!r} AS lam FROM low{levels - 1})"
    )


@query(
    "c03_power_exponents",
    f"""WITH {fx.LINE_CELLS}, {exponents_sql('SELECT feature_idx, x FROM line_cells')}
SELECT CAST(feature_idx AS INTEGER) AS feature_idx, round(lam, 5) AS lam FROM lambdas""",
)
def c03_line(spark, sf_dir):
    """Few distinct values per feature: repeated cells are collapsed first."""
    fitted = scalers.fit(fx.line_matrix(spark, sf_dir), "power", compress=True)
    return fitted.select("feature_idx", F.round("lambda", 5).alias("lam"))


@query(
    "c03_power_fit",
    f"""WITH {fx.CELLS}, {exponents_sql('SELECT feature_idx, x FROM cells')}
SELECT CAST(feature_idx AS INTEGER) AS feature_idx, round(lam, 5) AS lam FROM lambdas""",
)
def c03_fit(spark, sf_dir):
    fitted = scalers.fit(fx.matrix(spark, sf_dir), "power")
    return fitted.select("feature_idx", F.round("lambda", 5).alias("lam"))


@query(
    "c03_power_transform",
    f"""WITH {fx.CELLS}, bent AS (
  SELECT row_id, feature_idx, {yj_sql('x', 'lam')} AS y
  FROM (SELECT *, feature_idx % 9 / 2.0 - 1 AS lam FROM cells)),
params AS (SELECT feature_idx, avg(y) AS c, stddev_pop(y) AS s FROM bent GROUP BY feature_idx)
SELECT row_id, CAST(feature_idx AS INTEGER) AS feature_idx, round((y - c) / s, 8) + 0.0 AS value
FROM bent JOIN params USING (feature_idx)""",
)
def c03_transform(spark, sf_dir):
    """Exponents -1, -0.5, .., 3 by feature, with both singular ones among them."""
    matrix = fx.matrix(spark, sf_dir)
    lam = F.col("feature_idx") % 9 / 2.0 - 1
    bent = m.to_long(matrix, ["row_id"]).select(
        "feature_idx", lam.alias("lambda"), nm.yeo_johnson(F.col("value"), lam).alias("y")
    )
    params = bent.groupBy("feature_idx").agg(
        F.first("lambda").alias("lambda"), F.avg("y").alias("center"), F.stddev_pop("y").alias("scale")
    ).withColumns(
        {"scaler": F.lit("power"), "kind": F.lit("power"), "quantiles": F.lit(None).cast("array<double>")}
    )
    path = scratch_path(spark, "params")
    artifacts.save_params(params, path)
    scaled = scalers.transform(matrix, artifacts.load_params(spark, path), "power")
    return m.to_long(scaled, ["row_id"]).withColumn("value", F.round("value", 8) + 0.0)


@query("c04_maxabs_scaler", _sql(*MAXABS))
def c04(spark, sf_dir):
    return _scaled_cells(fx.matrix_with_constant(spark, sf_dir), "maxabs")


@query("c05_minmax_scaler", _sql(*MINMAX))
def c05(spark, sf_dir):
    return _scaled_cells(fx.matrix_with_constant(spark, sf_dir), "minmax")


# The quantiles by linear interpolation of the sorted values, then the rank of each cell:
# the middle of a run of equal quantiles, else the share of the way to the next one.
_RANKS = """sorted AS (
  SELECT feature_idx, list_sort(list(x)) AS xs, count(*) AS n, least(count(*), 1000) AS nq
  FROM {cells} GROUP BY feature_idx),
quants AS (
  SELECT feature_idx, nq, list_transform(range(0, nq), lambda s:
    xs[CAST(floor(s * (n - 1) / (nq - 1)) AS BIGINT) + 1]
    + (xs[CAST(ceil(s * (n - 1) / (nq - 1)) AS BIGINT) + 1]
       - xs[CAST(floor(s * (n - 1) / (nq - 1)) AS BIGINT) + 1])
      * (s * (n - 1) / (nq - 1) - floor(s * (n - 1) / (nq - 1)))) AS q
  FROM sorted),
spread AS (
  SELECT feature_idx, unnest(q) AS v, generate_subscripts(q, 1) - 1 AS pos FROM quants),
pieces AS (
  SELECT feature_idx, v, min(pos) AS first_pos, max(pos) AS last_pos FROM spread
  GROUP BY feature_idx, v),
ends AS (SELECT feature_idx, min(v) AS lo, max(v) AS hi FROM pieces GROUP BY feature_idx),
steps AS (
  SELECT *, lead(v) OVER (PARTITION BY feature_idx ORDER BY v) AS next_v,
         lead(first_pos) OVER (PARTITION BY feature_idx ORDER BY v) AS next_pos FROM pieces),
scored AS (
  SELECT c.row_id, c.feature_idx, c.x, e.lo, e.hi, q.nq,
         CASE WHEN c.x = s.v THEN (s.first_pos + s.last_pos) / 2.0 / (q.nq - 1)
              ELSE (s.last_pos + (c.x - s.v) / (s.next_v - s.v)) / (q.nq - 1) END AS rank
  FROM {cells} c ASOF JOIN steps s ON c.feature_idx = s.feature_idx AND c.x >= s.v
  JOIN ends e ON e.feature_idx = c.feature_idx JOIN quants q ON q.feature_idx = c.feature_idx)"""
_UNIFORM = f"WITH {fx.CONST_CELLS}, {_RANKS.format(cells='with_const')}"


@query(
    "c06_quantile_uniform",
    _UNIFORM
    + """ SELECT row_id, CAST(feature_idx AS INTEGER) AS feature_idx,
       round(CASE WHEN x <= lo THEN 0.0 WHEN x >= hi THEN 1.0 ELSE rank END, 7) + 0.0 AS value
FROM scored""",
)
def c06_uniform(spark, sf_dir):
    return _scaled_cells(fx.matrix_with_constant(spark, sf_dir), "quantile", 7, normal=False)


@query(
    "c06_quantile_uniform_joined",
    _UNIFORM
    + """ SELECT row_id, CAST(feature_idx AS INTEGER) AS feature_idx,
       round(CASE WHEN x <= lo THEN 0.0 WHEN x >= hi THEN 1.0 ELSE rank END, 7) + 0.0 AS value
FROM scored""",
)
def c06_joined(spark, sf_dir):
    """The same in feature blocks, as for tables too wide to hold."""
    matrix = fx.matrix_with_constant(spark, sf_dir)
    return _scaled_cells(matrix, "quantile", 7, normal=False, inline_limit=0)


def _poly(coefficients, r: str) -> str:
    text = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {r} + {c!r})"
    return text


def probit_sql(u: str) -> str:
    low, high = nm.PROBIT_MARGIN, 1.0 - nm.PROBIT_MARGIN
    u = f"greatest({low!r}::DOUBLE, least({u}, {high!r}::DOUBLE))"
    q, tail = f"({u} - 0.5)", f"sqrt(-ln(least({u}, 1.0::DOUBLE - {u})))"
    central = f"(0.180625::DOUBLE - {q} * {q})"
    mid, far = f"({tail} - 1.6)", f"({tail} - 5.0)"
    return f"""CASE WHEN abs({q}) <= 0.425 THEN
      {q} * {_poly(nm._CENTRAL_NUM, central)} / {_poly(nm._CENTRAL_DEN, central)}
    WHEN {tail} <= 5.0 THEN sign({q}) * {_poly(nm._MIDDLE_NUM, mid)} / {_poly(nm._MIDDLE_DEN, mid)}
    ELSE sign({q}) * {_poly(nm._TAIL_NUM, far)} / {_poly(nm._TAIL_DEN, far)} END"""


_SCORES = """scores AS (
  SELECT row_id, feature_idx, CASE WHEN x - 1e-7 < lo THEN 0.0::DOUBLE
         WHEN x + 1e-7 > hi THEN 1.0::DOUBLE ELSE rank::DOUBLE END AS u FROM scored)"""


def scores_sql(cells: str) -> str:
    """CTEs up to ``scores(row_id, feature_idx, u)`` for the cells of one CTE."""
    return f"{_RANKS.format(cells=cells)}, {_SCORES}"


@query(
    "c06_quantile_normal",
    _UNIFORM
    + f""", {_SCORES}
SELECT row_id, CAST(feature_idx AS INTEGER) AS feature_idx, round({probit_sql('u')}, 6) + 0.0 AS value
FROM scores""",
)
def c06_normal(spark, sf_dir):
    return _scaled_cells(fx.matrix_with_constant(spark, sf_dir), "quantile", 6)


@query("c07_minmax_scale_function", _sql(*MINMAX))
def c07(spark, sf_dir):
    return _scaled_cells(fx.matrix_with_constant(spark, sf_dir), "minmax_scale")


@query(
    "c08_scaler_comparison",
    f"""WITH {fx.LINE_CELLS}, params AS (
  SELECT feature_idx, avg(x) AS m, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi,
         max(abs(x)) AS ma, quantile_cont(x, 0.5) AS q2,
         quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr
  FROM line_cells GROUP BY feature_idx),
scaled AS (
  SELECT 'standard' AS scaler, feature_idx, (x - m) / sd AS z FROM line_cells JOIN params USING (feature_idx)
  UNION ALL SELECT 'robust', feature_idx, (x - q2) / iqr FROM line_cells JOIN params USING (feature_idx)
  UNION ALL SELECT 'maxabs', feature_idx, x / ma FROM line_cells JOIN params USING (feature_idx)
  UNION ALL SELECT 'minmax', feature_idx, (x - lo) / (hi - lo) FROM line_cells JOIN params USING (feature_idx)
  UNION ALL SELECT 'minmax_scale', feature_idx, (x - lo) / (hi - lo) FROM line_cells JOIN params USING (feature_idx)),
stats AS (
  SELECT scaler, feature_idx, max(z) - min(z) AS range, avg(z) AS mean, stddev_pop(z) AS std
  FROM scaled GROUP BY scaler, feature_idx)
SELECT scaler, 'range' AS stat, CAST(feature_idx AS INTEGER) AS feature_idx, round(range, 8) + 0.0 AS value FROM stats
UNION ALL SELECT scaler, 'mean', feature_idx, round(mean, 8) + 0.0 FROM stats
UNION ALL SELECT scaler, 'std', feature_idx, round(std, 8) + 0.0 FROM stats
UNION ALL SELECT 'no_such_scaler', 'error', NULL, NULL""",
)
def c08(spark, sf_dir):
    """Five scalers and one that fails: the failure is a row, the rest is complete."""
    kinds = [*scalers.LINEAR, "no_such_scaler"]
    stats, status = scalers.compare(fx.line_matrix(spark, sf_dir), kinds)
    failed = status.filter("error is not null").select(
        "scaler", F.lit("error").alias("stat"), F.lit(None).cast("int").alias("feature_idx"),
        F.lit(None).cast("double").alias("value"),
    )
    return stats.withColumn("value", F.round("value", 8) + 0.0).unionByName(failed)


@query(
    "c09_apply_stored_scaler",
    f"""WITH {fx.NULL_CELLS}, params AS (
  SELECT feature_idx, quantile_cont(x, 0.5) AS c, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS s
  FROM cells GROUP BY feature_idx)
SELECT row_id, CAST(feature_idx AS INTEGER) AS feature_idx, round((coalesce(x, 0.0) - c) / s, 8) + 0.0 AS value
FROM nulled JOIN params USING (feature_idx)""",
)
def c09(spark, sf_dir):
    """Fitted on one table, stored under a name, applied to another table."""
    path = scratch_path(spark, "params")
    artifacts.save_params(
        scalers.named(scalers.fit(fx.matrix(spark, sf_dir), "robust"), "robustscaler_tuned"), path
    )
    other = m.fill_nulls(fx.matrix_with_nulls(spark, sf_dir))
    scaled = scalers.transform(other, artifacts.load_params(spark, path), "robustscaler_tuned")
    return m.to_long(scaled, ["row_id"]).withColumn("value", F.round("value", 8) + 0.0)


_RESOLVE = """models AS (SELECT DISTINCT 'm' || c_nationkey AS model FROM customer),
available AS (
  SELECT DISTINCT CASE WHEN s_nationkey % 2 = 0 THEN 'm' || s_nationkey
                       ELSE 'm' || s_nationkey || '_tuned' END AS scaler FROM supplier),
explicit AS (
  SELECT 'm' || n_nationkey AS model, 'm' || (n_nationkey + 1) || '_tuned' AS scaler
  FROM nation)"""


@query(
    "c10_scaler_resolution",
    f"""WITH {_RESOLVE}, candidates AS (
  SELECT m.model, e.scaler, 0 AS p FROM models m JOIN explicit e USING (model)
  UNION ALL SELECT model, model, 1 FROM models UNION ALL SELECT model, model || '_tuned', 2 FROM models
  UNION ALL SELECT model, 'm2', 3 FROM models)
SELECT m.model, arg_min(c.scaler, c.p) AS scaler
FROM models m LEFT JOIN (SELECT * FROM candidates WHERE scaler IN (SELECT scaler FROM available)) c USING (model)
GROUP BY m.model""",
)
def c10(spark, sf_dir):
    name = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))
    models = fx.table(spark, sf_dir, "customer").select(name("c_nationkey").alias("model"))
    stored = F.when(F.col("s_nationkey") % 2 == 0, name("s_nationkey")).otherwise(
        F.concat(name("s_nationkey"), F.lit("_tuned"))
    )
    available = fx.table(spark, sf_dir, "supplier").select(stored.alias("scaler"))
    explicit = fx.table(spark, sf_dir, "nation").select(
        name("n_nationkey").alias("model"),
        F.concat(F.lit("m"), (F.col("n_nationkey") + 1).cast("string"), F.lit("_tuned")).alias("scaler"),
    )
    return scalers.resolve(models, available, explicit, "m2")


@query(
    "c11_scaler_inspection",
    """SELECT 'standard' AS scaler, 'standard' AS kind, 4::BIGINT AS n_features, 4::BIGINT AS n_scale,
       4::BIGINT AS n_center, 0::BIGINT AS n_lambda, true AS found
UNION ALL SELECT 'maxabs', 'maxabs', 4, 4, 4, 0, true
UNION ALL SELECT 'absent', NULL, NULL, NULL, NULL, NULL, false""",
)
def c11(spark, sf_dir):
    params = scalers.fit(fx.line_matrix(spark, sf_dir), ["standard", "maxabs"])
    wanted = spark.createDataFrame([("standard",), ("maxabs",), ("absent",)], "scaler string")
    return scalers.describe(params, wanted)


@query(
    "c12_fit_all_linear",
    f"""WITH {fx.LINE_CELLS}, p AS (
  SELECT feature_idx, avg(x) AS m, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi, max(abs(x)) AS ma,
         quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr
  FROM line_cells GROUP BY feature_idx),
u AS (
  SELECT 'standard' AS scaler, feature_idx, m AS center, sd AS scale FROM p
  UNION ALL SELECT 'robust', feature_idx, q2, iqr FROM p
  UNION ALL SELECT 'maxabs', feature_idx, 0.0, ma FROM p
  UNION ALL SELECT 'minmax', feature_idx, lo, hi - lo FROM p)
SELECT scaler, CAST(feature_idx AS INTEGER) AS feature_idx, round(center, 6) AS center,
       round(scale, 6) AS scale FROM u""",
)
def c12(spark, sf_dir):
    """All linear scalers from one scan, on the largest table."""
    params = scalers.fit(fx.line_matrix(spark, sf_dir), ["standard", "robust", "maxabs", "minmax"])
    return params.select(
        "scaler", "feature_idx", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale")
    )
