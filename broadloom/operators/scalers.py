"""Feature scalers: ``fit`` gives a parameter table, ``transform`` applies it.

``params(scaler, kind, feature_idx, center, scale, lambda, quantiles)`` has one row
per scaler and feature. Fitting groups the long form by feature; applying is
row-local and never refits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.functions.numeric import (
    finite_or_null,
    rank_scores,
    safe_scale,
    yeo_johnson,
    yeo_johnson_cells,
)
from broadloom.operators.blocks import map_cells
from broadloom.operators.held import hold, opened
from broadloom.operators.matrix import to_long
from broadloom.operators.power import EPS, fit_exponents
from broadloom.operators.quantiles import GROUP_LIMIT, quantiles, references
from broadloom.operators.stats import moments, value_counts, weighted_moments
from broadloom.session import materialize, small_side

# Scaler kinds in the order they are compared.
KINDS = ("standard", "robust", "power", "maxabs", "minmax", "quantile", "minmax_scale")
LINEAR = ("standard", "robust", "maxabs", "minmax", "minmax_scale")

PARAMS_SCHEMA = (
    "scaler string, kind string, feature_idx int, center double, scale double, "
    "lambda double, quantiles array<double>"
)

# Fixed value: most quantiles kept per feature.
MAX_QUANTILES = 1000
# Parameters up to this many doubles are constants of the plan (about half a megabyte of text).
CONSTANT_LIMIT = 30_000
# Larger ones are held by every worker up to this many doubles (32 MB), and mapped from a file above.
INLINE_LIMIT = 4_000_000


def _check(kinds: Sequence[str]) -> None:
    unknown = [k for k in kinds if k not in KINDS]
    if unknown:
        raise ValueError(f"unknown scalers {unknown}; choose from {KINDS}")


def _row(kind: str, center: Column, scale: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("scaler"),
        F.lit(kind).alias("kind"),
        center.cast("double").alias("center"),
        safe_scale(scale).alias("scale"),
        F.lit(None).cast("double").alias("lambda"),
        F.lit(None).cast("array<double>").alias("quantiles"),
    )


def _linear_rows(kinds: Sequence[str]) -> list[Column]:
    mean, var, lo, hi = (F.col(c) for c in ("mean", "var", "vmin", "vmax"))
    # Rounding noise around a constant is not spread.
    flat = var <= F.col("n") * EPS * var + (F.col("n") * mean * EPS) ** 2
    quart = [F.get("q", F.lit(i)) for i in range(3)]
    made = {
        "standard": lambda: (mean, F.when(flat, 0.0).otherwise(F.sqrt(var))),
        "robust": lambda: (quart[1], quart[2] - quart[0]),
        "maxabs": lambda: (F.lit(0.0), F.col("max_abs")),
        "minmax": lambda: (lo, hi - lo),
        "minmax_scale": lambda: (lo, hi - lo),
    }
    return [_row(kind, *made[kind]()) for kind in kinds]


def linear_stats(
    cells: DataFrame, kinds: Sequence[str], rows: int | None, group_limit: int
) -> DataFrame:
    """Moments per feature, with the quartiles ``q`` where a scaler needs them.

    ``cells`` is the long form, or value counts with a column ``w``.
    """
    weighted = "w" in cells.columns
    stats = weighted_moments(cells) if weighted else moments(cells)
    if "robust" not in kinds:
        return stats
    return stats.join(_quantiles(cells, [0.25, 0.5, 0.75], rows, group_limit), "feature_idx")


def _quantiles(
    cells: DataFrame, levels: Sequence[float], rows: int | None, group_limit: int
) -> DataFrame:
    weight = "w" if "w" in cells.columns else None
    return quantiles(
        cells, "value", levels, ["feature_idx"],
        # Of value counts the distinct values matter, which the function counts itself.
        max_group=None if weight else rows, group_limit=group_limit, weight=weight,
    )


def _cells(matrix: DataFrame, compress: bool) -> DataFrame:
    """The long form, or with ``compress`` its stored value counts; infinite cells fail the fit."""
    long = to_long(matrix)
    name = F.concat(F.lit("infinite value in feature "), F.col("feature_idx").cast("string"))
    endless = F.abs("value") == float("inf")
    long = long.withColumn("value", F.when(endless, F.raise_error(name)).otherwise(F.col("value")))
    return materialize(value_counts(long), "value-counts") if compress else long


def fit(
    matrix: DataFrame,
    kinds: str | Sequence[str],
    *,
    rows: int | None = None,
    group_limit: int = GROUP_LIMIT,
    compress: bool = False,
    max_quantiles: int = MAX_QUANTILES,
) -> DataFrame:
    """Fit one or several scalers; missing cells are skipped.

    ``rows`` is the row count where known. ``compress`` first stores how often each
    feature has each value and fits from that: one scan in all, and little else to read
    where values repeat, as in counts. The linear kinds share a scan; ``power`` runs a
    few rounds and cuts its lineage between them.
    """
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    _check(kinds)
    if rows is None and ("robust" in kinds or "quantile" in kinds):
        rows = matrix.count()
    cells = _cells(matrix, compress)
    parts = []
    linear = [k for k in kinds if k in LINEAR]
    if linear:
        stats = linear_stats(cells, linear, rows, group_limit)
        parts.append(stats.select("feature_idx", F.inline(F.array(*_linear_rows(linear)))))
    if "power" in kinds:
        parts.append(_fit_power(cells))
    if "quantile" in kinds:
        parts.append(_fit_quantile(cells, rows, group_limit, max_quantiles))
    columns = [c.split()[0] for c in PARAMS_SCHEMA.split(", ")]
    result = parts[0].select(*columns)
    for part in parts[1:]:
        result = result.unionByName(part.select(*columns))
    return result


def _weighted(cells: DataFrame) -> DataFrame:
    """Cells without nulls and with a weight of one where they are not counted yet."""
    if "w" in cells.columns:
        return cells
    return (
        cells.select("feature_idx", finite_or_null(F.col("value")).alias("value"))
        .filter("value is not null")
        .withColumn("w", F.lit(1).cast("long"))
    )


def _fit_power(cells: DataFrame) -> DataFrame:
    fitted = fit_exponents(_weighted(cells))
    return fitted.select(
        F.lit("power").alias("scaler"),
        F.lit("power").alias("kind"),
        "feature_idx",
        "center",
        safe_scale(F.col("scale")).alias("scale"),
        "lambda",
        F.lit(None).cast("array<double>").alias("quantiles"),
    )


def _fit_quantile(
    cells: DataFrame, rows: int, group_limit: int, max_quantiles: int = MAX_QUANTILES
) -> DataFrame:
    levels = references(max(1, min(max_quantiles, rows)))
    found = _quantiles(cells, levels, rows, group_limit)
    return found.select(
        F.lit("quantile").alias("scaler"),
        F.lit("quantile").alias("kind"),
        "feature_idx",
        F.lit(0.0).alias("center"),
        F.lit(1.0).alias("scale"),
        F.lit(None).cast("double").alias("lambda"),
        F.col("q").alias("quantiles"),
    )


# --- applying -------------------------------------------------------------


def apply_value(kind: str, x: Column, center: Column, scale: Column, lam: Column) -> Column:
    """One scaled cell, for every kind but ``quantile``."""
    if kind == "power":
        return (yeo_johnson(x, lam) - center) / scale
    return (x - center) / scale


def kind_of(params: DataFrame, scaler: str) -> str | None:
    """The kind of a stored scaler, or None when it is not stored."""
    found = params.filter(F.col("scaler") == scaler).select("kind").first()
    return None if found is None else found["kind"]


def transform(
    matrix: DataFrame,
    params: DataFrame,
    scaler: str,
    *,
    on_missing: str = "raise",
    normal: bool = True,
    inline_limit: int = INLINE_LIMIT,
) -> DataFrame:
    """Apply a stored scaler to the feature array, row by row.

    ``params`` should be a stored table (it is read once for its size). Up to ``CONSTANT_LIMIT``
    doubles the parameters of linear and power scalers are constants of a projection; above it, and
    for quantile scalers, blocks of rows meet them as arrays that workers hold, or above
    ``inline_limit`` doubles map from a file. The result is the same, and no row carries them. Cells
    of a feature whose fit found no value become null. A scaler that is not stored raises, or
    leaves the data unscaled with ``on_missing="identity"``.
    """
    if on_missing not in ("raise", "identity"):
        raise ValueError(f"unknown on_missing {on_missing!r}")
    kind = kind_of(params, scaler)
    if kind is None:
        if on_missing == "identity":
            return matrix
        raise LookupError(f"no stored scaler named {scaler!r}")
    mine = params.filter(F.col("scaler") == scaler)
    if kind == "quantile" or 3 * mine.count() > min(CONSTANT_LIMIT, inline_limit):
        return _transform_blocks(matrix, mine, kind, normal, inline_limit)
    rows = {r["feature_idx"]: r for r in mine.select("feature_idx", "center", "scale", "lambda").collect()}

    def constant(name: str) -> Column:
        values = [rows[i][name] if i in rows else None for i in range(max(rows, default=-1) + 1)]
        written = ",".join("" if v is None else repr(v) for v in values)
        return F.split(F.lit(written), ",").try_cast("array<double>")

    center, scale, lam = (constant(name) for name in ("center", "scale", "lambda"))
    scaled = F.transform(
        "features",
        lambda x, i: apply_value(kind, x, F.get(center, i), F.get(scale, i), F.get(lam, i)),
    )
    return matrix.withColumn("features", scaled)


def transform_long(long: DataFrame, params: DataFrame, kind: str) -> DataFrame:
    """Scale ``value`` of the long form by a join on the feature; not for ``quantile``."""
    narrow = params.select("feature_idx", "center", "scale", "lambda")
    joined = long.join(small_side(narrow, narrow.count()), "feature_idx")
    scaled = apply_value(kind, F.col("value"), F.col("center"), F.col("scale"), F.col("lambda"))
    return joined.withColumn("value", scaled).drop("center", "scale", "lambda")


def _every_feature(params: DataFrame) -> DataFrame:
    """One array for each feature up to the last one fitted; without a fit it holds nulls."""
    found = params.agg(F.max("feature_idx").alias("last"), F.max(F.size("quantiles")).alias("size")).first()
    if found["last"] is None:
        return params
    nothing = F.array_repeat(F.lit(None).cast("double"), max(found["size"] or 0, 1))
    features = params.sparkSession.range(found["last"] + 1).select(F.col("id").cast("int").alias("feature_idx"))
    return features.join(params.select("feature_idx", "quantiles"), "feature_idx", "left").withColumn(
        "quantiles", F.coalesce("quantiles", nothing)
    )


def _transform_blocks(
    matrix: DataFrame, params: DataFrame, kind: str, normal: bool, limit: int
) -> DataFrame:
    if kind != "quantile":
        three = F.array("center", "scale", F.coalesce("lambda", F.lit(1.0)))
        params = params.withColumn("quantiles", three)
    table = hold(_every_feature(params), "feature_idx", "quantiles", limit)
    shared = matrix.sparkSession.sparkContext.broadcast(table)

    def scale(block: np.ndarray) -> np.ndarray:
        mine = opened(shared.value)[: block.shape[1]]
        unfitted = np.isnan(mine[:, :2]).any(axis=1)
        if unfitted.any():
            mine = np.where(unfitted[:, None], 0.5, mine)
        if kind == "quantile":
            scaled = rank_scores(block, mine, normal)
        else:
            center, spread, lam = mine.T
            scaled = ((yeo_johnson_cells(block, lam) if kind == "power" else block) - center) / spread
        return np.ma.array(scaled, mask=np.broadcast_to(unfitted, scaled.shape)) if unfitted.any() else scaled

    return map_cells(matrix, scale, table.shape[0])


# --- comparison -----------------------------------------------------------

STATS = ("range", "mean", "std")


def scaled_stats(
    matrix: DataFrame,
    kinds: Sequence[str] = KINDS,
    *,
    rows: int | None = None,
    group_limit: int = GROUP_LIMIT,
    compress: bool = False,
    inline_limit: int = INLINE_LIMIT,
) -> DataFrame:
    """Range, mean and deviation of every feature after each scaling, tidy.

    ``scaler, stat, feature_idx, value``. The linear scalings map the raw moments,
    the power scaling is monotone with known moments, so neither needs a second
    pass over the data; only the quantile scaling is applied cell by cell.
    """
    kinds = list(kinds)
    _check(kinds)
    if rows is None and ("robust" in kinds or "quantile" in kinds):
        rows = matrix.count()
    cells = _cells(matrix, compress)
    parts = []
    linear = [k for k in kinds if k in LINEAR]
    lo, hi, mean, var = (F.col(c) for c in ("vmin", "vmax", "mean", "var"))
    if linear:
        stats = linear_stats(cells, linear, rows, group_limit)
        parts.append(
            stats.select(
                "feature_idx", "vmin", "vmax", "mean", "var",
                F.inline(F.array(*_linear_rows(linear))),
            ).select(
                "scaler",
                "feature_idx",
                ((hi - lo) / F.col("scale")).alias("range"),
                ((mean - F.col("center")) / F.col("scale")).alias("mean"),
                (F.sqrt(var) / F.col("scale")).alias("std"),
            )
        )
    if "power" in kinds:
        weighted = _weighted(cells)
        fitted = fit_exponents(weighted)
        ends = weighted.groupBy("feature_idx").agg(
            F.min("value").alias("vmin"), F.max("value").alias("vmax")
        )
        scale = safe_scale(F.col("scale"))
        spread = yeo_johnson(hi, F.col("lambda")) - yeo_johnson(lo, F.col("lambda"))
        parts.append(
            fitted.join(ends, "feature_idx").select(
                F.lit("power").alias("scaler"),
                "feature_idx",
                (spread / scale).alias("range"),
                F.lit(0.0).alias("mean"),
                (F.col("scale") / scale).alias("std"),
            )
        )
    if "quantile" in kinds:
        params = materialize(_fit_quantile(cells, rows, group_limit), "quantiles")
        ranks = transform(
            matrix, params.withColumn("scaler", F.lit("quantile")), "quantile", inline_limit=inline_limit
        )
        scored = moments(to_long(ranks))
        parts.append(
            scored.select(
                F.lit("quantile").alias("scaler"),
                "feature_idx",
                (hi - lo).alias("range"),
                "mean",
                F.sqrt(var).alias("std"),
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    tidy = F.inline(
        F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in STATS])
    )
    return result.select("scaler", "feature_idx", tidy).select(
        "scaler", "stat", "feature_idx", "value"
    )


def compare(
    matrix: DataFrame, kinds: Sequence[str] = KINDS, **options
) -> tuple[DataFrame, DataFrame]:
    """``(stats, status)``: a scaler that fails becomes a row of ``status``.

    The scalers run together; only when that fails are they run one by one, so that
    one bad scaler does not stop the others.
    """
    spark = matrix.sparkSession
    schema = "scaler string, stat string, feature_idx int, value double"
    try:
        stats = materialize(scaled_stats(matrix, kinds, **options), "scaled-stats")
        return stats, spark.createDataFrame([(k, None) for k in kinds], "scaler string, error string")
    except Exception:  # noqa: BLE001 - retried below, one scaler at a time
        stats = spark.createDataFrame([], schema)
    status = []
    for kind in kinds:
        try:
            part = materialize(scaled_stats(matrix, [kind], **options), "scaled-stats")
            stats = stats.unionByName(part)
            status.append((kind, None))
        except Exception as failure:  # noqa: BLE001 - reported as a row
            status.append((kind, str(failure).splitlines()[0]))
    return stats, spark.createDataFrame(status, "scaler string, error string")


# --- stored scalers -------------------------------------------------------


def named(params: DataFrame, name: str) -> DataFrame:
    """Store a fitted scaler under a name of its own."""
    return params.withColumn("scaler", F.lit(name))


def describe(params: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Kind, feature count and parameter shapes of each stored scaler.

    With ``wanted(scaler)`` the scalers that are not stored are listed too.
    """
    found = params.groupBy("scaler").agg(
        F.max("kind").alias("kind"),
        F.count("*").alias("n_features"),
        F.count("scale").alias("n_scale"),
        F.count("center").alias("n_center"),
        F.count("lambda").alias("n_lambda"),
    )
    if wanted is None:
        return found.withColumn("found", F.lit(True))
    return wanted.select("scaler").distinct().join(found, "scaler", "left").withColumn(
        "found", F.col("n_features").isNotNull()
    )


def resolve(
    models: DataFrame, available: DataFrame, explicit: DataFrame, default: str
) -> DataFrame:
    """The scaler of each model: explicit entry, same name, ``<name>_tuned``, default.

    ``models(model)``, ``available(scaler)``, ``explicit(model, scaler)``. A model
    without any available candidate gets null and is encoded unscaled.
    """
    mapped = models.select("model").distinct().join(
        explicit.groupBy("model").agg(F.min("scaler").alias("mapped")), "model", "left"
    )
    candidates = mapped.select(
        "model",
        F.posexplode(
            F.array("mapped", F.col("model"), F.concat("model", F.lit("_tuned")), F.lit(default))
        ).alias("priority", "scaler"),
    )
    known = available.select("scaler").distinct().withColumn("stored", F.lit(True))
    return (
        candidates.join(known, "scaler", "left")
        .groupBy("model")
        .agg(F.min_by("scaler", F.when(F.col("stored"), F.col("priority"))).alias("scaler"))
    )


def empty_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PARAMS_SCHEMA)
