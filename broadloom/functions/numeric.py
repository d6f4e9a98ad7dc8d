"""Arithmetic on doubles, as column expressions that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a scale below ten machine epsilons counts as zero.
TINY_SCALE = 10 * 2.220446049250313e-16


def finite_or_null(value: Column) -> Column:
    """NaN becomes null, so that aggregates skip it and orderings ignore it."""
    return F.when(~F.isnan(value), value)


def safe_scale(scale: Column) -> Column:
    """A zero scale leaves the centred value unchanged: divide by one."""
    return F.when(F.abs(scale) < TINY_SCALE, F.lit(1.0)).otherwise(scale)


def clip(value: Column, lo: float, hi: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(float(lo)), F.least(value, F.lit(float(hi)))))


def floor_round(value: Column, places: Column | int) -> Column:
    """Round half up through ``floor``: the same bits in every IEEE engine."""
    factor = F.pow(F.lit(10.0), F.lit(places) if isinstance(places, int) else places)
    return F.floor(value * factor + F.lit(0.5)) / factor


# --- equal-width bins -----------------------------------------------------


def bin_range(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A single-valued range is widened by half a unit on both sides."""
    flat = lo == hi
    return (
        F.when(flat, lo - 0.5).otherwise(lo),
        F.when(flat, hi + 0.5).otherwise(hi),
    )


def bin_edge(index: Column, lo: Column, hi: Column, bins: int) -> Column:
    return F.when(index == bins, hi).otherwise(lo + index * ((hi - lo) / F.lit(float(bins))))


def bin_index(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin of ``value``; bins are half open except the last one.

    The arithmetic guess can be one off at an edge, so it is checked against the
    edges themselves.
    """
    guess = F.least(
        F.floor((value - lo) / (hi - lo) * F.lit(float(bins))).cast("int"), F.lit(bins - 1)
    )
    return (
        F.when((guess > 0) & (value < bin_edge(guess, lo, hi, bins)), guess - 1)
        .when((guess < bins - 1) & (value >= bin_edge(guess + 1, lo, hi, bins)), guess + 1)
        .otherwise(guess)
    )


# --- Yeo-Johnson ----------------------------------------------------------

# Below this distance from the singular exponent the power form loses digits and
# the series in the exponent is used instead.
_NEAR = 1e-5


def yeo_johnson(x: Column, lam: Column) -> Column:
    """Yeo-Johnson transform of ``x`` with exponent ``lam``."""
    log_u = F.log1p(F.abs(x))
    mu = F.when(x < 0, F.lit(2.0) - lam).otherwise(lam)
    bent = F.when(F.abs(mu) < _NEAR, log_u + mu * log_u * log_u / 2).otherwise(
        F.expm1(mu * log_u) / mu
    )
    return F.when(x < 0, -bent).otherwise(bent)


def yeo_johnson_cells(block: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """The same on ``[rows, features]`` with one exponent per feature."""
    log_u = np.log1p(np.abs(block))
    mu = np.where(block < 0, 2.0 - lam, lam)
    near = np.abs(mu) < _NEAR
    bent = np.where(near, log_u + mu * log_u * log_u / 2, np.expm1(mu * log_u) / np.where(near, 1.0, mu))
    return np.where(block < 0, -bent, bent)


def with_yeo_johnson(df: DataFrame, x: str, lam: str, names: Sequence[str]) -> DataFrame:
    """Append the transform and its first two derivatives in the exponent.

    Written as a chain of small projections: each power is computed once per row and
    the generated code stays short enough to be compiled. ``names`` are the columns
    for the orders 0, 1, 2.
    """
    y0, y1, y2 = names
    near = f"abs(_m) < {_NEAR}"
    # For negative x the exponent enters as 2 - lam: odd derivatives change sign twice.
    return (
        df.selectExpr(
            "*",
            f"log1p(abs({x})) AS _l",
            f"if({x} < 0, 2 - {lam}, {lam}) AS _m",
            f"if({x} < 0, -1D, 1D) AS _s",
        )
        .selectExpr("*", "expm1(_m * _l) AS _e")
        .selectExpr("*", f"if({near}, _l + _m * _l * _l / 2, _e / _m) AS _g0")
        .selectExpr("*", f"if({near}, _l * _l / 2 + _m * _l * _l * _l / 3, ((_e + 1) * _l - _g0) / _m) AS _g1")
        .selectExpr(
            *[f"`{c}`" for c in df.columns],
            f"_s * _g0 AS {y0}",
            f"_g1 AS {y1}",
            f"_s * if({near}, _l * _l * _l / 3 + _m * _l * _l * _l * _l / 4,"
            f" ((_e + 1) * _l * _l - 2 * _g1) / _m) AS {y2}",
        )
    )


def log_jacobian(x: Column) -> Column:
    """sign(x) * ln(1 + |x|): the data part of the Yeo-Johnson likelihood."""
    return F.signum(x) * F.log1p(F.abs(x))


# --- inverse normal CDF ---------------------------------------------------

# Coefficients of algorithm AS 241, routine PPND16 (Wichura 1988),
# lowest power first.
_CENTRAL_NUM = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
    3.3430575583588128105e4, 2.5090809287301226727e3,
)
_CENTRAL_DEN = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
    5.2264952788528545610e3,
)
_MIDDLE_NUM = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
    3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
    2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
_MIDDLE_DEN = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
    1.05075007164441684324e-9,
)
_TAIL_NUM = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
    2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
    2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
_TAIL_DEN = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
    2.04426310338993978564e-15,
)

# Fixed value: probabilities are kept this far from 0 and 1 before inversion.
PROBIT_MARGIN = 1e-7 - 2.220446049250313e-16


def _horner(coefficients: tuple[float, ...], x):
    result = coefficients[-1] * x + coefficients[-2]
    for coefficient in reversed(coefficients[:-2]):
        result = result * x + coefficient
    return result


def normal_scores(u: np.ndarray) -> np.ndarray:
    """Uniform scores to normal scores, with the two ends held finite; NaN stays NaN."""
    q = np.clip(u, PROBIT_MARGIN, 1.0 - PROBIT_MARGIN) - 0.5
    t = np.sqrt(-np.log(0.5 - np.abs(q)))
    centre, middle, tail = 0.180625 - q * q, t - 1.6, t - 5.0
    return np.where(
        np.abs(q) <= 0.425,
        q * _horner(_CENTRAL_NUM, centre) / _horner(_CENTRAL_DEN, centre),
        np.sign(q)
        * np.where(
            t <= 5.0,
            _horner(_MIDDLE_NUM, middle) / _horner(_MIDDLE_DEN, middle),
            _horner(_TAIL_NUM, tail) / _horner(_TAIL_DEN, tail),
        ),
    )


# --- ranks among quantiles ------------------------------------------------

# Fixed value: distance from the extremes that still maps to the extreme score.
EDGE = 1e-7


def rank_scores(block: np.ndarray, levels: np.ndarray, normal: bool) -> np.ndarray:
    """Rank in [0, 1] of every cell among the sorted quantiles of its feature.

    ``block`` is ``[rows, features]`` and ``levels`` is ``[features, quantiles]``. A value
    equal to several quantiles gets the middle of their ranks. With ``normal`` the
    ranks become normal scores.
    """
    scores = np.empty_like(block)
    last = max(levels.shape[1] - 1, 1)
    margin = EDGE if normal else 0.0
    for j, q in enumerate(levels):
        x = block[:, j]
        below, through = np.searchsorted(q, x, "left"), np.searchsorted(q, x, "right")
        lower = q[np.clip(below - 1, 0, len(q) - 1)]
        upper = q[np.clip(below, 0, len(q) - 1)]
        gap = np.where(upper > lower, upper - lower, 1.0)
        tied, between = (below + through - 1) / 2.0, below - 1 + (x - lower) / gap
        u = np.where(through > below, tied, between) / last
        u = np.where((x + margin > q[-1]) | (x >= q[-1]), 1.0, u)
        u = np.where((x - margin < q[0]) | (x <= q[0]), 0.0, u)
        scores[:, j] = np.where(np.isnan(x), np.nan, u)
    return normal_scores(scores) if normal else scores
