"""Yeo-Johnson exponents for all features at once.

The log-likelihood is concave in the exponent, so a guarded Newton iteration finds
its maximum. One round is one aggregate by feature over the cells of the features
still open; its output is one row per feature. Newton needs a handful of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from broadloom.functions.numeric import log_jacobian, with_yeo_johnson
from broadloom.session import discard, materialize, small_side

TOLERANCE = 1e-8
MAX_ROUNDS = 80
EPS = 2.220446049250313e-16

STATE = (
    "feature_idx", "n", "origin", "jacobian", "flat", "lam", "lo", "hi", "center", "variance",
    "next_lam", "done",
)


def fit_exponents(cells: DataFrame) -> DataFrame:
    """``feature_idx, lambda, center, scale`` from weighted cells.

    ``cells`` holds ``feature_idx, value, w`` without nulls. ``center`` and ``scale``
    are the mean and the population deviation of the transformed feature. A
    constant feature keeps exponent 1.
    """
    x, w = F.col("value"), F.col("w")
    start = (
        cells.groupBy("feature_idx")
        .agg(
            F.sum(w).alias("n"),
            (F.sum(x * w) / F.sum(w)).alias("origin"),
            F.sum(log_jacobian(x) * w).alias("jacobian"),
            (F.min(x) == F.max(x)).alias("flat"),
        )
        .selectExpr(
            "feature_idx", "n", "origin", "jacobian", "flat", "1D AS lam",
            *[f"CAST(NULL AS DOUBLE) AS {c}" for c in STATE[6:-1]],
            "false AS done",
        )
    )
    state = materialize(start, "power-state")
    features = state.count()
    for _ in range(MAX_ROUNDS):
        seen = Observation()
        stepped = _round(cells, state, features).observe(seen, F.count_if(~F.col("done")).alias("open"))
        before, state = state, materialize(stepped, "power-state")
        discard(before)
        if not seen.get["open"]:
            break
    else:
        raise ArithmeticError("the exponent search did not converge")
    return state.select(
        "feature_idx",
        F.col("lam").alias("lambda"),
        "center",
        F.sqrt(F.greatest("variance", F.lit(0.0))).alias("scale"),
    )


def _round(cells: DataFrame, state: DataFrame, features: int) -> DataFrame:
    """Evaluate the open features at their next exponent and choose the one after."""
    opened = with_yeo_johnson(
        state.filter("NOT done").selectExpr(
            "feature_idx", "n", "origin", "jacobian", "flat", "lo", "hi",
            "coalesce(next_lam, lam) AS lam",
        ),
        "origin", "lam", ("o0", "o1", "o2"),
    )
    # Values are taken relative to the transformed mean: the sums keep their digits.
    exponents = small_side(opened.select("feature_idx", "lam", "o0", "o1", "o2"), features)
    bent = with_yeo_johnson(
        cells.join(exponents, "feature_idx"), "value", "lam", ("y0", "y1", "y2")
    ).selectExpr("feature_idx", "CAST(w AS DOUBLE) AS w", "y0 - o0 AS a", "y1 - o1 AS b", "y2 - o2 AS c")
    products = ("a", "b", "c", "a * a", "a * b", "b * b", "a * c")
    sums = bent.groupBy("feature_idx").agg(
        *[F.expr(f"sum(w * {p}) AS s{p.replace(' * ', '')}") for p in products]
    )
    moved = (
        opened.join(sums, "feature_idx")
        .selectExpr(
            "feature_idx", "n", "origin", "jacobian", "flat", "lam", "lo", "hi",
            "o0 + sa / n AS center",
            "saa / n - (sa / n) * (sa / n) AS variance",
            "sab / n - (sa / n) * (sb / n) AS cov_ab",
            "sbb / n - (sb / n) * (sb / n) AS var_b",
            "sac / n - (sa / n) * (sc / n) AS cov_ac",
        )
        .selectExpr("*", "try_divide(2 * cov_ab, variance) AS ratio")
        .selectExpr(
            "*",
            "jacobian - n / 2 * ratio AS slope",
            "-n / 2 * (try_divide(2 * (var_b + cov_ac), variance) - ratio * ratio) AS bend",
        )
        .selectExpr(
            "* EXCEPT (lo, hi)",
            "if(slope > 0, lam, lo) AS lo",
            "if(slope <= 0, lam, hi) AS hi",
            "2 + 2 * abs(lam) AS longest",
        )
        # A Newton step of bounded length; outside the bracket its middle instead.
        .selectExpr(
            "*",
            "lam + greatest(-longest, least(longest,"
            " if(bend < 0, -slope / bend, signum(slope) * longest))) AS target",
        )
        .selectExpr("*", "if(target < lo OR target > hi, coalesce((lo + hi) / 2, target), target) AS next_lam")
    )
    settled = (
        f"flat OR variance <= n * {EPS * EPS} * center * center"
        f" OR abs(next_lam - lam) <= {TOLERANCE} * (1 + abs(lam))"
    )
    advanced = moved.selectExpr(*STATE[:-1], f"coalesce({settled}, false) AS done")
    return advanced.unionByName(state.filter("done"))
