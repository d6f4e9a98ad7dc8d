"""Per-feature moments, histograms, box statistics and interval estimates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from broadloom.functions.numeric import bin_edge, bin_index, bin_range, finite_or_null
from broadloom.operators.matrix import to_long
from broadloom.operators.quantiles import quantiles
from broadloom.session import materialize, ship_package, small_side


def moments(
    long: DataFrame, by: Sequence[str] = ("feature_idx",), value: str = "value"
) -> DataFrame:
    """Count, mean, population variance, min, max and largest magnitude per group.

    Nulls and NaN are skipped. All of it is one map-side combined aggregate.
    """
    v = F.col("_v")
    return (
        long.select(*by, finite_or_null(F.col(value)).alias("_v"))
        .groupBy(*by)
        .agg(
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            F.var_pop(v).alias("var"),
            F.min(v).alias("vmin"),
            F.max(v).alias("vmax"),
            F.max(F.abs(v)).alias("max_abs"),
        )
    )


def weighted_moments(cells: DataFrame) -> DataFrame:
    """The same from ``feature_idx, value, w`` rows without nulls.

    The variance is taken around the stored means: no digits are lost to large means.
    """
    v, w = F.col("value"), F.col("w")
    means = materialize(
        cells.groupBy("feature_idx").agg(
            F.sum(w).alias("n"),
            (F.sum(v * w) / F.sum(w)).alias("mean"),
            F.min(v).alias("vmin"),
            F.max(v).alias("vmax"),
            F.max(F.abs(v)).alias("max_abs"),
        ),
        "means",
    )
    gap = v - F.col("mean")
    kept = ("n", "mean", "vmin", "vmax", "max_abs")
    return (
        cells.join(small_side(means, means.count()), "feature_idx")
        .groupBy("feature_idx", *kept)
        .agg((F.sum(w * gap * gap) / F.col("n")).alias("var"))
        .select("feature_idx", "n", "mean", "var", "vmin", "vmax", "max_abs")
    )


def feature_stats(matrix: DataFrame) -> DataFrame:
    """``feature_idx, range, mean, std`` over the rows of a matrix."""
    return moments(to_long(matrix)).select(
        "feature_idx",
        (F.col("vmax") - F.col("vmin")).alias("range"),
        "mean",
        F.sqrt("var").alias("std"),
    )


def value_counts(long: DataFrame, value: str = "value") -> DataFrame:
    """``feature_idx, value, w``: repeated cells collapse before any later pass."""
    return (
        long.select("feature_idx", finite_or_null(F.col(value)).alias("value"))
        .filter("value is not null")
        .groupBy("feature_idx", "value")
        .agg(F.count("*").alias("w"))
    )


def histogram(
    df: DataFrame, value: str, bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Equal-width histogram per group: ``by..., bin, bin_start, bin_end, count``.

    Bins cover the smallest to the largest value, the last bin is closed, empty
    bins are kept, and a single-valued group is widened by half a unit per side.
    ``df`` is read twice: once for the ranges, which are stored, and once to count.
    """
    v = F.col("_v")
    keys = list(by) or ["_all"]
    data = (df if by else df.withColumn("_all", F.lit(0))).select(
        *keys, finite_or_null(F.col(value)).alias("_v")
    ).filter(v.isNotNull())
    lo, hi = bin_range(F.min(v), F.max(v))
    edges = materialize(data.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi")), "bin-ranges")
    groups = edges.count()
    counted = (
        data.join(small_side(edges, groups), keys)
        .groupBy(*keys, bin_index(v, F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    frame = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(counted, [*keys, "bin"], "left").select(
        *by,
        "bin",
        bin_edge(F.col("bin"), F.col("lo"), F.col("hi"), bins).alias("bin_start"),
        bin_edge(F.col("bin") + 1, F.col("lo"), F.col("hi"), bins).alias("bin_end"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"),
    )


def box_stats(
    df: DataFrame, value: str, by: Sequence[str], *, whisker: float = 1.5, **options
) -> DataFrame:
    """Quartiles, whiskers at the furthest datum within 1.5 IQR, and outlier count."""
    data = df.select(*by, finite_or_null(F.col(value)).alias("_v")).filter("_v is not null")
    found = quantiles(data, "_v", [0.25, 0.5, 0.75], by, **options)
    quartiles = materialize(
        found.select(
            *by,
            F.get("q", F.lit(0)).alias("q1"),
            F.get("q", F.lit(1)).alias("median"),
            F.get("q", F.lit(2)).alias("q3"),
        ),
        "quartiles",
    )
    reach = whisker * (F.col("q3") - F.col("q1"))
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    # The quartiles ride along as aggregates: they are equal within a group.
    first = [F.first(c).alias(c) for c in ("q1", "median", "q3")]
    return (
        data.join(small_side(quartiles, quartiles.count()), list(by))
        .groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            *first,
            F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def group_mean(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    v = finite_or_null(F.col(value))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"))


def mean_interval(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    key: str,
    *,
    replicates: int = 1000,
    level: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    """Group mean with a seeded bootstrap interval.

    Each row takes part in every replicate with a Poisson(1) weight drawn from a hash of its
    key, so the draw does not depend on the partitioning. Tasks draw the weights of a block of
    rows as one array and send the replicate sums of their groups only.
    """
    ship_package(df.sparkSession)
    data = df.select(
        *by, F.xxhash64(F.col(key), F.lit(seed)).alias("_h"), finite_or_null(F.col(value)).alias("_v")
    ).filter("_v is not null")
    kinds = dict(data.dtypes)
    names = list(by)

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                h, v = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("_h", "_v"))
                weights = poisson_one(h.view(np.uint64)[:, None] + steps)
                both = np.stack([weights, weights * v[:, None]], 1)
                groups: dict[tuple, list[int]] = {}
                for i, group in enumerate(zip(*(c.to_pylist() for c in part.columns[: len(names)]), strict=True)):
                    groups.setdefault(group, []).append(i)
                for group, rows in groups.items():
                    sums[group] = sums.get(group, 0.0) + both[rows].sum(axis=0)
                if len(sums) > 1000:
                    yield sent(sums)
                    sums = {}
        if sums:
            yield sent(sums)

    def sent(sums: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([g[i] for g in sums for _ in range(replicates)], types[n]) for i, n in enumerate(names)]
        columns.append(pa.array(np.tile(np.arange(1, replicates + 1, dtype=np.int32), len(sums))))
        columns += [pa.array(np.concatenate([x[i] for x in sums.values()])) for i in range(2)]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "_rep", "_sw", "_swv"])

    fields = "".join(f"`{n}` {kinds[n]}, " for n in names)
    types = {f.name: f.type for f in to_arrow_schema(data.schema)}
    replicate_means = (
        data.mapInArrow(resample, f"{fields}_rep int, _sw double, _swv double")
        .groupBy(*by, "_rep")
        .agg(F.sum("_sw").alias("_sw"), F.sum("_swv").alias("_swv"))
        .filter("_sw > 0")
        .withColumn("_m", F.col("_swv") / F.col("_sw"))
    )
    tail = (1 - level) / 2
    spread = quantiles(
        replicate_means, "_m", [tail, 1 - tail], by, max_group=replicates
    ).select(*by, F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
    return group_mean(df, value, by).join(spread, list(by), "left")


def poisson_one(hashed: np.ndarray) -> np.ndarray:
    """Poisson(1) by inversion of uniforms made from 64-bit hashes."""
    x = hashed.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    terms = np.cumprod([math.exp(-1), *(1.0 / k for k in range(1, 12))])
    return np.searchsorted(np.cumsum(terms), u, "right").astype(float)
