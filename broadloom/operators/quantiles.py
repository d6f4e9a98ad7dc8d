"""Exact linear-interpolated quantiles per group, without an unbounded group in a task.

Groups known to be small are sorted as a list. When a group may exceed ``group_limit``
rows, two scans find the wanted order statistics. The first counts and sketches the values of
each group; the sketch gives a narrow bracket around each wanted rank. The second counts what lies
between the brackets, so it is known, not assumed, which of them hold their rank, and stores
the values inside brackets with their counts. What follows reads these few values alone: brackets
that are still too large are cut into bins and counted again, the rest is sorted. Only if a
bracket missed its rank is the input read once more. The state is one row per group and rank.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from broadloom.functions.numeric import bin_index, finite_or_null
from broadloom.session import discard, materialize, small_side

GROUP_LIMIT = 1_000_000
# Interval bounds that may be broadcast: 64 MB of doubles.
BROADCAST_BOUNDS = 8_000_000
INFINITY = float("inf")
BINS = 1024
# Up to this many probabilities a cell is compared with all edges, above it they are searched.
FEW = 16
# Least and greatest size of a sketch, and half a bracket in errors of its ranks.
SAMPLE = 200
LARGEST_SAMPLE = 4096
SPREAD = 1.5


def largest_group(df: DataFrame, value: str, by: Sequence[str] = ()) -> int:
    """Non-missing values in the largest group: one pre-aggregated scan."""
    counted = df.groupBy(*by).agg(F.count(finite_or_null(F.col(value))).alias("n"))
    return int(counted.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    *,
    max_group: int | None = None,
    group_limit: int = GROUP_LIMIT,
    bins: int = BINS,
    name: str = "q",
    weight: str | None = None,
) -> DataFrame:
    """``by..., <name> array<double>``: one entry per probability.

    ``max_group`` is an upper bound on the rows of any group, where the caller knows
    one; otherwise it is counted. Nulls and NaN are skipped. ``weight`` names a column
    of counts: how often each row's value occurs.
    """
    cleaned = df.withColumn(value, finite_or_null(F.col(value)))
    counts = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    data = _cells_by_key(cleaned.withColumn("_w", counts), value, by)
    size, groups = LARGEST_SAMPLE, None
    if max_group is not None:
        size = _sketch_size(max_group, group_limit)
    elif weight is not None:
        max_group = largest_group(df, value, by)
    else:
        groups = _Groups(data, size)
        max_group = groups.largest
    if max_group <= group_limit:
        if groups is not None:
            discard(groups.table)
        return _of_bounded_groups(cleaned, value, probabilities, by, name, weight)
    groups = groups or _Groups(data, None if weight is not None else size)
    return _by_narrowing(data, value, groups, probabilities, by, bins, name, max_group, group_limit)


def _of_bounded_groups(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str],
    name: str,
    weight: str | None,
) -> DataFrame:
    """Quantiles of groups that are known to fit a task."""
    levels = F.lit(np.array(probabilities, dtype=float))
    if weight is not None:
        return df.groupBy(*by).agg(F.percentile(value, levels, F.col(weight)).alias(name))
    ordered = df.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_ordered"))

    def between(p: Column) -> Column:
        position = p * (F.size("_ordered") - 1)
        lower = F.get("_ordered", F.floor(position).cast("int"))
        upper = F.get("_ordered", F.ceil(position).cast("int"))
        return lower + (upper - lower) * (position - F.floor(position))

    ends = F.get("_ordered", F.lit(0)), F.get("_ordered", F.size("_ordered") - 1)
    infinite = F.raise_error(F.lit(f"infinite values in {value}"))
    found = F.when((ends[0] == -INFINITY) | (ends[1] == INFINITY), infinite).when(
        F.size("_ordered") > 0, F.transform(levels, between)
    )
    return ordered.select(*by, found.alias(name))


def _keys(by: Sequence[str]) -> list[str]:
    """Names of the grouping columns; a constant one lets the global case share the plans."""
    return [f"_k{i}" for i in range(len(by))] or ["_k0"]


def _cells_by_key(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``_k0..., v, w`` without missing values."""
    renamed = [F.col(b).alias(k) for b, k in zip(by, _keys(by))] or [F.lit(0).alias("_k0")]
    v = F.col(value)
    return df.filter(v.isNotNull()).select(*renamed, v.alias("v"), F.col("_w").alias("w"))


class _Groups:
    """The first scan: count, ends and, for a given ``size``, a sketch of the values of each group."""

    def __init__(self, data: DataFrame, size: int | None):
        self.size = size
        self.keys = [c for c in data.columns if c not in ("v", "w")]
        found = [F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
        if size is not None:
            found.append(F.kll_sketch_agg_double(F.col("v").cast("double"), size).alias("sketch"))
        seen = Observation()
        infinite = (F.col("lo") == -INFINITY) | (F.col("hi") == INFINITY)
        observed = data.groupBy(*self.keys).agg(*found).observe(
            seen, F.count("*").alias("count"), F.max("n").alias("largest"), F.count_if(infinite).alias("endless")
        )
        self.table = materialize(observed, "quantile-groups")
        self.count, self.largest = seen.get["count"], seen.get["largest"] or 0
        self.endless = None
        if seen.get["endless"]:
            self.endless = list(self.table.filter(infinite).select(*self.keys).first())


def _by_narrowing(
    data: DataFrame,
    value: str,
    groups: _Groups,
    probabilities: Sequence[float],
    by: Sequence[str],
    bins: int,
    name: str,
    max_group: int,
    group_limit: int,
) -> DataFrame:
    found = _order_statistics(data, value, groups, probabilities, by, bins, max_group, group_limit)
    # Position p * (n - 1) lies between two neighbouring order statistics.
    lower, upper = F.col("at_lower"), F.col("at_upper")
    weight = F.col("position") - F.floor("position")
    point = F.when(weight == 0, lower).otherwise(lower + (upper - lower) * weight)
    at = lambda wanted: F.max(F.when(F.col("rank") == wanted, F.col("lo")))
    parts = (
        found.groupBy(*by, "slot", "position")
        .agg(
            at(F.floor("position")).alias("at_lower"),
            at(F.ceil("position")).alias("at_upper"),
        )
        .withColumn("point", point)
    )
    ordered = F.array_sort(F.collect_list(F.struct("slot", "point")))
    return parts.groupBy(*by).agg(F.transform(ordered, lambda s: s["point"]).alias(name))


def _order_statistics(
    data: DataFrame,
    value: str,
    groups: _Groups,
    probabilities: Sequence[float],
    by: Sequence[str],
    bins: int,
    max_group: int,
    group_limit: int,
) -> DataFrame:
    """Rows ``by..., slot, position, rank, lo`` with ``lo`` the value at 0-based ``rank``.

    Column ``w`` of the input says how often each value occurs.
    """
    if groups.endless is not None:
        raise ValueError(f"infinite values in {value}, group {groups.endless}")
    probs = F.lit(np.array(probabilities, dtype=float))
    position = F.col("p") * (F.col("n") - 1)
    keys = groups.keys
    first, last = F.col("rank") == 0, F.col("rank") == F.col("n") - 1
    state = (
        groups.table.select(*keys, "n", "lo", "hi", F.posexplode(probs).alias("slot", "p"))
        .withColumn("position", position)
        .withColumn(
            "rank", F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position"))))
        )
        .select(
            *keys, "slot", "position", "rank", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"),
            F.when(last, F.col("hi")).otherwise(F.col("lo")).alias("lo"),
            F.when(first, F.col("lo")).otherwise(F.col("hi")).alias("hi"),
        )
    )
    stored, kept = [groups.table], F.lit(False)
    if groups.size is not None:
        ranks, wanted = _edge_ranks(probabilities, groups.size, 0.25 * group_limit / max(max_group, 1), bins)
        edged = groups.table.select(*keys, "n", "lo", "hi", _edges(ranks).alias("edges"))
        cells = _bracketed(data, edged, keys, wanted, groups.count, 4 / _half(groups.size))
        cells = materialize(cells, "quantile-cells")
        counted = cells.groupBy(*keys, "lo", "hi", "bin").agg(
            F.sum("w").alias("c"), F.min("least").alias("new_lo"), F.max("most").alias("new_hi"),
            F.bool_and(F.col("v").isNotNull()).alias("kept"),
        )
        state = _part_of_rank(state, counted, [*keys, "lo", "hi"], "kept")
        stored.append(cells)
        kept = F.col("kept")
    state, left = _stored_state(state, kept)
    rest = None
    round_no, before = 0, []
    while left["n"]:
        if rest is None:
            # All that is open lies inside the brackets, or one of them missed its rank.
            rest = cells.filter("v IS NOT NULL").select(*keys, "v", "w") if left["kept"] else data
        # Equal-width bins, then logarithmic ones: one of both must divide an interval.
        if before[-2:] == [left] * 2:
            raise RuntimeError(f"{left['n']} intervals of {value} cannot be narrowed further")
        before.append(left)
        if left["m"] <= group_limit:
            step = _finish(rest, state, left["n"], keys)
        else:
            step = _narrow(rest, state, _within_bins(left["n"], keys, bins, round_no % 2 == 1), keys)
        last_state = state
        state, left = _stored_state(step, F.lit(left["kept"]))
        discard(last_state)
        round_no += 1
    for table in stored:
        discard(table)
    back = [F.col(k).alias(b) for b, k in zip(by, keys)]
    return state.select(*back, "slot", "position", "rank", "lo")


def _stored_state(state: DataFrame, kept: Column) -> tuple[DataFrame, dict]:
    """The state in a table, and what is open in it: intervals, the largest, their sum, whether all are kept."""
    seen, opened = Observation(), F.col("lo") < F.col("hi")
    observed = state.observe(
        seen,
        F.count_if(opened).alias("n"),
        F.max(F.when(opened, F.col("inside"))).alias("m"),
        F.sum(F.when(opened, F.col("inside"))).alias("all"),
        F.coalesce(F.bool_and(kept | ~opened), F.lit(False)).alias("kept"),
    )
    table = materialize(observed, "quantile-state")
    return table.drop("kept"), seen.get


def _sketch_size(max_group: int, group_limit: int) -> int:
    """The size whose brackets hold about half the limit in the largest group, if it can be had."""
    error = max(group_limit, 1) / (4 * SPREAD * max(max_group, 1))
    return int(min(LARGEST_SAMPLE, max(SAMPLE, (2.296 / error) ** (1 / 0.9021))))


def _half(size: int) -> float:
    """Half a bracket as a share of ranks; 2.296 / size ** 0.9021 is the published error of the sketch."""
    return min(1.0, SPREAD * 2.296 / size**0.9021)


def _edge_ranks(
    probabilities: Sequence[float], size: int, longest: float, most: int
) -> tuple[list[float], list[bool]]:
    """Ranks of the edges, and whether what follows an edge is inside a bracket.

    Overlapping brackets are one. Brackets are cut into parts of at most ``longest``, or into about
    ``most`` parts in all. The ends of a group are known and need no bracket.
    """
    merged: list[list[float]] = []
    for p in sorted(p for p in probabilities if 0 < p < 1):
        low, high = max(0.0, p - _half(size)), min(1.0, p + _half(size))
        if merged and low <= merged[-1][1]:
            merged[-1][1] = high
        else:
            merged.append([low, high])
    longest = max(longest, sum(high - low for low, high in merged) / most)
    ranks, wanted = [], []
    for low, high in merged:
        parts = max(1, int(np.ceil((high - low) / longest)))
        ranks += np.linspace(low, high, parts + 1).tolist()
        wanted += [True] * parts + [False]
    return ranks, wanted


def _edges(ranks: list[float]) -> Column:
    if not ranks:
        return F.array().cast("array<double>")
    return F.kll_sketch_get_quantile_double(F.col("sketch"), F.lit(np.array(ranks)))


def _bracketed(
    data: DataFrame, edged: DataFrame, keys: list[str], wanted: list[bool], groups: int, small: float
) -> DataFrame:
    """``keys..., lo, hi, bin, v, w, least, most``: weights of the values inside brackets, and of all between.

    Bins are numbered in value order: odd ones hold the cells that equal an edge, even ones those
    between two. Between brackets, and on edges, ``v`` is null and a bin is one row. Of groups
    below ``small`` rows, whose brackets may be shorter than a rank, all values are kept.
    """
    v, at = F.col("v"), F.col("_at")
    bounds = small_side(edged, groups * (len(wanted) + 4), BROADCAST_BOUNDS)
    placed = data.join(bounds, keys)
    if len(wanted) <= 2 * FEW:
        reached = F.lit(0)
        for i in range(len(wanted)):
            reached = reached + F.when(v >= F.get("edges", F.lit(i)), 1).otherwise(0)
        placed = placed.withColumn("_at", reached)
    else:
        placed = placed.withColumn("_at", F.lit(0))
        for width in (1 << i for i in reversed(range(len(wanted).bit_length()))):
            beyond = F.get("edges", at + F.lit(width - 1)) <= v
            placed = placed.withColumn("_at", F.when(beyond, at + F.lit(width)).otherwise(at))
    on_edge = F.coalesce(F.get("edges", at - 1) == v, F.lit(False))
    flags = F.lit(np.array(wanted or [False]))
    inside = F.coalesce(F.get(flags, at - 1), F.lit(False)) | (F.col("n") < small)
    placed = placed.select(
        *keys, "lo", "hi", "w", "v", (2 * at - on_edge.cast("int")).alias("bin"),
        F.when(inside & ~on_edge, v).alias("_own"),
    )
    counted = placed.groupBy(*keys, "lo", "hi", "bin", "_own").agg(
        F.sum("w").alias("w"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    return counted.withColumnRenamed("_own", "v")


def _within_bins(still_open: int, keys: list[str], bins: int, logarithmic: bool):
    """Number the cells of the open intervals by equal-width bins."""

    def place(data: DataFrame, wanted: DataFrame) -> DataFrame:
        x, lo, hi = (_scale_key(F.col(c), logarithmic) for c in ("v", "lo", "hi"))
        # Where the map flattens an interval, everything stays in bin 0 for this round.
        bin_of = F.when(lo < hi, bin_index(x, lo, hi, bins)).otherwise(F.lit(0))
        return _inside(data, wanted, still_open, keys).withColumn("bin", bin_of)

    return place


def _inside(data: DataFrame, wanted: DataFrame, still_open: int, keys: list[str]) -> DataFrame:
    """The cells of the wanted intervals, each with its own one.

    Open intervals of a group are disjoint. A group has one row with all its bounds in order, in
    which a cell finds its interval by binary search: no pairs of cells and intervals.
    """
    per_group = wanted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_iv"))
    per_group = per_group.select(*keys, F.col("_iv.lo").alias("_los"), F.col("_iv.hi").alias("_his"))
    most = max(still_open, 1)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])

    def step(at: Column, width: Column) -> Column:
        return F.when(F.get("_los", at + width) <= F.col("v"), at + width).otherwise(at)

    bounds = small_side(per_group, 2 * still_open, BROADCAST_BOUNDS)
    placed = data.join(bounds, keys).withColumn("_at", F.aggregate(steps, F.lit(-1), step))
    hit = placed.filter((F.col("_at") >= 0) & (F.col("v") <= F.get("_his", F.col("_at"))))
    return hit.select(
        *data.columns, F.get("_los", F.col("_at")).alias("lo"), F.get("_his", F.col("_at")).alias("hi")
    )


def _scale_key(x, logarithmic: bool):
    """A monotone map of the values; the logarithmic one splits long tails."""
    return F.signum(x) * F.log1p(F.abs(x)) if logarithmic else x


def _narrow(data: DataFrame, state: DataFrame, place, keys: list[str]) -> DataFrame:
    """Narrow each open interval to the part that holds its rank.

    ``place`` numbers the cells of the intervals in value order. A part is shrunk to
    the values it really contains.
    """
    interval = [*keys, "lo", "hi"]
    opened = state.filter("lo < hi")
    counted = (
        place(data, opened.select(*interval).distinct())
        .groupBy(*interval, "bin")
        .agg(F.sum("w").alias("c"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"))
    )
    return _part_of_rank(state, counted, interval)


def _part_of_rank(state: DataFrame, counted: DataFrame, interval: list[str], *extra: str) -> DataFrame:
    """Replace each open interval by the counted part that holds its rank."""
    keys = interval[:-2]
    opened = state.filter("lo < hi")
    # One row per part of an interval.
    running = Window.partitionBy(*interval).orderBy("bin")
    placed = counted.withColumn("through", F.sum("c").over(running)).withColumn(
        "before", F.col("through") - F.col("c")
    )
    offset = F.col("rank") - F.col("below")
    narrowed = (
        opened.join(placed, interval)
        .filter((offset >= F.col("before")) & (offset < F.col("through")))
        .select(
            *keys,
            "slot",
            "position",
            "rank",
            (F.col("below") + F.col("before")).alias("below"),
            F.col("c").alias("inside"),
            F.col("new_lo").alias("lo"),
            F.col("new_hi").alias("hi"),
            *extra,
        )
    )
    settled = state.filter("lo >= hi").select("*", *[F.lit(True).alias(name) for name in extra])
    return narrowed.unionByName(settled)


def _finish(data: DataFrame, state: DataFrame, still_open: int, keys: list[str]) -> DataFrame:
    """Sort what is left of each open interval, which has been counted to fit a task.

    Ranks are sorted in among the values: each takes the last one that starts at or before it.
    """
    interval = [*keys, "lo", "hi"]
    opened = state.filter("lo < hi")
    cells = _inside(data, opened.select(*interval).distinct(), still_open, keys)
    values = cells.groupBy(*interval, "v").agg(F.sum("w").alias("w"))
    through = F.sum("w").over(Window.partitionBy(*interval).orderBy("v"))
    starts = values.select(*interval, "v", (through - F.col("w")).alias("_start"))
    asked = opened.select(*interval, "slot", "position", "rank", "below", "inside", (F.col("rank") - F.col("below")).alias("_start"))
    mixed = starts.unionByName(asked, allowMissingColumns=True)
    upto = Window.partitionBy(*interval).orderBy("_start", F.col("rank").isNotNull())
    found = mixed.withColumn("_found", F.last("v", True).over(upto)).filter("rank IS NOT NULL")
    found = found.withColumn("lo", F.col("_found")).withColumn("hi", F.col("_found"))
    return found.select(*state.columns).unionByName(state.filter("lo >= hi"))


def median(df: DataFrame, value: str, by: Sequence[str] = (), **options) -> DataFrame:
    """``by..., median``."""
    return quantiles(df, value, [0.5], by, **options).select(
        *by, F.get("q", F.lit(0)).alias("median")
    )


def references(count: int) -> list[float]:
    """``count`` evenly spaced probabilities from 0 to 1."""
    if count == 1:
        return [0.0]
    return [i / (count - 1) for i in range(count)]

