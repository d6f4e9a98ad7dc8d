"""Training of autoencoders whose outer kernels are too large for one worker.

The first and the last layer are cut into blocks of features. A block's kernels and their Adam
moments are one row of a stored table, so no kernel is ever whole in a task or in the driver. One step
over a batch of rows is a chain of small jobs:

1. every block multiplies its cells of the batch by its rows of the first kernel; a task adds up its blocks
   before anything moves;
2. one task per trial adds these sums up and runs the hidden layers;
3. every block of the last layer predicts its features, takes its gradient step, and sends back its share
   of the gradient, added up per task;
4. one task per trial runs the hidden layers backwards and takes their step;
5. every block of the first layer takes its step.

Batches of cells and of activations are bounded by the batch size and are broadcast up to a checked size.
The hidden layers between the outer ones must fit one worker with their moments.

State is a table per step. After each epoch a commit names the tables of the last and of the best epoch of
every trial; what no commit names is deleted. ``fit_wide`` with the ``run_dir`` of an interrupted run goes on
after the last commit and gives the history an uninterrupted run would have given, because batches,
initial kernels and dropout are drawn from the seed, the trial and the step.
"""

from __future__ import annotations

import io
import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.operators.blocks import cells_of, grouped
from broadloom.operators.matrix import width_of
from broadloom.operators.network import NORM_EPSILON, WEIGHTS_SCHEMA, layers_table, load_stages
from broadloom.operators.training import (
    EPOCHS,
    HISTORY_SCHEMA,
    NORM_MOMENTUM,
    PATIENCE,
    VALIDATION_SHARE,
    Config,
    adam,
    split,
)
from broadloom.session import path_exists, remove_path, scratch_path, ship_package

#: Bytes of one kernel block; with moments a stored row is three times as large.
BLOCK_BYTES = 16 << 20
#: Rows of a validation batch.
VALIDATION_ROWS = 4096
#: Cells of a batch, or its activations, up to this many bytes are broadcast.
BROADCAST_BYTES = 64 << 20

_ROW = "kind string, trial_id int, block int, data binary"
_STORED = "trial_id int, block int, data binary"
_CELLS = "is_validation boolean, batch int, block int, cells binary"
_COMMIT = (
    "trial_id int, epoch int, loss double, val_loss double, epoch_seconds double, steps int, "
    "first string, last string, hidden string, best_loss double, best_first string, best_last string, "
    "best_hidden string, waited int, stopped boolean"
)

Arrays = dict[str, np.ndarray]


def _dump(arrays: Arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(data: bytes) -> Arrays:
    with np.load(io.BytesIO(data), allow_pickle=False) as stored:
        return {name: stored[name] for name in stored.files}


def _rows(*rows: tuple) -> pa.RecordBatch:
    kinds, trials, blocks, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds), pa.array(trials, pa.int32()), pa.array(blocks, pa.int32()), pa.array(data, pa.binary())],
        names=["kind", "trial_id", "block", "data"],
    )


def _store(df: DataFrame, path: str) -> str:
    df.write.partitionBy("kind").parquet(path)
    return path


def _kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(f"{path}/kind={kind}")


# --- initial state ----------------------------------------------------------


def _drawn(config: Config, seed: int, skip: int, shape: tuple[int, int], bound: float) -> np.ndarray:
    """Numbers ``skip`` and following of the draws that initialise a trial."""
    rng = np.random.default_rng([seed, config.trial_id])
    rng.bit_generator.advance(skip)
    return rng.uniform(-bound, bound, shape)


def _with_moments(arrays: Arrays) -> Arrays:
    moments = {f"{m}_{k}": np.zeros_like(v) for k, v in arrays.items() if "moving" not in k for m in "mv"}
    return {**arrays, **moments}


def _kernel_places(config: Config, n_features: int) -> list[tuple[int, int, int, float]]:
    """(draws before it, inputs, outputs, bound) of each kernel."""
    places, width, skip = [], n_features, 0
    for u in config.units(n_features):
        places.append((skip, width, u, math.sqrt(6.0 / (width + u))))
        skip, width = skip + width * u, u
    return places


def _initial(
    spark: SparkSession, configs: Sequence[Config], n_features: int, per_block: int, seed: int, run: str
) -> tuple[str, str, str]:
    """Store the neutral start: the same numbers as ``training.initial_stages`` draws."""
    by_trial = {c.trial_id: c for c in configs}
    n_blocks = math.ceil(n_features / per_block)

    def block_state(which: str) -> Callable:
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for trial, block in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                    low, high = block * per_block, min((block + 1) * per_block, n_features)
                    config = by_trial[trial]
                    places = _kernel_places(config, n_features)
                    if which == "first":
                        skip, _, u, bound = places[0]
                        arrays = {"kernel": _drawn(config, seed, skip + low * u, (high - low, u), bound)}
                    else:
                        skip, width, u, bound = places[-1]
                        rows = [_drawn(config, seed, skip + i * u + low, (1, high - low), bound) for i in range(width)]
                        arrays = {"kernel": np.concatenate(rows), "bias": np.zeros(high - low)}
                    yield _rows(("state", trial, block, _dump(_with_moments(arrays))))

        return make

    def hidden_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trial in batch.column(0).to_pylist():
                config, state = by_trial[trial], {}
                for s, (skip, width, u, bound) in enumerate(_kernel_places(config, n_features)[:-1]):
                    own = {"bias": np.zeros(u), "gamma": np.ones(u), "beta": np.zeros(u)}
                    own |= {"moving_mean": np.zeros(u), "moving_var": np.ones(u)}
                    if s:
                        own["kernel"] = _drawn(config, seed, skip, (width, u), bound)
                    state |= {f"{s}.{k}": v for k, v in _with_moments(own).items()}
                yield _rows(("state", trial, 0, _dump(state)))

    trials = spark.createDataFrame([(c.trial_id,) for c in configs], "trial_id int")
    blocks = trials.crossJoin(spark.range(n_blocks).select(F.col("id").cast("int").alias("block")))
    blocks = blocks.repartition("trial_id", "block")
    return (
        _store(blocks.mapInArrow(block_state("first"), _ROW), f"{run}/first-0"),
        _store(trials.mapInArrow(hidden_state, _ROW), f"{run}/hidden-0"),
        _store(blocks.mapInArrow(block_state("last"), _ROW), f"{run}/last-0"),
    )


def _batches(matrix: DataFrame, key: str, per_block: int, n_train: int, n_valid: int, path: str) -> None:
    """Store the cells by batch and feature block, the rows of a batch in the same order everywhere."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = cells_of(batch.column(3))
            for block in range(math.ceil(x.shape[1] / per_block)):
                part = np.ascontiguousarray(x[:, block * per_block : (block + 1) * per_block])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([block] * len(x), pa.int32()), pa.array([r.tobytes() for r in part])],
                    names=["is_validation", "batch", "at", "block", "cells"],
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "is_validation", "batch", "block"):
            cells = b"".join(row for part in group for row in part.column(4).to_pylist())
            names = "is_validation", "batch", "block"
            own = [group[0].column(group[0].schema.get_field_index(name)).slice(0, 1) for name in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array([cells], pa.binary())], names=[*names, "cells"])

    # Equal keys follow their cells, so that only equal rows can change places.
    at = F.struct(F.xxhash64(F.lit(3), key), F.xxhash64("features"))
    parts = F.when(F.col("is_validation"), n_valid).otherwise(n_train)
    spread = matrix.select(
        "is_validation", F.pmod(F.xxhash64(F.lit(5), key), parts).cast("int").alias("batch"), at.alias("at"), "features"
    )
    kind = spread.schema["at"].dataType.simpleString()
    rows = spread.mapInArrow(cut, f"is_validation boolean, batch int, at {kind}, block int, cells binary")
    group = ("is_validation", "batch", "block")
    rows.repartition(*group).sortWithinPartitions(*group, "at").mapInArrow(pack, _CELLS).write.partitionBy(
        "is_validation", "batch"
    ).parquet(path)


# --- the jobs of a step -------------------------------------------------------


def _hidden(state: Arrays) -> list[Arrays]:
    """The arrays of each hidden layer, by name."""
    stages: list[Arrays] = [{} for _ in {name.split(".")[0] for name in state}]
    for name, value in state.items():
        s, part = name.split(".")
        stages[int(s)][part] = value
    return stages


def _forward(stages: list[Arrays], z: np.ndarray, keep: float, rng) -> tuple[np.ndarray, list[tuple]]:
    """Activations of the last hidden layer with what the way back needs; inference without ``rng``."""
    h, tape = z, []
    for s, stage in enumerate(stages):
        z = (h @ stage["kernel"] if s else h) + stage["bias"]
        a = np.maximum(z, 0.0)
        if rng is None:
            unit = (a - stage["moving_mean"]) / np.sqrt(stage["moving_var"] + NORM_EPSILON)
            h = stage["gamma"] * unit + stage["beta"]
            continue
        mean, var = a.mean(axis=0), a.var(axis=0)
        inv = 1.0 / np.sqrt(var + NORM_EPSILON)
        unit = (a - mean) * inv
        mask = (rng.random(a.shape) < keep) / keep
        tape.append((h, z, unit, inv, mask, mean, var))
        h = (stage["gamma"] * unit + stage["beta"]) * mask
    return h, tape


def _backward(stages: list[Arrays], tape: list[tuple], grad: np.ndarray, rate: float, step: int) -> np.ndarray:
    """One optimiser step of the hidden layers; returns the gradient at the sums of the first one."""
    for s in range(len(stages) - 1, -1, -1):
        stage, (h, z, unit, inv, mask, mean, var) = stages[s], tape[s]
        grad = grad * mask
        grads = {"gamma": (grad * unit).sum(axis=0), "beta": grad.sum(axis=0)}
        g = grad * stage["gamma"]
        grad = inv * (g - g.mean(axis=0) - unit * (g * unit).mean(axis=0)) * (z > 0)
        grads["bias"] = grad.sum(axis=0)
        back = grad
        if s:
            grads["kernel"] = h.T @ grad
            back = grad @ stage["kernel"].T
        adam(stage, grads, rate, step)
        for name, value in (("moving_mean", mean), ("moving_var", var)):
            stage[name] += (1 - NORM_MOMENTUM) * (value - stage[name])
        grad = back
    return grad


@dataclass
class _Jobs:
    """The jobs over one batch, for all active trials at once."""

    spark: SparkSession
    cells: str
    active: dict[int, Config]
    n_features: int
    used: list[str] = field(default_factory=list)

    def _new(self, name: str) -> str:
        self.used.append(f"{self.cells}-work/{name}-{len(self.used)}")
        return self.used[-1]

    def _small(self, df: DataFrame, values: int) -> DataFrame:
        return F.broadcast(df) if values * 8 <= BROADCAST_BYTES else df

    def _batch(self, validation: bool, batch: int) -> DataFrame:
        path = f"{self.cells}/is_validation={str(validation).lower()}/batch={batch}"
        return self.spark.read.schema("block int, cells binary").parquet(path)

    def outer(self, state: str, batch: tuple[bool, int, int], given: DataFrame | None, work: Callable, path: str) -> str:
        """``work(state, cells, given)`` on every block: its new state and what is added up per trial."""
        validation, number, rows = batch
        own = _kind(self.spark, state, "state").filter(F.col("trial_id").isin(list(self.active)))
        joined = own.join(self._small(self._batch(validation, number), rows * self.n_features), "block")
        if given is not None:
            widest = max(max(c.units(self.n_features)[:-1]) for c in self.active.values())
            side = given.select("trial_id", F.col("data").alias("given"))
            joined = joined.join(self._small(side, rows * widest * len(self.active)), "trial_id")
        else:
            joined = joined.withColumn("given", F.lit(None).cast("binary"))
        active = self.active

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, Arrays] = {}
            task = TaskContext.get().partitionId()
            for whole in batches:
                for i in range(len(whole)):
                    row = whole.slice(i, 1).to_pylist()[0]
                    trial, arrays = row["trial_id"], _load(row["data"])
                    x = np.frombuffer(row["cells"]).reshape(rows, -1)
                    more = _load(row["given"]) if row["given"] is not None else {}
                    new, part = work(active[trial], arrays, x, more)
                    if new is not None:
                        yield _rows(("state", trial, row["block"], _dump(new)))
                    if part:
                        so_far = sums.get(trial)
                        sums[trial] = part if so_far is None else {k: so_far[k] + v for k, v in part.items()}
            for trial, part in sums.items():
                yield _rows(("part", trial, task, _dump(part)))

        order = joined.select("trial_id", "block", "data", "cells", "given")
        return _store(order.mapInArrow(run, _ROW), path)

    def hidden(self, state: str, others: list[DataFrame], work: Callable, path: str) -> str:
        """``work(trial, state, sums of the other tables)`` in one task per trial."""
        own = _kind(self.spark, state, "state").filter(F.col("trial_id").isin(list(self.active)))
        rows = own.withColumn("place", F.lit(0))
        for place, other in enumerate(others):
            rows = rows.unionByName(other.withColumn("place", F.lit(place + 1)))
        active = self.active

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in grouped(batches, "trial_id"):
                arrays, sums, trial = {}, {}, None
                for part in group:
                    for i in range(len(part)):
                        row = part.slice(i, 1).to_pylist()[0]
                        trial = row["trial_id"]
                        if row["place"] == 0:
                            arrays = _load(row["data"])
                            continue
                        for name, value in _load(row["data"]).items():
                            sums[name] = sums[name] + value if name in sums else value
                for kind, out in work(active[trial], arrays, sums).items():
                    yield _rows((kind, trial, 0, _dump(out)))

        # In the order of the blocks, so that a repeated task adds up to the same bits.
        dealt = rows.repartition("trial_id").sortWithinPartitions("trial_id", "place", "block")
        return _store(dealt.mapInArrow(run, _ROW), path)


def _sums_of_first(config: Config, arrays: Arrays, x: np.ndarray, more: Arrays) -> tuple:
    return None, {"z": x @ arrays["kernel"]}


def _step(
    jobs: _Jobs, state: dict[str, str], batch: int, rows: int, step: int, seed: int, names: dict[str, str]
) -> tuple[dict[str, str], dict[int, float]]:
    """One optimiser step of all active trials; the new tables and the loss of the batch."""
    n_cells = rows * jobs.n_features
    at = (False, batch, rows)

    def draws(config: Config):
        return np.random.default_rng([seed, config.trial_id, step])

    def ahead(config: Config, arrays: Arrays, sums: Arrays) -> dict[str, Arrays]:
        h, _ = _forward(_hidden(arrays), sums["z"], 1.0 - config.dropout_rate, draws(config))
        return {"z": {"z": sums["z"]}, "h": {"h": h}}

    def last(config: Config, arrays: Arrays, x: np.ndarray, more: Arrays) -> tuple:
        gap = more["h"] @ arrays["kernel"] + arrays["bias"] - x
        grad = 2.0 * gap / n_cells
        back = grad @ arrays["kernel"].T
        adam(arrays, {"kernel": more["h"].T @ grad, "bias": grad.sum(axis=0)}, config.learning_rate, step)
        return arrays, {"grad": back, "sse": np.array((gap * gap).sum())}

    def back(config: Config, arrays: Arrays, sums: Arrays) -> dict[str, Arrays]:
        stages = _hidden(arrays)
        _, tape = _forward(stages, sums["z"], 1.0 - config.dropout_rate, draws(config))
        grad = _backward(stages, tape, sums["grad"], config.learning_rate, step)
        new = {f"{s}.{k}": v for s, stage in enumerate(stages) for k, v in stage.items()}
        return {"state": new, "dz": {"dz": grad}, "loss": {"sse": sums["sse"]}}

    def first(config: Config, arrays: Arrays, x: np.ndarray, more: Arrays) -> tuple:
        adam(arrays, {"kernel": x.T @ more["dz"]}, config.learning_rate, step)
        return arrays, {}

    spark = jobs.spark
    sums = jobs.outer(state["first"], at, None, _sums_of_first, jobs._new("sums"))
    middle = jobs.hidden(state["hidden"], [_kind(spark, sums, "part")], ahead, jobs._new("ahead"))
    new_last = jobs.outer(state["last"], at, _kind(spark, middle, "h"), last, names["last"])
    gradients = [_kind(spark, middle, "z"), _kind(spark, new_last, "part")]
    new_hidden = jobs.hidden(state["hidden"], gradients, back, names["hidden"])
    new_first = jobs.outer(state["first"], at, _kind(spark, new_hidden, "dz"), first, names["first"])
    losses = {
        r["trial_id"]: float(_load(r["data"])["sse"]) / n_cells for r in _kind(spark, new_hidden, "loss").collect()
    }
    return {"first": new_first, "hidden": new_hidden, "last": new_last}, losses


def _validate(jobs: _Jobs, state: dict[str, str], sizes: dict[int, int]) -> dict[int, float]:
    """Mean squared error of the held-out rows, without dropout and with the stored normalisation."""

    def ahead(config: Config, arrays: Arrays, sums: Arrays) -> dict[str, Arrays]:
        return {"h": {"h": _forward(_hidden(arrays), sums["z"], 1.0, None)[0]}}

    def last(config: Config, arrays: Arrays, x: np.ndarray, more: Arrays) -> tuple:
        gap = more["h"] @ arrays["kernel"] + arrays["bias"] - x
        return None, {"sse": np.array((gap * gap).sum())}

    total = dict.fromkeys(jobs.active, 0.0)
    for batch, rows in sizes.items():
        at = (True, batch, rows)
        sums = jobs.outer(state["first"], at, None, _sums_of_first, jobs._new("sums"))
        middle = jobs.hidden(state["hidden"], [_kind(jobs.spark, sums, "part")], ahead, jobs._new("ahead"))
        given = _kind(jobs.spark, middle, "h")
        found = jobs.outer(state["last"], at, given, last, jobs._new("errors"))
        # One number per trial and task.
        for r in _kind(jobs.spark, found, "part").collect():
            total[r["trial_id"]] += float(_load(r["data"])["sse"])
    cells = sum(sizes.values()) * jobs.n_features
    return {trial: sse / cells for trial, sse in total.items()} if cells else {}


# --- the run --------------------------------------------------------------------


@dataclass
class _Trial:
    """What a commit says about one trial."""

    config: Config
    state: dict[str, str]
    steps: int = 0
    history: list[tuple] = field(default_factory=list)
    best: tuple[float, dict[str, str]] | None = None
    waited: int = 0
    stopped: bool = False

    def row(self) -> tuple:
        best_loss, best = self.best or (None, {})
        last = self.history[-1]
        parts = ("first", "last", "hidden")
        return (
            self.config.trial_id, *last, self.steps, *(self.state[p] for p in parts),
            best_loss, *(best.get(p) for p in parts), self.waited, self.stopped,
        )

    def take(self, r) -> None:
        parts = ("first", "last", "hidden")
        self.state, self.steps = {p: r[p] for p in parts}, r["steps"]
        if r["best_loss"] is not None:
            self.best = (r["best_loss"], {p: r[f"best_{p}"] for p in parts})
        self.waited, self.stopped = r["waited"], r["stopped"]
        self.history.append((r["epoch"], r["loss"], r["val_loss"], r["epoch_seconds"]))


@dataclass
class WideFitted:
    """Trained models whose weights stay in stored tables."""

    spark: SparkSession
    trials: list[_Trial]
    n_features: int
    per_block: int

    @property
    def progress(self) -> list[_Trial]:
        return self.trials

    def history(self, spark: SparkSession) -> DataFrame:
        rows = [(t.config.trial_id, *h) for t in self.trials for h in t.history]
        return spark.createDataFrame(rows, HISTORY_SCHEMA)

    def layers(self, spark: SparkSession, prefix: str = "trial_") -> DataFrame:
        given = [(t.config, f"{prefix}{t.config.trial_id}") for t in self.trials]
        return layers_table(spark, [(n, self.n_features, c.layer_config, c.encoding_dim) for c, n in given])

    def weights(self, spark: SparkSession, prefix: str = "trial_") -> DataFrame:
        """The weight table; rows of the last kernel are put together from their blocks."""
        found = None
        for t in self.trials:
            state = t.best[1] if t.stopped and t.best else t.state
            own = self._weights_of(spark, t.config, state, f"{prefix}{t.config.trial_id}")
            found = own if found is None else found.unionByName(own)
        return found

    def _weights_of(self, spark: SparkSession, config: Config, state: dict[str, str], model: str) -> DataFrame:
        per_block, last_layer = self.per_block, 1 + 3 * (len(config.units(self.n_features)) - 1)

        def rows(which: str) -> Callable:
            def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(len(batch)):
                        row = batch.slice(i, 1).to_pylist()[0]
                        for name, value in _load(row["data"]).items():
                            if name.rsplit(".")[-1][:2] in ("m_", "v_"):
                                continue
                            stage, part = name.split(".") if which == "hidden" else (0, name)
                            layer = last_layer if which == "last" else 1 + 3 * int(stage)
                            first = row["block"] * per_block if which == "first" else 0
                            block = np.atleast_2d(value)
                            n = len(block)
                            columns = [
                                pa.array([layer] * n, pa.int32()), pa.array([part] * n),
                                pa.array(range(first, first + n), pa.int32()), pa.array([row["block"]] * n, pa.int32()),
                                pa.array(list(block), pa.list_(pa.float64())),
                            ]
                            yield pa.RecordBatch.from_arrays(columns, names=["layer_idx", "part", "row_idx", "block", "w"])

            return emit

        schema = "layer_idx int, part string, row_idx int, block int, w array<double>"
        read = {
            which: _kind(spark, path, "state").filter(F.col("trial_id") == config.trial_id).mapInArrow(rows(which), schema)
            for which, path in state.items()
        }
        whole = read["first"].unionByName(read["hidden"]).drop("block")
        # A row of the last kernel has one piece per block.
        pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "w"))), lambda p: p["w"])
        joined = read["last"].groupBy("layer_idx", "part", "row_idx").agg(F.flatten(pieces).alias("w"))
        named = whole.unionByName(joined).withColumn("model", F.lit(model))
        return named.select(*[c.split()[0] for c in WEIGHTS_SCHEMA.split(", ")])

    def models(self) -> list[tuple[int, list[dict]]]:
        """(trial, stages); kernels above the limit of a worker are mapped."""
        layers, weights = self.layers(self.spark), self.weights(self.spark)
        return [
            (t.config.trial_id, load_stages(layers, weights, f"trial_{t.config.trial_id}")) for t in self.trials
        ]


def fit_wide(
    matrix: DataFrame,
    configs: Sequence[Config],
    *,
    epochs: int = EPOCHS,
    patience: int = PATIENCE,
    share: float = VALIDATION_SHARE,
    seed: int = 0,
    key: str = "row_id",
    run_dir: str | None = None,
    block_features: int | None = None,
    batch_rows: int | None = None,
) -> WideFitted:
    """Train configurations of any width; see ``training.fit_grid`` for what the settings mean.

    A batch has ``batch_rows`` rows on average (the largest batch size of the trials by default); which rows
    it has follows from their keys. With the ``run_dir`` of an earlier call training goes on after its last
    committed epoch.
    """
    spark = matrix.sparkSession
    ship_package(spark)
    n_features = width_of(matrix)
    widest = max(max(c.units(n_features)[:-1]) for c in configs)
    per_block = block_features or max(1, BLOCK_BYTES // (8 * widest))
    run = (run_dir or scratch_path(spark, "run")).rstrip("/")
    trials = [_Trial(c, {}) for c in configs]
    done = _restore(spark, run, trials)
    cells = f"{run}/cells"
    if not path_exists(spark, f"{cells}/_SUCCESS"):
        remove_path(spark, cells)
        marked = split(matrix, share, key)
        counts = {r["is_validation"]: r["count"] for r in marked.groupBy("is_validation").count().collect()}
        for part, wanted in ((False, True), (True, share > 0)):
            if wanted and not counts.get(part):
                raise ValueError(f"no {'validation' if part else 'training'} rows; set share to fit the table")
        rows = batch_rows or max(c.batch_size for c in configs)
        n_train, n_valid = math.ceil(counts[False] / rows), math.ceil(counts.get(True, 0) / VALIDATION_ROWS)
        _batches(marked, key, per_block, n_train, max(1, n_valid), cells)
    first = spark.read.parquet(cells).filter("block = 0")
    width = min(per_block, n_features) * 8
    # One number per batch.
    sized = first.select(
        (F.col("is_validation").cast("string") == "true").alias("held_out"),
        "batch",
        (F.length("cells") / width).cast("int").alias("rows"),
    ).collect()
    sizes = {v: {r["batch"]: r["rows"] for r in sorted(sized) if r["held_out"] == v} for v in (False, True)}
    if not done:
        start = dict(zip(("first", "hidden", "last"), _initial_once(spark, configs, n_features, per_block, seed, run)))
        for t in trials:
            t.state = start
    for epoch in range(done + 1, epochs + 1):
        active = [t for t in trials if not t.stopped]
        if not active:
            break
        began = time.perf_counter()
        jobs = _Jobs(spark, cells, {t.config.trial_id: t.config for t in active}, n_features)
        state, step = active[0].state, active[0].steps
        losses, seen = dict.fromkeys(jobs.active, 0.0), 0
        kept = set(state.values())
        for batch, rows in sizes[False].items():
            step += 1
            names = {part: f"{run}/{part}-{step}" for part in state}
            for path in names.values():  # what an interrupted run left behind
                remove_path(spark, path)
            new, found = _step(jobs, state, batch, rows, step, seed, names)
            for trial, loss in found.items():
                losses[trial] += loss * rows
            seen += rows
            for path in set(state.values()) - kept - _named(trials):
                remove_path(spark, path)
            state = new
        validation = _validate(jobs, state, sizes[True])
        remove_path(spark, f"{cells}-work")
        seconds = time.perf_counter() - began
        for t in active:
            trial = t.config.trial_id
            loss = validation.get(trial)
            t.state, t.steps = state, step
            t.history.append((epoch, losses[trial] / seen, loss, seconds))
            if loss is None:
                continue
            if loss < (math.inf if t.best is None else t.best[0]):
                t.best, t.waited = (loss, state), 0
            else:
                t.waited += 1
                t.stopped = t.waited >= patience
        spark.createDataFrame([t.row() for t in active], _COMMIT).coalesce(1).write.mode("overwrite").parquet(
            f"{run}/commits/{epoch}"
        )
        for path in kept - _named(trials):
            remove_path(spark, path)
    return WideFitted(spark, trials, n_features, per_block)


def _named(trials: list[_Trial]) -> set[str]:
    """The tables that the last commit of some trial needs."""
    found = {path for t in trials for path in t.state.values()}
    return found | {path for t in trials if t.best for path in t.best[1].values()}


def _initial_once(spark: SparkSession, configs, n_features: int, per_block: int, seed: int, run: str):
    for part in ("first", "hidden", "last"):
        remove_path(spark, f"{run}/{part}-0")
    return _initial(spark, configs, n_features, per_block, seed, run)


def _restore(spark: SparkSession, run: str, trials: list[_Trial]) -> int:
    """Take over the committed epochs of a run; how many there are."""
    by_id = {t.config.trial_id: t for t in trials}
    epoch = 0
    while path_exists(spark, f"{run}/commits/{epoch + 1}/_SUCCESS"):
        epoch += 1
        for r in spark.read.schema(_COMMIT).parquet(f"{run}/commits/{epoch}").collect():
            by_id[r["trial_id"]].take(r)
    return epoch
