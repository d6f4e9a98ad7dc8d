"""Best-fit packing of documents into sequences, certified by lower bounds.

1. Every text is encoded once; documents longer than a sequence are cut into full pieces after a
   shorter first one. Full pieces are sequences of their own and take part in no shuffle.
2. The other pieces are dealt evenly into groups of bounded size. Each group is packed by
   best-fit decreasing, and dual feasible functions give a lower bound of its number of bins. A
   group that meets its bound is certified: nothing can pack it better.
3. Groups with a gap give up all documents of their bins that are not full. These are dealt anew
   across groups and packed again, as long as that saves bins.

Only counts and bounds reach the driver. A group holds at most about ``GROUP_ROWS`` piece
descriptions of some 50 bytes, never token ids, so neither a hot id nor a huge text matters.

Defined results: a null or empty text is one piece of the end token alone. Repeated rows
are packed once each. Ties of length are packed in order of (doc_id, piece). An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.llm.byte_bpe import encoder
from broadloom.llm.rows import prepare
from broadloom.session import materialize

SEQUENCE = 2048
END = 0
GROUP_ROWS = 32_768
ROUNDS = 4

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long"
_PLACED = f"{_PIECE}, bin long, offset long, bins long, bound long, free long"


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, ids: bool = False) -> DataFrame:
    """The pieces of every document; ``slot`` is a number of their own. With ``ids`` the tokens too."""
    prepare(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "slot"] + ["ids"] * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row, tokens, counts in encoder(tokenizer).encode(batch.column(1)):
                out: dict[str, list] = {name: [] for name in names}
                end = 0
                for doc_id, n in zip(doc_ids[row : row + len(counts)], counts.tolist(), strict=True):
                    own = np.append(tokens[end : end + n], END).astype("<u4")
                    end += n
                    cuts = [0, *range((n + 1) % size or size, n + 2, size)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        part = own[a:b]
                        values = (doc_id, k, a, b - a, zlib.crc32(part.tobytes()), slot, part)
                        slot += 1
                        for name, value in zip(names, values, strict=False):
                            out[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[n], _TYPES[n]) for n in names], names=names
                )

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return own.mapInArrow(cut, _PIECE + ", ids array<int>" * ids)


_TYPES = {
    "doc_id": pa.int64(),
    "piece": pa.int32(),
    "start": pa.int64(),
    "length": pa.int64(),
    "ids_crc32": pa.int64(),
    "slot": pa.int64(),
    "ids": pa.list_(pa.int32()),
}


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """No packing of ``lengths`` into bins of ``size`` has fewer bins.

    The best of two families of dual feasible functions: one drops items below a threshold and
    rounds those that leave less than it up to a whole bin, the other rounds x to
    floor((k + 1) x) / k unless (k + 1) x is whole. They are also applied one after the other.
    """
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    best = -(-int((count * x).sum()) // size)
    present = x[(count > 0) & (x <= size // 2)]
    thresholds = np.unique(np.concatenate([[0], present[:: max(1, len(present) // 128)]]))
    for low in thresholds.tolist():
        value = np.where(x > size - low, size, np.where(x < low, 0, x))
        best = max(best, -(-int((count * value).sum()) // size))
        for k in (1, 2, 3, 4, 5, 7, 9):
            scaled = (k + 1) * value
            rounded = np.where(scaled % size == 0, value * k, scaled // size * size)
            best = max(best, -(-int((count * rounded).sum()) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the free room of each bin.

    A bit of ``rooms`` stands for "some bin has this much room", so the fullest bin that
    still takes an item is the lowest set bit from its length on.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, free = 0, []
    for item, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = size, len(free)
            free.append(size)
        bins[item], offsets[item] = at, size - room
        left = room - length
        free[at] = left
        if left:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def _pack_groups(items: DataFrame, rows: int, turn: int, size: int) -> DataFrame:
    """Deal ``rows`` items into groups and pack each; bins are numbered per turn and group."""
    groups = -(-rows // GROUP_ROWS)
    dealt = items.withColumn("grp", F.pmod(F.xxhash64("slot", F.lit(turn)), F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("slot", "ascending")])
        lengths = table.column("length").to_numpy()
        own, offsets, free = best_fit(lengths, size)
        first = (turn << 56) + (table.column("grp")[0].as_py() << 28)
        n = len(lengths)
        table = table.drop_columns("grp")
        for name, values in (
            ("bin", own + first),
            ("offset", offsets),
            ("bins", np.full(n, len(free))),
            ("bound", np.full(n, lower_bound(lengths, size))),
            ("free", free[own]),
        ):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return dealt.groupBy("grp").applyInArrow(pack, _PLACED)


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """One row per piece with its sequence and place; see the module for the method.

    Further columns: ``bound_gap``, how many sequences the piece's group uses beyond its lower
    bound (0: certified).
    """
    cut = materialize(pieces(docs, tokenizer, size), "pieces")
    whole = cut.filter(F.col("length") == size).selectExpr(
        "doc_id", "piece", "start", "length", "ids_crc32", "-1 - slot sequence_id", "0L offset", "0L bound_gap"
    )
    todo = cut.filter(F.col("length") < size)
    rows, placed, used = todo.count(), [], None
    for turn in range(ROUNDS):
        if not rows:
            break
        # Past turns stored what they settled; this one may only replace what they left open.
        packed = materialize(_pack_groups(todo, rows, turn, size), "packed")
        bins = packed.select("bin").distinct().count()
        if used is not None and bins >= used:
            break
        if placed:
            placed[-1] = placed[-1].filter(~_open())
        placed.append(packed)
        stay = packed.filter(_open()).agg(
            F.count("*").alias("rows"), F.count_distinct("bin").alias("bins")
        ).first()
        todo = packed.filter(_open()).select("doc_id", "piece", "start", "length", "ids_crc32", "slot")
        if rows <= GROUP_ROWS:  # one group: it has nobody to exchange with
            break
        rows, used = stay["rows"], stay["bins"]
    for part in placed:
        whole = whole.unionByName(
            part.select(
                "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset",
                (F.col("bins") - F.col("bound")).alias("bound_gap"),
            )
        )
    return whole


def _open():
    return (F.col("bins") > F.col("bound")) & (F.col("free") > 0)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """The token ids of every sequence; ``docs`` must have distinct ids."""
    parts = pieces(docs, tokenizer, size, ids=True).select("doc_id", "piece", "ids")
    return (
        placed.join(parts, ["doc_id", "piece"])
        .groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
    )
