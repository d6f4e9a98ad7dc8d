"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: each stored row is a segment of whole documents with its
sorted terms and, per term, the ascending list of positions. Segments have a bounded size
(or hold one document), so a frequent word is many short lists in many tasks. Documents
of a segment are kept one position apart, so no match spans two of them.

A search sends blocks of test items of bounded size to all segments. In a segment all windows
are matched at once: the list of a window's rarest term, shifted by its offset, is intersected
with the shifted lists of its other terms from rare to frequent. Nothing is shuffled unless
there are several blocks.

Defined results: words are runs of ASCII letters and digits and of characters beyond ASCII,
lower-cased in A-Z. A null or empty text has no words; an item without words has no window, and
items with equal ids are one item. A null item id counts as the string ``null``. An item of
fewer than ``width`` words is one window. Repeated rows get a row each. Empty tables give an
empty result, or no hits. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.llm.byte_bpe import ragged
from broadloom.llm.rows import prepare, text_tag, without
from broadloom.llm.textarrays import ALNUM, Words, chunks, words, words_in_parts
from broadloom.session import materialize, scratch_path

WIDTH = 10
SEGMENT_BYTES = 2 << 20
#: Bytes of test items that are collected and broadcast at a time.
BLOCK_BYTES = 32 << 20

_SEGMENT = (
    "docs array<long>, tags array<long>, n_words array<int>, terms binary, counts binary, positions binary, segment long"
)


def build_index(docs: DataFrame, path: str | None = None, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Store the postings of all words of all texts and return the stored segments."""
    spark = docs.sparkSession
    prepare(spark)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, n, data, offsets in chunks(batch.column(1), segment_bytes):
                ids = [batch.column(i).slice(row, n) for i in (0, 2)]
                yield _segment(*ids, words_in_parts(data, offsets, ALNUM), number)
                number += 1

    own = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["text"].cast("string").alias("text"),
        text_tag(docs).alias("tag"),
    )
    path = path or scratch_path(spark, "postings")
    # Segments are large values: small row groups keep the writers' memory small.
    own.mapInArrow(index, _SEGMENT).write.option("parquet.block.size", str(8 << 20)).parquet(path)
    return spark.read.schema(_SEGMENT).parquet(path)


def _segment(doc_ids: pa.Array, tags: pa.Array, found: Words, number: int) -> pa.RecordBatch:
    n_words = np.diff(found.first)
    # One free position after each document.
    position = np.arange(len(found.hashes)) + np.repeat(np.arange(len(n_words)), n_words)
    order = np.argsort(found.hashes, kind="stable")
    terms, counts = np.unique(found.hashes[order], return_counts=True)
    columns = [
        pa.array([doc_ids.to_pylist()], pa.list_(pa.int64())),
        pa.array([tags.to_pylist()], pa.list_(pa.int64())),
        pa.array([n_words.astype(np.int32)], pa.list_(pa.int32())),
        *(
            pa.array([x.tobytes()], pa.binary())
            for x in (terms, counts.astype(np.uint32), position[order].astype(np.uint32))
        ),
        pa.array([number]),
    ]
    names = ["docs", "tags", "n_words", "terms", "counts", "positions", "segment"]
    return pa.RecordBatch.from_arrays(columns, names=names)


@dataclass
class Windows:
    """Distinct windows of some items: term numbers (-1 pads), and the items of each window."""

    vocabulary: np.ndarray
    terms: np.ndarray
    sizes: np.ndarray
    first_item: np.ndarray  # one more than windows
    items: np.ndarray
    names: list[str]


def windows_of(items: list[tuple[str, str | None]], width: int = WIDTH) -> Windows:
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    owners: dict[tuple[int, ...], set[int]] = {}
    row = 0
    column = pa.array([text for _, text in items], pa.string())
    for _, n, data, offsets in chunks(column):
        found = words(data, offsets, ALNUM)
        for i in range(n):
            own = tuple(found.hashes[found.first[i] : found.first[i + 1]].tolist())
            for k in range(max(1, len(own) - width + 1) if own else 0):
                owners.setdefault(own[k : k + width], set()).add(number[items[row + i][0]])
        row += n
    vocabulary = np.unique(np.array([t for w in owners for t in w], np.uint64))
    terms = np.full((len(owners), width), -1, np.int64)
    for k, window in enumerate(owners):
        terms[k, : len(window)] = np.searchsorted(vocabulary, np.array(window, np.uint64))
    of = [sorted(x) for x in owners.values()]
    return Windows(
        vocabulary,
        terms,
        (terms >= 0).sum(1),
        np.cumsum([0, *map(len, of)]),
        np.array([i for x in of for i in x], np.int64),
        names,
    )


class _Postings:
    """The part of a segment that concerns the terms of some windows."""

    def __init__(self, vocabulary: np.ndarray, terms: bytes, counts: bytes, positions: bytes):
        stored, counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64)
        slot = np.searchsorted(stored, vocabulary)
        known = np.zeros(len(vocabulary), bool)
        known[slot < len(stored)] = stored[slot[slot < len(stored)]] == vocabulary[slot < len(stored)]
        self.counts = np.zeros(len(vocabulary) + 1, np.int64)  # the last one is the padding
        self.counts[:-1][known] = counts[slot[known]]
        starts = (np.cumsum(counts) - counts)[slot[known]]
        all_positions = np.frombuffer(positions, np.uint32)
        self.positions = all_positions[ragged(starts, counts[slot[known]])].astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.keys = np.repeat(np.arange(len(vocabulary) + 1), self.counts) << 32 | self.positions

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(terms), bool)
        wanted = terms << 32 | positions
        slot = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[slot] == wanted) & (positions >= 0)

    def phrases(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of every occurrence of every window."""
        many = np.iinfo(np.int64).max
        rarity = np.where(terms < 0, many, self.counts[terms])
        alive = np.flatnonzero(rarity.min(1) > 0) if len(terms) else np.zeros(0, np.int64)
        order = np.argsort(rarity[alive], 1, kind="stable")
        rarest = order[:, 0] if len(alive) else np.zeros(0, np.int64)
        term = terms[alive, rarest]
        counts = self.counts[term]
        window = np.repeat(np.arange(len(alive)), counts)
        start = self.positions[ragged(self.first[term], counts)] - np.repeat(rarest, counts)
        for k in range(1, terms.shape[1]):
            offset = order[window, k]
            other = terms[alive[window], offset]
            keep = (other < 0) | self.holds(other, start + offset)
            window, start = window[keep], start[keep]
        return alive[window], start

    def near(self, terms: np.ndarray, reach: int) -> np.ndarray:
        """Positions of the rarest of ``terms`` with all others within ``reach`` words of them."""
        order = np.argsort(self.counts[terms], kind="stable")
        rarest = terms[order[0]]
        at = self.positions[self.first[rarest] : self.first[rarest] + self.counts[rarest]]
        for term in terms[order[1:]].tolist():
            own = self.positions[self.first[term] : self.first[term] + self.counts[term]]
            next_one = np.searchsorted(own, at - reach)
            inside = next_one < len(own)
            inside[inside] = own[next_one[inside]] <= at[inside] + reach
            at = at[inside]
        return at


def _items(items: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The test items by id and text, and the number of blocks of about ``block_bytes`` they make."""
    own = items.select(
        F.coalesce(items["item_id"].cast("string"), F.lit("null")).alias("item_id"),
        items["text"].cast("string").alias("text"),
    )
    return own, (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes + 1


def _block(own: DataFrame, block: int, n: int) -> list[tuple[str, str | None]]:
    """One of ``n`` blocks. The texts of an id are dealt to all of them, however many they are."""
    part = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block) if n > 1 else own
    return [(r["item_id"], r["text"]) for r in part.collect()]


def _matches(spark: SparkSession, index: DataFrame, found: Windows, spans: bool) -> DataFrame:
    """Per document its hits from one block: counts, or with ``spans`` what counts derive from."""
    shared = spark.sparkContext.broadcast(found)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            for row in range(len(batch)):
                docs, tags, n_words, terms, counts, positions, segment = (c[row] for c in batch.columns)
                doc_ids, n_words = docs.values, n_words.values.to_numpy().astype(np.int64)
                first = np.cumsum(n_words + 1) - n_words - 1
                own = _Postings(windows.vocabulary, terms.as_py(), counts.as_py(), positions.as_py())
                window, start = own.phrases(windows.terms)
                edges = np.zeros(int(n_words.sum()) + len(n_words) + 1, np.int64)
                np.add.at(edges, start, 1)
                np.add.at(edges, start + windows.sizes[window], -1)
                hit = np.cumsum(edges) > 0
                hits = np.concatenate([[0], np.cumsum(hit)])
                n_hit = hits[first + n_words] - hits[first]
                doc = np.searchsorted(first, start, "right") - 1
                per = windows.first_item[window + 1] - windows.first_item[window]
                pair = np.unique(
                    np.repeat(doc, per) * len(windows.names)
                    + windows.items[ragged(windows.first_item[window], per)]
                )
                names: list[list[str]] = [[] for _ in n_words]
                for d, i in zip(*divmod(pair, max(len(windows.names), 1)), strict=True):
                    names[d].append(windows.names[i])
                out = {
                    "doc_id": doc_ids,
                    "tag": tags.values,
                    "n_words": pa.array(n_words),
                    "items": pa.array(names, _STRINGS),
                }
                if spans:
                    at = [np.flatnonzero(hit[f : f + n]) if h else [] for f, n, h in zip(first, n_words, n_hit)]
                    out |= {
                        "segment": pa.array([segment.as_py()] * len(first)),
                        "place": pa.array(range(len(first)), pa.int32()),
                        "at": pa.array(at, pa.list_(pa.int64())),
                    }
                else:
                    out["n_hit"] = pa.array(n_hit)
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, tag long, n_words long, items array<string>"
    return index.mapInArrow(search, schema + (", segment long, place int, at array<long>" if spans else ", n_hit long"))


_STRINGS = pa.list_(pa.string())


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document the words inside occurring windows of the benchmark, and the items they are of."""
    return search_index(build_index(docs), benchmark, width, block_bytes)


def search_index(
    index: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    spark = index.sparkSession
    prepare(spark)
    own, n = _items(benchmark, block_bytes)
    if n == 1:
        hits = _matches(spark, index, windows_of(_block(own, 0, n), width), spans=False)
    else:
        hits = None
        for block in range(n):
            # Stored before the next block is collected, so that one block is in memory.
            found = materialize(_matches(spark, index, windows_of(_block(own, block, n), width), spans=True), "hits")
            hits = found if hits is None else hits.unionByName(found)
        hits = hits.groupBy("segment", "place").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("tag").alias("tag"),
            F.first("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_hit"),
        )
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "tag",
    )


def proximity(index: DataFrame, benchmark: DataFrame, reach: int) -> DataFrame:
    """(doc_id, item_id, n_near): documents with all words of an item near its rarest word.

    ``n_near`` counts the occurrences of that word with every other word of the item at most
    ``reach`` words before or after it, in any order.
    """
    spark = index.sparkSession
    prepare(spark)
    parts = []
    own, n = _items(benchmark, BLOCK_BYTES)
    for block in (_block(own, k, n) for k in range(n)):
        # A window as wide as the longest item is the item itself.
        found = windows_of(block, max([1, *(len(t or "") for _, t in block)]))
        parts.append(_near(spark, index, found, reach))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _near(spark: SparkSession, index: DataFrame, found: Windows, reach: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(found)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for row in range(len(batch)):
                docs, tags, n_words, terms, counts, positions, segment = (c[row] for c in batch.columns)
                n_words = n_words.values.to_numpy().astype(np.int64)
                first = np.cumsum(n_words + 1) - n_words - 1
                own = _Postings(items.vocabulary, terms.as_py(), counts.as_py(), positions.as_py())
                doc_ids, item_ids, n_near = [], [], []
                for k, wanted in enumerate(items.terms):
                    wanted = np.unique(wanted[wanted >= 0])
                    if (own.counts[wanted] == 0).any():
                        continue
                    # Per document, so that a reach never crosses into the next one.
                    at = own.near(wanted, reach)
                    doc = np.searchsorted(first, at, "right") - 1
                    for d in np.unique(doc).tolist():
                        low, high = first[d], first[d] + n_words[d]
                        n = sum(_all_near(own, wanted, p, max(low, p - reach), min(high - 1, p + reach)) for p in at[doc == d].tolist())
                        for i in items.items[items.first_item[k] : items.first_item[k + 1]].tolist() if n else ():
                            doc_ids.append(docs.values[d].as_py())
                            item_ids.append(items.names[i])
                            n_near.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(item_ids, pa.string()), pa.array(n_near, pa.int64())],
                    names=["doc_id", "item_id", "n_near"],
                )

    return index.mapInArrow(search, "doc_id long, item_id string, n_near long")


def _all_near(own: _Postings, terms: np.ndarray, at: int, low: int, high: int) -> bool:
    return bool((np.searchsorted(own.keys, terms << 32 | high, "right") > np.searchsorted(own.keys, terms << 32 | low)).all())


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without any hit, with all their columns."""
    found = contamination(docs, benchmark, width)
    return without(docs, found.filter("contaminated"))
