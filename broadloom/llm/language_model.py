"""Language-model scores of texts: word bigrams mixed by deleted interpolation.

    p(w | v) = a(b) c(v, w) / c(v) + u(b) c(w) / N + z(b) / (V + 1)

The maximum-likelihood estimates come from the training texts. The weights depend on the bucket ``b`` of
the context, its frequency in powers of two, and are learned by expectation-maximisation: one training
text in ``HELD_OUT`` (by a hash of the text, so copies stay together) is deleted from the counts, and
the weights maximise the likelihood of its bigrams under the counts of the others.

Counts are looked up by the documents, not carried to them:

1. Documents become blocks of about ``BLOCK_TOKENS`` tokens in a vocabulary of their own, stored in the
   shared folder. Deleted texts have blocks of their own.
2. Every block asks for the counts of its distinct words and bigrams, 64-bit keys sorted and packed, and brings
   its own counts along. A part holds all requests of a range of keys, adds the counts up and answers
   in the order of the request. However frequent a word is, it is one key per block. The number of parts
   grows with the corpus; nothing of it is left out or broadcast.
3. Blocks meet their answers. Deleted blocks give the table of held-out events for the weights, which is
   read once per round of the maximisation; then every block scores its documents.

Only totals and the weights of at most ``BUCKETS`` buckets reach the driver.

Defined results: words are runs of characters other than ASCII white space, A-Z lower-cased; every text
ends with one more token. A null or empty text has this token only. Rows are not trained on where
``trained`` is null. Without training texts every token has the probability 1/(V+1) = 1; without deleted ones
the weights of a bucket are equal. Words, like bigrams, are told apart by 64-bit hashes. Repeated rows get
a row each and count as often as they come. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.llm.rows import prepare, text_tag
from broadloom.llm.textarrays import SPACED, chunks, grouped, mix, release, words_in_parts
from broadloom.session import materialize, scratch_path

BLOCK_TOKENS = 1_000_000
#: Tokens of the corpus per part of the key space; bounds what a counting task holds.
PART_TOKENS = 2_000_000
#: Parts, or blocks, that a task takes one after the other.
PER_TASK = 4
HELD_OUT = 10
#: Context frequencies 0, 1, 2-3, 4-7, ...
BUCKETS = 65
ROUNDS = 40
#: The maximisation ends when the mean log-likelihood of an event grows by less.
ENOUGH = 1e-6

_U = np.uint64
_END = _U(0x3C79AC492BA7B653)
_BEGIN = _U(0x1C69B3F74AC4AE35)

_BLOCK = (
    "block long, deleted boolean, docs array<long>, tags array<long>, trained binary, sizes binary, "
    "vocabulary binary, tokens binary, n_tokens long, train_docs long, train_tokens long"
)
_REQUEST = "level int, part int, block long, deleted boolean, keys binary, counts binary"
_ANSWER = "level int, part int, block long, deleted boolean, kept binary, trained binary, n_known long"


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in little room: their bytes plane by plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    size = np.dtype(kind).itemsize
    return np.frombuffer(planes, np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


class _Collector:
    """Gathers documents until they make a block."""

    def __init__(self, deleted: bool):
        self.deleted = deleted
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.n_tokens = 0

    def add(self, docs: np.ndarray, tags: np.ndarray, trained: np.ndarray, sizes: np.ndarray, tokens: np.ndarray):
        if len(sizes):
            self.parts.append((docs, tags, trained, sizes, tokens))
            self.n_tokens += len(tokens)

    def block(self, number: int) -> pa.RecordBatch:
        docs, tags, trained, sizes, tokens = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.clear()
        vocabulary, ids, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        # Frequent words get small numbers, which pack better.
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        columns = {
            "block": number,
            "deleted": self.deleted,
            "docs": docs.tolist(),
            "tags": tags.tolist(),
            "trained": packed(trained.astype(np.uint8)),
            "sizes": packed(sizes),
            "vocabulary": packed(vocabulary[order]),
            "tokens": packed(place[ids]),
            "n_tokens": len(tokens),
            "train_docs": int(trained.sum()),
            "train_tokens": int(sizes[trained].sum()),
        }
        return pa.RecordBatch.from_arrays(
            [pa.array([v], _TYPES.get(k)) for k, v in columns.items()], names=list(columns)
        )


_TYPES = {"docs": pa.list_(pa.int64()), "tags": pa.list_(pa.int64())}


def _blocks(docs: DataFrame, trained: Column, block_tokens: int) -> DataFrame:
    """Stored blocks of tokenised documents; ids that are null stay null."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks = [_Collector(False), _Collector(True)]
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, n, data, offsets in chunks(batch.column(1)):
                part = batch.slice(row, n)
                found = words_in_parts(data, offsets, SPACED)
                tokens = np.insert(found.hashes, found.first[1:], _END)
                sizes = np.diff(found.first) + 1
                kind = part.column(2).to_numpy(zero_copy_only=False)
                ids = np.array(part.column(0).to_pylist(), object)
                tags = part.column(3).to_numpy()
                for block, own in zip(open_blocks, (kind < 2, kind == 2), strict=True):
                    block.add(ids[own], tags[own], kind[own] > 0, sizes[own], tokens[np.repeat(own, sizes)])
                    if block.n_tokens >= block_tokens:
                        yield block.block(number)
                        number += 1
        for block in open_blocks:
            if block.parts:
                yield block.block(number)
                number += 1
        release()

    chosen = F.coalesce(trained, F.lit(False))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    deleted = F.pmod(F.xxhash64(F.lit(12), text), F.lit(HELD_OUT)) == 0
    own = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        text.alias("text"),
        F.when(chosen & deleted, 2).when(chosen, 1).otherwise(0).alias("kind"),
        text_tag(docs).alias("tag"),
    )
    path = scratch_path(docs.sparkSession, "blocks")
    # Blocks are large values: small row groups keep the writers' memory small.
    own.mapInArrow(build, _BLOCK).write.option("parquet.block.size", str(8 << 20)).parquet(path)
    return docs.sparkSession.read.schema(_BLOCK).parquet(path)


class _Block:
    """A stored block with its distinct words and bigrams, both in the order of their keys."""

    def __init__(self, row: dict):
        self.row = row
        self.vocabulary = unpacked(row["vocabulary"], "u8")
        self.tokens = unpacked(row["tokens"], "u4").astype(np.int64)
        self.sizes = unpacked(row["sizes"], "i8")
        self.trained = unpacked(row["trained"], "u1").astype(bool)

    @cached_property
    def first(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (context, word) codes, and the number of the code at every token."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first] = len(self.vocabulary)  # the beginning of a text
        return np.unique(before * len(self.vocabulary) + self.tokens, return_inverse=True)

    @cached_property
    def contexts(self) -> np.ndarray:
        return self._pairs[0] // len(self.vocabulary)

    @cached_property
    def words(self) -> np.ndarray:
        return self._pairs[0] % len(self.vocabulary)

    @cached_property
    def at(self) -> np.ndarray:
        return self._pairs[1].reshape(-1)

    def keys(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys, and the order that sorts words (level 1) or pairs (level 2) so."""
        if level == 1:
            keys = mix(self.vocabulary ^ _U(0xD1B54A32D192ED03))
        else:
            hashes = np.append(self.vocabulary, _BEGIN)
            keys = mix(mix(hashes[self.contexts]) * _U(0x9FB21C651E98DF25) + hashes[self.words])
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def counts(self, level: int) -> np.ndarray:
        """How often the training texts of this block have each word or pair."""
        if self.row["train_docs"] == 0:
            return np.zeros(len(self.vocabulary if level == 1 else self.words), np.int64)
        inside = np.repeat(self.trained, self.sizes)
        numbers = (self.tokens if level == 1 else self.at)[inside]
        return np.bincount(numbers, minlength=len(self.vocabulary if level == 1 else self.words))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> _U(32)) * _U(parts)) >> _U(32)


def _requests(blocks: DataFrame, parts: int) -> DataFrame:
    """Per block, level and part: keys as differences, and the block's own training counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block = _Block(batch.slice(i, 1).to_pylist()[0])
                for level in (1, 2):
                    keys, order = block.keys(level)
                    counts = block.counts(level)[order]
                    owner = _part(keys, parts)
                    bounds = np.flatnonzero(np.diff(owner, prepend=_U(parts)))
                    rows = []
                    for low, high in zip(bounds.tolist(), [*bounds[1:].tolist(), len(keys)], strict=True):
                        steps = np.diff(keys[low:high], prepend=_U(0))
                        rows.append((level, int(owner[low]), packed(steps), packed(counts[low:high])))
                    levels, owners, own_keys, own_counts = zip(*rows, strict=True)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(levels, pa.int32()),
                            pa.array(owners, pa.int32()),
                            pa.array([block.row["block"]] * n, pa.int64()),
                            pa.array([block.row["deleted"]] * n),
                            pa.array(own_keys, pa.binary()),
                            pa.array(own_counts, pa.binary()),
                        ],
                        names=["level", "part", "block", "deleted", "keys", "counts"],
                    )
                del block
        release()

    needed = "block", "deleted", "trained", "sizes", "vocabulary", "tokens", "train_docs"
    return blocks.select(*needed).mapInArrow(ask, _REQUEST)


def _answers(requests: DataFrame, parts: int) -> DataFrame:
    """Counts over all blocks, in the order of each request.

    ``trained`` counts all training texts and ``kept`` those that are not deleted; only deleted blocks get the
    latter. One row per part, of block -1, holds the number of different words that were counted.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "level", "part"):
            rows = [row for batch in group for row in batch.to_pylist()]
            keys = [np.cumsum(unpacked(row["keys"], "u8"), dtype=np.uint64) for row in rows]
            counts = [unpacked(row["counts"], "i8") for row in rows]
            bounds = np.cumsum([0, *map(len, keys)])
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            at = at.reshape(-1)
            del keys
            trained, kept = (np.zeros(len(distinct), np.int64) for _ in range(2))
            for row, own, low, high in zip(rows, counts, bounds[:-1], bounds[1:], strict=True):
                trained[at[low:high]] += own  # the keys of a request are different
                if not row["deleted"]:
                    kept[at[low:high]] += own
            level, part = rows[0]["level"], rows[0]["part"]
            for row, low, high in zip(rows, bounds[:-1], bounds[1:], strict=True):
                yield answer(level, part, row["block"], row["deleted"], kept[at[low:high]], trained[at[low:high]], 0)
            if level == 1:
                for deleted, known in ((False, trained), (True, kept)):
                    yield answer(level, part, -1, deleted, kept[:0], kept[:0], int((known > 0).sum()))
        release()

    def answer(level, part, block, deleted, kept, trained, n_known) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([level], pa.int32()),
                pa.array([part], pa.int32()),
                pa.array([block], pa.int64()),
                pa.array([deleted]),
                pa.array([packed(kept) if deleted else None], pa.binary()),
                pa.array([packed(trained)], pa.binary()),
                pa.array([n_known], pa.int64()),
            ],
            names=["level", "part", "block", "deleted", "kept", "trained", "n_known"],
        )

    dealt = requests.repartition(1 + 2 * parts // PER_TASK, "level", "part").sortWithinPartitions("level", "part", "block")
    return dealt.mapInArrow(total, _ANSWER)


_Answered = Callable[["_Block", dict[str, dict[int, np.ndarray]]], pa.RecordBatch]


def _with_answers(blocks: DataFrame, answers: DataFrame, n: int, work: _Answered, schema: str) -> DataFrame:
    """``work`` on each of ``n`` blocks and its counts of words (1) and pairs (2) in the block's own numbers."""
    parts = answers.filter("block >= 0").select("block", "level", "part", "kept", "trained")
    whole = blocks.select(
        "block",
        F.lit(0).alias("level"),
        F.lit(0).alias("part"),
        F.lit(None).cast("binary").alias("kept"),
        F.col("trained"),
        F.struct(*[c for c in blocks.columns if c not in ("n_tokens", "train_tokens")]).alias("row"),
    )
    both = whole.unionByName(parts, allowMissingColumns=True)
    # The block itself is level 0 and comes first.
    dealt = both.repartition(1 + n // PER_TASK, "block").sortWithinPartitions("block", "level", "part")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "block"):
            rows = (row for batch in group for row in batch.to_pylist())
            block = _Block(next(rows)["row"])
            found: dict[tuple[str, int], list[np.ndarray]] = {}
            for row in rows:
                for name in ("kept", "trained"):
                    if row[name] is not None:
                        found.setdefault((name, row["level"]), []).append(unpacked(row[name], "i8"))
            counts: dict[str, dict[int, np.ndarray]] = {"kept": {}, "trained": {}}
            for (name, level), own in found.items():
                _, order = block.keys(level)
                counts[name][level] = np.empty(len(order), np.int64)
                counts[name][level][order] = np.concatenate(own)
            yield work(block, counts)
        release()

    return dealt.mapInArrow(meet, schema)


@dataclass
class Totals:
    """What all estimates of one set of texts share."""

    docs: int
    tokens: int
    words: int


@dataclass
class Mixture:
    """Weights of bigram, unigram and uniform estimates per bucket of the context's frequency."""

    weights: np.ndarray

    @staticmethod
    def start() -> Mixture:
        weights = np.full((BUCKETS, 3), 1 / 3)
        weights[0] = 0, 0.5, 0.5  # a context that was never seen has no bigrams
        return Mixture(weights)

    def probabilities(self, pair, context, word, totals: Totals) -> np.ndarray:
        if not totals.tokens:
            return np.ones(len(pair))
        a, u, z = self.weights[buckets(context)].T
        seen = np.maximum(context, 1)
        return a * pair / seen + u * word / totals.tokens + z / (totals.words + 1)


def buckets(frequency: np.ndarray) -> np.ndarray:
    """0 for 0, else one more than the whole binary logarithm."""
    return np.frexp(frequency.astype(np.float64))[1]


def _context_counts(block: _Block, words: np.ndarray, totals: Totals) -> np.ndarray:
    """How often the context of each pair occurs: the word's count, or the texts for their beginning."""
    return np.append(words, totals.docs)[block.contexts]


def _events(blocks: DataFrame, answers: DataFrame, n: int, kept: Totals) -> DataFrame:
    """How often the deleted texts have bigrams with the same kept counts of pair, context and word."""

    def count(block: _Block, counts: dict) -> pa.RecordBatch:
        words = counts["kept"][1]
        triples = np.stack(
            [counts["kept"][2], _context_counts(block, words, kept), words[block.words]], axis=1
        )
        distinct, at = np.unique(triples, axis=0, return_inverse=True)
        times = np.bincount(at.reshape(-1), weights=np.bincount(block.at, minlength=len(triples)))
        columns = [*distinct.T, times.astype(np.int64)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(c)) for c in columns], names=["pair", "context", "word", "times"]
        )

    found = _with_answers(
        blocks.filter("deleted"), answers.filter("deleted"), n, count, "pair long, context long, word long, times long"
    )
    return found.groupBy("pair", "context", "word").agg(F.sum("times").alias("times"))


def fit_mixture(events: DataFrame, kept: Totals) -> Mixture:
    """Expectation-maximisation over held-out events; one aggregate per round.

    Every share counts one event more than it has, so no weight is zero. A bucket without events takes
    the weights of the next lower one that has some, else of the next higher one.
    """
    mixture = Mixture.start()
    if not kept.tokens:
        return mixture
    bucket = F.when(F.col("context") == 0, 0).otherwise(F.length(F.bin("context")))
    own = events.select(
        bucket.alias("bucket"),
        (F.col("pair") / F.greatest("context", F.lit(1))).alias("f0"),
        (F.col("word") / F.lit(float(kept.tokens))).alias("f1"),
        F.lit(1.0 / (kept.words + 1)).alias("f2"),
        "times",
    )
    own = materialize(own.groupBy("bucket", "f0", "f1", "f2").agg(F.sum("times").alias("times")), "events")
    last = -math.inf
    for _ in range(ROUNDS):
        given = [F.get(F.array(*[F.lit(float(x)) for x in column]), F.col("bucket")) for column in mixture.weights.T]
        shares = [weight * F.col(f"f{k}") for k, weight in enumerate(given)]
        total = shares[0] + shares[1] + shares[2]
        parts = own.select("bucket", "times", *[s.alias(f"s{k}") for k, s in enumerate(shares)], total.alias("p"))
        expected = [F.sum(F.col("times") * F.col(f"s{k}") / F.col("p")).alias(f"e{k}") for k in range(3)]
        rows = parts.groupBy("bucket").agg(
            *expected, F.sum("times").alias("times"), F.sum(F.col("times") * F.log("p")).alias("likelihood")
        ).collect()
        if not rows:
            break
        weights, has = mixture.weights.copy(), {r["bucket"] for r in rows}
        for r in rows:
            raw = np.array([r["e0"] + 1, r["e1"] + 1, r["e2"] + 1])
            if r["bucket"] == 0:
                raw[0] = 0
            weights[r["bucket"]] = raw / raw.sum()
        for b in range(1, BUCKETS):
            near = max((h for h in has if 0 < h <= b), default=min((h for h in has if h > 0), default=None))
            if near is not None:
                weights[b] = weights[near]
        mixture = Mixture(weights)
        now = sum(r["likelihood"] for r in rows) / sum(r["times"] for r in rows)
        if now - last < ENOUGH:
            break
        last = now
    return mixture


_SCORED = (
    "doc_id long, tag long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score(
    docs: DataFrame, trained: Column, block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS
) -> DataFrame:
    """The log10 probability of every text, learned from the rows for which ``trained`` is true.

    ``base_score`` is that of unigrams with one added to every count. ``n_known`` counts the tokens that some
    training text has, ``train_tokens`` all tokens of training texts.
    """
    prepare(docs.sparkSession)
    blocks = _blocks(docs, trained, block_tokens)
    sizes = blocks.groupBy("deleted").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("n_tokens", "train_docs", "train_tokens")]
    )
    size = {r["deleted"]: r for r in sizes.collect()}
    n_tokens = sum(r["n_tokens"] for r in size.values())
    parts = 1 + n_tokens // part_tokens
    answers = materialize(_answers(_requests(blocks, parts), parts), "answers")
    known = answers.filter("block < 0").groupBy("deleted").agg(F.sum("n_known").alias("n"))
    words = {r["deleted"]: r["n"] for r in known.collect()}
    everything = Totals(
        sum(r["train_docs"] for r in size.values()), sum(r["train_tokens"] for r in size.values()), words.get(False, 0)
    )
    kept = Totals(0, 0, 0)
    if False in size:
        kept = Totals(size[False]["train_docs"], size[False]["train_tokens"], words[True])
    mixture = Mixture.start()
    if True in size:
        mixture = fit_mixture(_events(blocks, answers, size[True]["n"], kept), kept)

    def judge(block: _Block, counts: dict) -> pa.RecordBatch:
        seen, pairs = counts["trained"][1], counts["trained"][2]
        context = _context_counts(block, seen, everything)
        mixed = np.log10(mixture.probabilities(pairs, context, seen[block.words], everything))
        base = np.log10((seen + 1) / (everything.tokens + everything.words + 1))
        per_doc = lambda values: np.add.reduceat(values, block.first)
        n = len(block.sizes)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(block.row["docs"], pa.int64()),
                pa.array(block.row["tags"], pa.int64()),
                pa.array(block.sizes),
                pa.array(per_doc((seen > 0).astype(np.int64)[block.tokens])),
                pa.array([everything.tokens] * n, pa.int64()),
                pa.array(per_doc(base[block.tokens])),
                pa.array(per_doc(mixed[block.at])),
            ],
            names=["doc_id", "tag", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return _with_answers(blocks, answers, sum(r["n"] for r in size.values()), judge, _SCORED)
