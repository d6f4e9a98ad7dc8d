"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts become TF-IDF weights of hashed character n-grams (letters lower-cased, all other characters
as one blank). Document frequencies come from all texts that may be learned from. The regression is
trained with follow-the-regularised-leader and elastic-net penalties on a bounded, hash-chosen
number of texts per language, a part of which only fits the temperature of the softmax.

Training runs in one task, as its sample is bounded; scoring is row-local over whole texts.

Defined results: a text that is null or has no letter gets ``und`` with score 0, as does every
text if nothing can be learned. Null ids count as held out. Repeated rows each get a row; ties
go to the first language in order. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.llm.byte_bpe import LETTER, _kinds
from broadloom.llm.rows import prepare, text_tag, without
from broadloom.llm.textarrays import strings
from broadloom.session import materialize

UNKNOWN = "und"
BITS = 15
LONGEST = 3
#: Bound of the training sample: texts per language; and the most languages a model may have.
PER_LANGUAGE = 600
MAX_LANGUAGES = 256
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
SCALE = 20.0
#: Texts with a lower score are rejected by the filter.
LEAST_SCORE = 0.5
CHUNK_CHARS = 1 << 19

_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each between two blanks; their offsets; which have letters."""
    lowered = [f" {t.lower()} " if t else "  " for t in texts]
    ends = np.cumsum([0, *map(len, lowered)])
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    letter = _kinds()[points] == LETTER
    count = np.concatenate([[0], np.cumsum(letter)])
    return np.where(letter, points, 32).astype(np.uint64), ends, count[ends[1:]] > count[ends[:-1]]


def _grams(symbols: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each symbol."""
    size = max(len(symbols) - n + 1, 0)
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h += symbols[k : k + size] * np.uint64(_FACTORS[k])
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def _split(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of bounded total length."""
    texts: list[str | None] = []
    first, chars = 0, 0
    for i, text in enumerate(strings(column)):
        texts.append(text)
        chars += len(text or "")
        if chars >= CHUNK_CHARS:
            yield first, texts
            first, texts, chars = i + 1, [], 0
    if texts:
        yield first, texts


def _counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Per text its buckets, their counts and the number of its n-grams."""
    symbols, ends, _ = _symbols(texts)
    grams = [_grams(symbols, n) for n in range(1, LONGEST + 1)]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own = np.concatenate([g[a : max(a, b - n)] for n, g in enumerate(grams)])
        counts = np.bincount(own, minlength=1 << BITS)
        buckets = np.flatnonzero(counts)
        yield buckets, counts[buckets], len(own)


def _document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts each bucket occurs, and last the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for _, part in _split(batch.column(0)):
                for buckets, _, _ in _counts(part):
                    total[buckets] += 1
                total[-1] += len(part)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros((1 << BITS) + 1, np.int64)
    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = rows.toPandas()  # at most one row per bucket
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


class Model:
    """Languages, weights with the IDF folded in (languages x buckets), offsets, temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, offsets: np.ndarray, temperature: float):
        self.languages, self.weights = languages, weights
        self.offsets, self.temperature = offsets, temperature

    def logits(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.tile(self.offsets, (len(ends) - 1, 1))
        total = np.zeros(len(ends) - 1)
        sums = np.zeros((len(self.languages), len(ends) - 1))
        for n in range(1, LONGEST + 1):
            grams = _grams(symbols, n)
            last = np.minimum(np.maximum(ends[:-1], ends[1:] - n + 1), len(grams))
            first = np.minimum(ends[:-1], len(grams))
            total += last - first
            for k, weights in enumerate(self.weights):
                running = np.concatenate([[0.0], np.cumsum(weights[grams], dtype=np.float64)])
                sums[k] += running[last] - running[first]
        return out + (sums / np.maximum(total, 1)).T * SCALE

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        symbols, ends, has_letter = _symbols(texts)
        p = _softmax(self.logits(symbols, ends) / self.temperature)
        best = p.argmax(1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has_letter, strict=True)]
        return names, np.where(has_letter, p[np.arange(len(p)), best], 0.0)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int):
    """Weights (buckets x classes) and offsets after ``EPOCHS`` passes over sparse rows."""
    size = 1 << BITS
    z, n = np.zeros((size + 1, n_classes)), np.zeros((size + 1, n_classes))

    def weights(zi: np.ndarray, ni: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0)
        return -shrunk / ((BETA + np.sqrt(ni)) / ALPHA + l2)

    for epoch in range(EPOCHS):
        for row in np.random.Generator(np.random.PCG64(epoch)).permutation(len(rows)).tolist():
            buckets, values = rows[row]
            at = np.append(buckets, size)  # the offset is an unpenalised last coordinate
            x = np.append(values, 1.0)[:, None]
            l1 = np.where(at < size, L1, 0.0)[:, None]
            l2 = np.where(at < size, L2, 0.0)[:, None]
            zi, ni = z[at], n[at]
            w = weights(zi, ni, l1, l2)
            error = _softmax((x * w).sum(0, keepdims=True))
            error[0, labels[row]] -= 1
            g = x * error
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(z, n, np.append(np.full(size, L1), 0.0)[:, None], np.append(np.full(size, L2), 0.0)[:, None])
    return w[:size], w[size]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(p)), labels], 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from text and lang of the rows that are not held out; None if there are none."""
    prepare(docs.sparkSession)
    learnable = docs.filter(F.col("lang").isNotNull() & ~held_out(docs["doc_id"])).select(
        docs["text"].cast("string").alias("text"),
        docs["lang"].cast("string").alias("lang"),
        F.xxhash64(docs["doc_id"].cast("long")).alias("pick"),
    )
    per = learnable.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if not per:
        return None
    if len(per) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["lang"] for r in per]
    frequencies = _document_frequencies(learnable.select("text"))
    idf = np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])) + 1

    share = F.lit(0.0)
    for r in per:
        share = F.when(F.col("lang") == r["lang"], F.lit(per_language / r["count"])).otherwise(share)
    chosen = F.pmod(F.col("pick"), F.lit(1_000_003)) / 1_000_003.0 < share
    sample = learnable.filter(chosen).select(
        "text", "lang", (F.pmod(F.xxhash64("pick"), F.lit(5)) == 0).alias("calibrate")
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, calibrate = [], [], []
        for batch in batches:
            for first, texts in _split(batch.column(0)):
                for buckets, counts, total in _counts(texts):
                    rows.append((buckets, counts * idf[buckets] / max(total, 1) * SCALE))
                labels += batch.column(1).slice(first, len(texts)).to_pylist()
                calibrate += batch.column(2).slice(first, len(texts)).to_pylist()
        y = np.array([languages.index(x) for x in labels], np.int64)
        later = np.array(calibrate, bool)
        fitted = np.flatnonzero(~later) if not later.all() else np.arange(len(y))
        w, offsets = _ftrl([rows[i] for i in fitted], y[fitted], len(languages))
        rest = np.flatnonzero(later)
        logits = np.array([(rows[i][1][:, None] * w[rows[i][0]]).sum(0) + offsets for i in rest])
        temperature = _temperature(logits.reshape(-1, len(languages)), y[rest])
        folded = (w * idf[:, None]).T.astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([folded.tobytes()]), pa.array([offsets.tobytes()]), pa.array([temperature])],
            names=["weights", "offsets", "temperature"],
        )

    # In order, so that the result does not depend on the partitions of the input.
    ordered = sample.orderBy(F.xxhash64("text"), "lang").coalesce(1)
    row = ordered.mapInArrow(fit, "weights binary, offsets binary, temperature double").first()
    weights = np.frombuffer(row["weights"], np.float32).reshape(len(languages), -1)
    return Model(languages, weights, np.frombuffer(row["offsets"], np.float64), row["temperature"])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _split(batch.column(0)):
                if shared.value is None:
                    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    names, scores = shared.value.predict(texts)
                kept = [c.slice(first, len(texts)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(names, pa.string()), pa.array(scores)],
                    names=["doc_id", "held_out", "tag", "lang_pred", "score"],
                )

    own = docs.select(
        docs["text"].cast("string").alias("text"),
        docs["doc_id"].cast("long").alias("doc_id"),
        held_out(docs["doc_id"]).alias("held_out"),
        text_tag(docs).alias("tag"),
    )
    return own.mapInArrow(score, "doc_id long, held_out boolean, tag long, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    return predict(docs, train(docs, per_language))


def drop_unidentified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents in a language the model knows with a score of at least ``least``."""
    found = materialize(identify(docs), "languages")
    return without(docs, found.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)))
