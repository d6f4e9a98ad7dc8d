"""Toxicity scores: gradient-boosted trees over dense features with isotonic calibration.

1. A lexicon is learned from a bounded, hash-chosen sample of labelled texts: whole words and
   word beginnings whose presence speaks for the toxic label. Equal texts count once per label;
   all forms with enough evidence are kept, which the bounded sample bounds.
2. Each text becomes a few dense features: densities and weights of lexicon words, lexicon words
   close to second-person words, the same after undoing letter substitutions, capitals,
   punctuation, digits, repeated letters.
3. Spark's gradient-boosted trees are fitted on a part of the sample, isotonic regression of their
   margin on the rest gives the score. Scoring is row-local over whole texts.

Defined results: a null or empty text has all features zero and is scored like any other. Without
labels of both kinds every score is the share of toxic labels (0 if there are none). Several
labels of one id count as toxic if one of them is; ids without a label teach nothing; null ids
count as held out. Repeated rows each get a row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.llm.language_id import held_out
from broadloom.llm.rows import prepare, text_tag, without
from broadloom.llm.textarrays import byte_table, chunks, range_hashes
from broadloom.session import materialize

#: Bound of the training sample: labelled texts.
SAMPLE = 20_000
#: Lexicon: least different toxic texts with an entry, least share of toxic texts among its texts.
LEAST_TEXTS, LEAST_SHARE = 5, 0.7
PREFIXES = (4, 5, 6)
NEAR = 5
TREES, TREE_DEPTH = 20, 3

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself ya u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi "
    "ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro"
).split()

# Usual substitutions of letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}

FEATURES = (
    "lexicon_density", "lexicon_count", "weight_density", "highest_weight", "weight_sum", "hidden_density",
    "near_second_person", "second_person_density", "capital_rate", "capital_words", "exclamation_rate",
    "punctuation_rate", "digit_rate", "substituted_words", "repeated_letters", "log_words",
)

_PLAIN = byte_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_WORD = _PLAIN | byte_table((0x30, 0x39)) | np.isin(np.arange(256), [ord(c) for c in "@$!|*"])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_UNDONE = _LOWER.copy()
for _from, _to in SUBSTITUTES.items():
    _UNDONE[ord(_from)] = ord(_to)
_PUNCTUATION = byte_table((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


class _Words:
    """Words of some texts, with any trailing marks cut off, and the bytes they lie in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = _WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]])[: len(data)]
        after = np.concatenate([inside[1:], [False]])[: len(data)]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        for _ in range(8):  # "stupid!!!" is the word and its marks
            trim = (ends > starts + 1) & (data[ends - 1] == 0x21)
            if not trim.any():
                break
            ends = ends - trim
        plain = np.concatenate([[0], np.cumsum(_PLAIN[data])])
        letters = plain[ends] - plain[starts]
        keep = letters > 0
        self.data, self.starts, self.ends = data, starts[keep], ends[keep]
        self.substituted = letters[keep] < (self.ends - self.starts)
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.lower = _LOWER[data]

    def hashes(self, undo: bool = False) -> list[np.ndarray]:
        """Of whole words and of their beginnings; a word as short as a beginning repeats its own."""
        symbols = _UNDONE[self.data] if undo else self.lower
        whole = range_hashes(symbols, self.starts, self.ends)
        parts = [
            range_hashes(symbols, self.starts, np.minimum(self.starts + n, self.ends)) ^ np.uint64(n)
            for n in PREFIXES
        ]
        long = [self.ends - self.starts > n for n in PREFIXES]
        return [whole, *(np.where(k, p, whole) for k, p in zip(long, parts, strict=True))]


_SECOND = range_hashes(
    _LOWER[np.frombuffer("".join(SECOND_PERSON).encode(), np.uint8)],
    np.cumsum([0, *(len(w.encode()) for w in SECOND_PERSON)])[:-1],
    np.cumsum([len(w.encode()) for w in SECOND_PERSON]),
)


class Lexicon:
    """Hashes of words and beginnings with their weights."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], weights[order]

    def weights(self, forms: list[np.ndarray]) -> np.ndarray:
        """The highest weight of the forms of each word, 0 if none is listed."""
        out = np.zeros(len(forms[0]))
        if len(self.hashes):
            for form in forms:
                at = np.minimum(np.searchsorted(self.hashes, form), len(self.hashes) - 1)
                out = np.maximum(out, np.where(self.hashes[at] == form, self.values[at], 0.0))
        return out


def _features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    n = len(offsets) - 1
    found = _Words(data, offsets)
    text = found.text
    forms = found.hashes()
    weight = lexicon.weights(forms)
    undone = np.where(found.substituted, lexicon.weights(found.hashes(undo=True)), 0.0)
    hidden = (undone > 0) & (weight == 0)
    weight = np.maximum(weight, undone)
    hit = weight > 0
    second = np.isin(forms[0], _SECOND)
    spoken = np.zeros(len(text) + 1, np.int64)
    np.cumsum(second, out=spoken[1:])
    first = np.searchsorted(text, text)
    last = np.searchsorted(text, text, "right")
    place = np.arange(len(text))
    near = spoken[np.minimum(place + NEAR + 1, last)] > spoken[np.maximum(place - NEAR, first)]
    upper = np.concatenate([[0], np.cumsum(byte_table((0x41, 0x5A))[data])])
    capital = (upper[found.ends] - upper[found.starts] == found.ends - found.starts) & (found.ends - found.starts > 1)
    again = np.zeros(len(data), bool)
    again[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _PLAIN[data[2:]]

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(text, values, n)[:n] if len(text) else np.zeros(n)

    def per_byte(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    words = np.maximum(per_text(np.ones(len(text))), 1)
    size = np.maximum(np.diff(offsets), 1)
    highest = np.zeros(n)
    np.maximum.at(highest, text[hit], weight[hit])
    columns = [
        per_text(hit) / words, np.log1p(per_text(hit)), per_text(weight) / words, highest, per_text(weight),
        per_text(hidden) / words, per_text(hit & near) / words, per_text(second) / words,
        per_byte(byte_table((0x41, 0x5A))[data]) / size, per_text(capital) / words,
        per_byte(data == 0x21) / size, per_byte(_PUNCTUATION[data]) / size,
        per_byte(byte_table((0x30, 0x39))[data]) / size, per_text(found.substituted) / words,
        per_byte(again) / size, np.log1p(per_text(np.ones(len(text)))),
    ]
    return np.stack(columns, 1)


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Texts and labels of at most about ``sample`` learnable ids, chosen by a hash of the id."""
    of = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(labels["doc_id"]))
    of = of.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("label")
    )
    share = min(1.0, sample / max(of.count(), 1))
    of = of.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) / 1_000_003.0 < share)
    # At most about ``sample`` rows of two numbers.
    own = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].cast("string").alias("text"))
    return own.join(F.broadcast(of), "_id").select(
        "text",
        "label",
        (F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(4)) == 0).alias("calibrate"),
    )


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """Words and beginnings that occur in toxic texts above all, by smoothed log odds.

    Copies of a text are one text of each label that they have.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for row, _, data, offsets in chunks(batch.column(0)):
                found = _Words(data, offsets)
                forms = np.concatenate(found.hashes())
                owner = np.tile(found.text, 1 + len(PREFIXES))
                order = np.lexsort((owner, forms))
                forms, owner = forms[order], owner[order]
                new = np.ones(len(forms), bool)
                new[1:] = (forms[1:] != forms[:-1]) | (owner[1:] != owner[:-1])
                forms, toxic = forms[new], label[row + owner[new]]
                terms, at = np.unique(forms, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(terms.view(np.int64)),
                        pa.array(np.bincount(at, toxic, len(terms)).astype(np.int64)),
                        pa.array(np.bincount(at, minlength=len(terms)).astype(np.int64)),
                    ],
                    names=["term", "toxic", "texts"],
                )

    different = labelled.groupBy(F.xxhash64("text"), "label").agg(F.first("text").alias("text"))
    terms = different.select("text", "label").mapInArrow(count, "term long, toxic long, texts long")
    per_term = terms.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts"))
    share = F.col("toxic") / F.col("texts")
    chosen = per_term.filter((F.col("toxic") >= LEAST_TEXTS) & (share >= LEAST_SHARE))
    best = chosen.collect()
    hashes = np.array([r["term"] for r in best], np.int64).view(np.uint64)
    odds = np.array([(r["toxic"] + 0.5) / (r["texts"] - r["toxic"] + 0.5) for r in best], float)
    return Lexicon(hashes, np.log(odds))


def features(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``rows`` with their text replaced by the array column ``features``."""
    prepare(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    others = [c for c in rows.columns if c != "text"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for row, n, data, offsets in chunks(text):
                values = _features(data, offsets, shared.value)
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel())
                )
                kept = [batch.column(batch.schema.get_field_index(c)).slice(row, n) for c in others]
                yield pa.RecordBatch.from_arrays([*kept, flat], names=[*others, "features"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*others).schema)
    return rows.mapInArrow(build, f"{schema}, features array<double>")


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    prepare(docs.sparkSession)
    labelled = materialize(_labelled(docs, labels, sample), "labelled")
    seen = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    own = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        held_out(docs["doc_id"]).alias("held_out"),
        text_tag(docs).alias("tag"),
        docs["text"].cast("string").alias("text"),
    )
    if len(seen) < 2:
        share = float(seen.get(1, 0) > 0)
        scored = own.drop("text").withColumn("score", F.lit(share))
    else:
        lexicon = learn_lexicon(labelled)
        learn = materialize(features(labelled, lexicon).repartition(4), "features")
        learn = learn.withColumn("features", array_to_vector("features")).withColumn(
            "label", F.col("label").cast("double")
        )
        trees = GBTClassifier(
            maxIter=TREES, maxDepth=TREE_DEPTH, seed=7, cacheNodeIds=False, featureSubsetStrategy="all"
        ).fit(learn.filter("not calibrate"))

        def margin(rows: DataFrame) -> DataFrame:
            done = trees.transform(rows).withColumn("margin", vector_to_array("rawPrediction")[1])
            return done.drop("features", "rawPrediction", "probability", "prediction")

        held = learn.filter("calibrate")
        fitted = IsotonicRegression(featuresCol="margin", predictionCol="score").fit(
            margin(held if held.select("label").distinct().count() > 1 else learn)
        )
        wanted = features(own, lexicon).withColumn("features", array_to_vector("features"))
        scored = fitted.transform(margin(wanted))
        scored = scored.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "tag"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``, with all their columns."""


    return without(docs, materialize(score(docs, labels), "scores").filter(F.col("score") >= limit))
