"""Periodic runs of words: passages that repeat themselves, and texts with the repetition collapsed.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``repeats * q`` and
``least`` words that no neighbouring word extends. All work is local to a text:

1. Recursive frequency splitting: every word of a run occurs at least ``repeats`` times in it, so a
   word with fewer occurrences inside its segment belongs to none and splits the segment. Pieces are
   split again until nothing changes. Occurrences of the largest piece are kept by subtraction, so a
   text of n words takes O(n log n) however deep the recursion goes.
2. Lag scan of the surviving segments: a run of period ``q`` holds ``repeats`` multiples of ``q`` in a
   row, so only these are compared for each lag (a harmonic sum of places), then whole windows by
   range hashes. What is left is extended word by word to both sides, which also proves it.

Lags go upwards, and a window inside a known run is a multiple of that run's period. No text is
cut and no period is left out; working memory is a small multiple of the longest text.

Defined results: words are runs of characters other than ASCII white space, compared as they stand. A null,
empty or short text has no run and collapses to its words. Runs may overlap when their periods
differ; they are listed by start, then period. Repeated rows get a row each, null ids as well. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.llm.byte_bpe import ragged
from broadloom.llm.rows import prepare
from broadloom.llm.textarrays import powers, strings

LEAST = 6
REPEATS = 4
#: Places that are compared at a time.
PLACES = 1 << 19

_BASE = 0xA24BAED4963EE407  # odd
_RUN = "struct<start:bigint,length:bigint,period:bigint>"
_OUT = f"doc_id long, n_words long, runs array<{_RUN}>, collapsed string"


def segments(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int]]:
    """Segments in which every word (a number from 0) occurs at least ``repeats`` times."""
    n, out = len(ids), []
    if n < least:
        return out
    order = np.argsort(ids, kind="stable")
    places = ids[order].astype(np.int64) * n + order  # by word, then position
    count = np.zeros(int(ids.max()) + 1, np.int64)
    work = [(0, n)]
    while work:
        low, high = work.pop()
        doubtful, counts = np.unique(ids[low:high], return_counts=True)
        count[doubtful] = counts
        while high - low >= least:
            rare = doubtful[(count[doubtful] > 0) & (count[doubtful] < repeats)]
            if not len(rare):
                out.append((low, high))
                break
            at = order[ragged(np.searchsorted(places, rare.astype(np.int64) * n + low), count[rare])]
            edges = np.concatenate([[low - 1], np.sort(at), [high]])
            gaps = np.diff(edges) - 1
            largest = int(gaps.argmax())
            for k in np.flatnonzero(gaps >= least).tolist():
                if k != largest:
                    work.append((int(edges[k]) + 1, int(edges[k + 1])))
            was, (low, high) = (low, high), (int(edges[largest]) + 1, int(edges[largest + 1]))
            gone = np.concatenate([ids[was[0] : low], ids[high : was[1]]])
            doubtful, counts = np.unique(gone, return_counts=True)
            count[doubtful] -= counts
        count[ids[low:high]] = 0
    return sorted(out)


def _matches(one: np.ndarray, two: np.ndarray) -> int:
    """Length of the common beginning."""
    n, done, step = min(len(one), len(two)), 0, 64
    while done < n:
        unequal = one[done : min(done + step, n)] != two[done : min(done + step, n)]
        if unequal.any():
            return done + int(unequal.argmax())
        done, step = min(done + step, n), step * 4
    return n


def scan(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs, by trying every lag; ``repeats`` is 3 or more."""
    n = len(ids)
    top = n // repeats
    reach = np.zeros(n, np.int64)  # end of the known run that covers a place and goes furthest
    steps = powers(_BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * steps[:n], out=sums[1:])
    found, first = [], 1
    while first <= top:
        lags = np.arange(first, min(top, first + max(0, PLACES * first // n)) + 1)
        first = int(lags[-1]) + 1
        per = (n - 1) // lags - (repeats - 2)
        q = np.repeat(lags, per)
        s = (np.arange(len(q)) - np.repeat(np.cumsum(per) - per, per)) * q
        for j in range(1, repeats):
            same = ids[s] == ids[s + j * q]
            s, q = s[same], q[same]
        size = (repeats - 2) * q + 1
        same = (sums[s + size] - sums[s]) * steps[q] == sums[s + q + size] - sums[s + q]
        s, q = s[same], q[same]
        unknown = reach[s] < s + (repeats - 1) * q + 1
        s, q = s[unknown], q[unknown]
        bounds = np.flatnonzero(np.diff(q, prepend=0))
        for lag, at in zip(q[bounds].tolist(), np.split(s, bounds)[1:], strict=True):
            ends = at + (repeats - 1) * lag + 1
            left = at[reach[at] < ends]
            while len(left):
                here = int(left[0])
                end = here + lag + _matches(ids[here + lag :], ids[here:])
                start = here - _matches(ids[:here][::-1], ids[: here + lag][::-1])
                if end - start >= max(least, repeats * lag):
                    found.append((start, end - start, lag))
                    reach[start:end] = np.maximum(reach[start:end], end)
                left = left[left + (repeats - 1) * lag + 1 > max(end, here + (repeats - 1) * lag + 1)]
    return found


def runs_of(words: list, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    if len(words) < least:
        return []
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int32)
    if np.bincount(ids).max() < repeats:
        return []
    found = []
    for low, high in segments(ids, least, repeats):
        found += [(low + start, length, q) for start, length, q in scan(ids[low:high], least, repeats)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """doc_id, n_words, runs and the collapsed text of every document."""
    if repeats < 3:
        raise ValueError("a run needs three repeats or more")
    prepare(docs.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Rows leave in small groups: collapsed texts are as large as the texts.
            for first in range(0, len(batch), 128):
                part = batch.slice(first, 128)
                sizes, runs, collapsed = [], [], []
                for text in strings(part.column(1)):
                    words = (text or b"").split()
                    own = runs_of(words, least, repeats)
                    sizes.append(len(words))
                    runs.append([{"start": a, "length": b, "period": q} for a, b, q in own])
                    collapsed.append(b" ".join(collapse(words, own)).decode("utf-8", "replace"))
                kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(collapsed)],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    own = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.encode(docs["text"].cast("string"), "UTF-8").alias("text")
    )
    return own.mapInArrow(search, _OUT)
