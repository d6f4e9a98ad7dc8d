import hashlib
import random
import zlib

import numpy as np
import pytest

from broadloom.llm import periodic_runs
from broadloom.llm.queries import QUERIES
from tests.llm.conftest import ODD


def brute_runs(words, least=6, repeats=4):
    """All runs by trying every lag at every word."""
    found = {}
    n = len(words)
    for q in range(1, n // repeats + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(least, repeats * q):
                found.setdefault((start, end), q)  # the smallest period comes first
            start = end - q + 1
    return sorted((start, end - start, q) for (start, end), q in found.items())


def brute_words(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def random_words(rng, letters, n):
    words = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        at, q, k = rng.randrange(n), rng.randrange(1, 7), rng.randrange(2, 9)
        words[at:at] = words[at : at + q] * k
    return words


def test_runs_against_brute_force():
    rng = random.Random(7)
    for _ in range(600):
        words = random_words(rng, "abcdefghijklmnop"[: rng.randrange(1, 17)], rng.randrange(1, 90))
        assert periodic_runs.runs_of(words) == brute_runs(words), words
    for _ in range(200):
        words = random_words(rng, "abc", rng.randrange(1, 60))
        assert periodic_runs.runs_of(words, 5, 3) == brute_runs(words, 5, 3), words


def test_segments_hold_only_frequent_words():
    rng = np.random.default_rng(3)
    for _ in range(100):
        ids = np.unique(rng.integers(0, 12, 80), return_inverse=True)[1].astype(np.int32)
        inside = np.zeros(len(ids), bool)
        for low, high in periodic_runs.segments(ids):
            assert high - low >= 6 and np.unique(ids[low:high], return_counts=True)[1].min() >= 4
            inside[low:high] = True
        for start, length, _ in brute_runs(ids.tolist()):
            assert inside[start : start + length].all()


@pytest.mark.parametrize("period", [1, 2, 999, 40_000])
def test_long_texts(period):
    words = [f"w{i % period}" for i in range(200_000)]
    assert periodic_runs.runs_of(["x", *words, "y"]) == [(1, 200_000, period)]
    assert periodic_runs.collapse(words, [(0, 200_000, period)]) == words[:period]


def test_deep_recursion_is_not_quadratic():
    """Each turn uncovers one more rare word at the end."""
    ids = []
    for i in range(30_000):
        ids += [i, i + 1]
    ids = np.array(ids * 2, np.int32)
    assert periodic_runs.segments(ids) is not None


def test_odd_rows(odd, empty):
    rows = periodic_runs.find_runs(odd).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in rows) == sorted(
        (str(doc_id), len((text or "").encode().split())) for doc_id, text, *_ in ODD
    )
    assert all(r.runs == [] for r in rows)
    assert periodic_runs.find_runs(empty).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(odd, repeats=2)


def test_odd_texts(docs_of):
    text = "　 a\x0bb a b\ta b a b x y " + "zz " * 7
    (row,) = periodic_runs.find_runs(docs_of([(1, text, "en", "a", 1)])).collect()
    assert [tuple(r) for r in row.runs] == [(1, 8, 2), (10, 7, 1)]
    assert row.collapsed == "　 a b x y zz"


def test_query_against_brute_force(spark, sf_dir, texts):
    rows = QUERIES["op13_periodic_runs"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    some = 0
    for r in rows:
        words = brute_words(r.doc_id, texts[r.doc_id])
        if len(words) > 3000:
            continue
        runs = brute_runs(words)
        some += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        listed = "".join(f"{a},{b},{q}\n" for a, b, q in sorted(runs, key=lambda x: (x[0], x[2])))
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        kept = " ".join(w for i, w in enumerate(words) if not any(a + q <= i < a + b for a, b, q in runs))
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert some > 5
