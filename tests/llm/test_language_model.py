import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadloom.llm import language_model as lm
from broadloom.llm.queries import QUERIES
from tests.llm.conftest import ODD, spaced

END = object()


def tokens(text):
    return [*spaced(text), END]


def bucket(n):
    return n.bit_length()


def counts_of(texts):
    one, two = Counter(), Counter()
    for text in texts:
        own = tokens(text)
        one.update(own)
        two.update(zip([None, *own], own))
    one[None] = len(texts)  # contexts at the beginning
    return one, two


def brute_mixture(kept, deleted):
    """Expectation-maximisation over the single tokens of the deleted texts."""
    one, two = counts_of(kept)
    n, v = sum(c for w, c in one.items() if w is not None), len(one) - 1
    weights = defaultdict(lambda: [1 / 3] * 3)
    weights[0] = [0, 0.5, 0.5]
    events = []
    for text in deleted:
        own = tokens(text)
        for context, word in zip([None, *own], own):
            c = one[context]
            events.append((bucket(c), two[context, word] / max(c, 1), one[word] / n, 1 / (v + 1)))
    last = -math.inf
    for _ in range(lm.ROUNDS):
        expected, likelihood = defaultdict(lambda: [1.0] * 3), 0.0
        for b, *f in events:
            shares = [w * x for w, x in zip(weights[b], f)]
            likelihood += math.log(sum(shares))
            for k in range(3):
                expected[b][k] += shares[k] / sum(shares)
        for b, e in expected.items():
            if b == 0:
                e[0] = 0
            weights[b] = [x / sum(e) for x in e]
        have = sorted(b for b in expected if b)
        for b in range(1, lm.BUCKETS):
            if have:
                weights[b] = weights[max((h for h in have if h <= b), default=have[0])]
        if likelihood / len(events) - last < lm.ENOUGH:
            break
        last = likelihood / len(events)
    return weights


def brute_scores(rows, deleted_texts):
    """rows of (text, trained): (n_tokens, n_known, N, base, score) each."""
    train = [text for text, trained in rows if trained]
    one, two = counts_of(train)
    n, v = sum(c for w, c in one.items() if w is not None), len([w for w, c in one.items() if w is not None and c])
    kept = [t for t in train if (t or "") not in deleted_texts]
    deleted = [t for t in train if (t or "") in deleted_texts]
    weights = brute_mixture(kept, deleted) if deleted and kept else defaultdict(lambda: [1 / 3] * 3, {0: [0, 0.5, 0.5]})
    out = []
    for text, _ in rows:
        own = tokens(text)
        score = 0.0
        for context, word in zip([None, *own], own):
            c = one[context]
            a, u, z = weights[bucket(c)]
            score += math.log10(a * two[context, word] / max(c, 1) + u * one[word] / n + z / (v + 1)) if n else 0.0
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in own)
        out.append((len(own), sum(one[w] > 0 for w in own), n, base, score))
    return out


def deleted_texts(spark, rows):
    given = spark.createDataFrame([((t or ""),) for t, _ in rows], "text string").distinct()
    chosen = given.filter(F.pmod(F.xxhash64(F.lit(12), "text"), F.lit(lm.HELD_OUT)) == 0)
    return {r["text"] for r in chosen.collect()}


def check(found, rows, keys, spark):
    expected = defaultdict(list)
    for key, row in zip(keys, brute_scores(rows, deleted_texts(spark, rows))):
        expected[key].append(row)
    got = defaultdict(list)
    for r in found:
        got[r.doc_id].append((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert set(got) == set(expected)
    for key, own in expected.items():
        for a, b in zip(sorted(got[key]), sorted(own), strict=True):
            assert a == pytest.approx(b, rel=1e-8, abs=1e-9), key


def trained(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 != 2


def test_query_against_brute_force(spark, sf_dir, texts):
    found = QUERIES["op12_lm_scoring"](spark, sf_dir)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    found = found.collect()
    assert all(r.held_out == (not trained(r.doc_id)) for r in found)
    keys = sorted(texts)
    check(found, [(texts[k], trained(k)) for k in keys], keys, spark)


def test_better_than_the_base_on_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    found = lm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    held_out = found.filter(F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    base, own, n = held_out.agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert own / n > base / n + 0.1


def test_small_blocks_and_many_parts(spark, docs_of):
    """Blocks of a few tokens and parts of a few keys give the same scores."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        rows.append((i, " ".join(f"w{k}" for k in rng.zipf(1.5, rng.integers(0, 40)) % 30), "en", "a", 1))
    rows += [(1000 + i, "the same hot text again", "en", "a", 1) for i in range(60)]
    docs = docs_of(rows)
    found = lm.score(docs, F.col("doc_id") % 3 != 1, block_tokens=50, part_tokens=40).collect()
    check(found, [(r[1], r[0] % 3 != 1) for r in rows], [r[0] for r in rows], spark)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 5, (7, 6))
    pairs[3] = 0  # a context that was never seen
    totals = lm.Totals(4, int(pairs.sum()), 6)
    words = pairs.sum(0)
    mixture = lm.Mixture(rng.dirichlet([1, 1, 1], lm.BUCKETS))
    mixture.weights[0] = 0, 0.25, 0.75
    for own in pairs:
        context = np.full(7, own.sum())
        p = mixture.probabilities(np.append(own, 0), context, np.append(words, 0), totals)
        assert p.sum() == pytest.approx(1)


def test_odd_rows(spark, odd):
    found = lm.score(odd, F.col("doc_id") % 2 == 0)
    rows = [(text, doc_id is not None and doc_id % 2 == 0) for doc_id, text, *_ in ODD]
    check(found.collect(), rows, [r[0] for r in ODD], spark)


def test_nothing_to_learn_from(odd, empty):
    assert lm.score(empty, F.lit(True)).collect() == []
    found = lm.score(odd, F.lit(None).cast("boolean")).collect()
    assert len(found) == len(ODD)
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in found} == {(0, 0, 0.0, 0.0)}


def test_packing_round_trip():
    for values in (np.arange(5, dtype=np.uint64) << np.uint64(50), np.zeros(0, np.int64), np.arange(9, dtype=np.uint32)):
        assert (lm.unpacked(lm.packed(values), values.dtype.str) == values).all()
