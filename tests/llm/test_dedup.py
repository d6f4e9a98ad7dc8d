import hashlib
from collections import defaultdict

import pytest

from broadloom.llm import exact_dedup, minhash_forest
from broadloom.llm.components import components
from tests.llm.conftest import ODD, spaced


def shingles(text, width=5):
    words = spaced(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(rows):
    """Smallest id reached over links of at least 85 percent, by position of the row."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(len(sets[i]), least[find(i)]) for i in range(len(rows))]


def mutate(words, step, shift):
    return " ".join(f"new{shift}" if i % step == shift % step else w for i, w in enumerate(words))


def near_rows():
    """A chain whose ends are no link, a crowd around one text, and look-alikes below the limit."""
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 6):  # each differs from the one before in two words
        base = [*base]
        base[20 * k], base[20 * k + 1 if k < 5 else 3] = f"x{k}", f"y{k}"
        rows.append((k, " ".join(base)))
    crowd = [f"c{i}" for i in range(200)]
    for k in range(60):
        rows.append((100 + k, " ".join([*crowd[:k], f"only{k}", *crowd[k + 1 :]])))
    far = [f"f{i}" for i in range(100)]
    for k in range(12):
        rows.append((200 + k, mutate(far, 17, k)))
    return rows


def check_near(got, rows):
    want = brute_components(rows)
    found = sorted(
        ((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got),
        key=lambda r: tuple((x is None, x) for x in r),
    )
    expected = sorted(
        ((i, n, c if n else i, i == c if n else True) for (i, _), (n, c) in zip(rows, want, strict=True)),
        key=lambda r: tuple((x is None, x) for x in r),
    )
    assert found == expected


def test_near_duplicates_of_documents(documents, texts):
    check_near(minhash_forest.near_duplicates(documents).collect(), list(texts.items()))


def test_chains_crowds_and_look_alikes(docs_of):
    rows = near_rows()
    docs = docs_of([(i, t, "en", "s", 0) for i, t in rows])
    check_near(minhash_forest.near_duplicates(docs).collect(), rows)


def test_regions_wider_than_the_window(docs_of, monkeypatch):
    """All links come out even if the first round sees two neighbours only."""
    monkeypatch.setattr(minhash_forest, "WIDTH", 2)
    rows = near_rows()
    docs = docs_of([(i, t, "en", "s", 0) for i, t in rows])
    check_near(minhash_forest.near_duplicates(docs).collect(), rows)


def test_regions_over_many_blocks_and_partitions(docs_of, monkeypatch):
    """Look-alikes fill one region of all trees; the few links lie anywhere in it."""
    monkeypatch.setattr(minhash_forest, "WIDTH", 2)
    monkeypatch.setattr(minhash_forest, "BLOCK_ROWS", 8)
    monkeypatch.setattr(minhash_forest, "REGION_BLOCK_ROWS", 4)
    monkeypatch.setattr(minhash_forest, "REGION_TILE", 5, raising=False)
    common = [f"b{i}" for i in range(895)]
    rows = []
    for k in range(200):  # 87 percent alike two and two, 80 percent otherwise
        pair, own = [f"p{k // 2}x{i}" for i in range(42)], [f"o{k}x{i}" for i in range(70)]
        rows.append((k, " ".join([*common, *pair, *own])))
    docs = docs_of([(i, t, "en", "s", 0) for i, t in rows])
    check_near(minhash_forest.near_duplicates(docs.repartition(7)).collect(), rows)


def test_tiles_hold_every_pair_of_a_region(spark, monkeypatch):
    """Pairs of equal signatures but different roots all come out, whatever tiles they are dealt to."""
    monkeypatch.setattr(minhash_forest, "REGION_TILE", 3, raising=False)
    signature = bytes(range(256)) * 2
    rows = [(i, i % 5 if i < 20 else 99, 50, bytearray(signature)) for i in range(40)]
    region = spark.createDataFrame(rows, "node long, root long, n_shingles long, signature binary")
    got = {(r["a"], r["b"]) for r in minhash_forest._region_pairs(region, 85).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1]}


def test_near_duplicates_of_odd_rows(odd):
    got = minhash_forest.near_duplicates(odd).collect()
    check_near(got, [(r[0], r[1]) for r in ODD])
    kept = minhash_forest.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=lambda x: (x is None, x)) == [1, 2, 3, 4, 6, 8, 9, 10, None, None]


def test_signatures_agree_like_the_sets():
    import numpy as np

    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 900, np.uint64)
    a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 50, np.uint64)]) for _ in range(2))
    s = minhash_forest._signatures(np.concatenate([a, b]), np.array([950, 950]))
    assert abs((s[0] == s[1]).mean() - 0.9) < 0.08


@pytest.mark.parametrize("links", [[(1, 2), (2, 3), (3, 4), (10, 9), (9, 11)], [(i, i + 1) for i in range(64)]])
def test_components(spark, links):
    want = {}
    for _ in links:
        for a, b in links:
            want[a] = want[b] = min(want.get(a, a), want.get(b, b))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_exact_copies_of_odd_rows(odd):
    got = exact_dedup.mark_copies(odd).collect()
    assert len(got) == len(ODD)
    groups = defaultdict(list)
    for doc_id, text, *_ in ODD:
        groups[text or ""].append(doc_id)
    for r in got:
        assert len(r["text_sha256"]) == 64
    by = {(r["doc_id"], r["text_sha256"]): r for r in got}
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            r = by[i, hashlib.sha256(text.encode()).hexdigest()]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), i == keep)
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [2, 3, 5, 6, 7, 8, 9, 10, None]


def test_hot_text(docs_of):
    """More than half of all rows share one text."""
    docs = docs_of([(i, "same" if i % 3 else f"text {i}", "en", "s", 0) for i in range(3000)])
    got = {r["doc_id"]: r for r in exact_dedup.mark_copies(docs).collect()}
    assert got[1]["keep_id"] == 2999 and got[1]["group_size"] == 2000 and not got[1]["kept"]
    assert got[3]["kept"] and got[3]["group_size"] == 1 and sum(r["kept"] for r in got.values()) == 1001


def test_index_remembers_earlier_batches(spark, docs_of):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = index.ingest(docs_of([(1, "a", "en", "s", 1), (2, "b", "en", "s", 1), (3, "a", "en", "s", 1)]))
    assert {r["doc_id"]: r["kept"] for r in first.collect()} == {1: False, 2: True, 3: True}
    again = exact_dedup.DigestIndex(spark, index.name)
    second = again.ingest(docs_of([(9, "a", "en", "s", 1), (8, "c", "en", "s", 1), (7, None, "en", "s", 1)]))
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in second.collect()}
    assert got == {9: (3, False), 8: (8, True), 7: (7, True)}
    assert index.table().count() == 4
    assert exact_dedup.DigestIndex(spark, index.name).ingest(docs_of([])).count() == 0


def test_index_opens_by_its_path(spark, docs_of, tmp_path):
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, path=path, buckets=3)
    index.ingest(docs_of([(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)])).count()
    spark.sql(f"DROP TABLE {index.name}")  # as a new session knows nothing of it; the files stay
    again = exact_dedup.DigestIndex(spark, path=path)
    assert again.buckets == 3 and again.table().count() == 2
    kept = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in again.ingest(docs_of([(5, "b", "", "", 0), (6, "c", "", "", 0)])).collect()}
    assert kept == {5: (2, False), 6: (6, True)} and exact_dedup.DigestIndex(spark, path=path).table().count() == 3


def test_anti_join_leaves_the_index_in_its_buckets(spark, docs_of):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    index.ingest(docs_of([(i, f"text {i}", "en", "s", 1) for i in range(50)])).count()
    groups = exact_dedup.digests(docs_of([(i, f"text {i}", "en", "s", 1) for i in range(40, 60)])).select("digest")
    new = index.unknown(groups)
    assert new.count() == 10
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty_tables(empty):
    assert exact_dedup.mark_copies(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    assert minhash_forest.near_duplicates(empty).count() == 0
    assert minhash_forest.drop_near_duplicates(empty).columns == empty.columns


def test_linked_is_a_spanning_forest_of_the_exact_links():
    import numpy as np

    rng = np.random.default_rng(4)
    base = np.arange(100, dtype=np.int64)
    hashes = [np.sort(np.where(rng.random(100) < share, base + 1000 * (i + 1), base)) for i, share in enumerate([0.05] * 12 + [0.3] * 6)]
    node = rng.permutation(len(hashes)) * 7 - 40
    pairs = np.array([(node[i], node[j]) for i in range(len(hashes)) for j in range(i)])
    found = minhash_forest._linked(pairs[:, 0], pairs[:, 1], node, hashes, 85)
    rows = {n: set(h.tolist()) for n, h in zip(node.tolist(), hashes)}
    alike = {(a, b) for a, b in pairs.tolist() if 100 * len(rows[a] & rows[b]) >= 85 * len(rows[a] | rows[b])}
    assert {tuple(p) for p in found.tolist()} <= alike

    def groups(links):
        own = {n: {n} for n in rows}
        for a, b in links:
            if own[a] is not own[b]:
                own[a] |= own[b]
                for x in own[b]:
                    own[x] = own[a]
        return {frozenset(x) for x in own.values()}

    assert groups(found.tolist()) == groups(alike)
    assert len(found) == len(rows) - len(groups(alike))


def test_packed_pairs_come_back_whole():
    import numpy as np

    rng = np.random.default_rng(9)
    pairs = rng.integers(-(1 << 62), 1 << 62, (500, 2))
    pairs[::50, 1] = pairs[::50, 0]
    for buckets in (1, 7):
        rows = minhash_forest._packed(pairs, buckets).to_pylist()
        assert len({(r["one"], r["two"]) for r in rows}) == len(rows)
        back = [tuple(sorted(p)) for r in rows for p in zip(r["a"], r["b"])]
        assert sorted(back) == sorted(tuple(sorted(p)) for p in pairs.tolist())
        assert sum(len(r["a"]) for r in rows if r["one"] == -1) == 10
    assert minhash_forest._packed(pairs[:0], 3).num_rows == 0


def test_merge_joins_components(spark):
    roots = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, root long")
    links = spark.createDataFrame([(6, 2), (9, 20), (30, 31), (1, 2)], "a long, b long")
    from broadloom.llm.components import merge

    found = {r["node"]: r["root"] for r in merge(roots, links).collect()}
    assert found == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8, 20: 8, 30: 30, 31: 30}
    nothing = spark.createDataFrame([], "a long, b long")
    assert {r["node"]: r["root"] for r in merge(roots, nothing).collect()} == {1: 1, 2: 1, 5: 5, 6: 5, 8: 8, 9: 8}


def test_null_and_empty_text_with_one_id_are_one_row(docs_of):
    rows = [(1, None, "en", "a", 0), (1, "", "en", "a", 0), (1, "", "en", "b", 0), (2, "x", "en", "a", 1)]
    kept = exact_dedup.drop_copies(docs_of(rows)).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, ""), (2, "x")]
