import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from broadloom.llm import byte_bpe, packing, token_counts
from tests.llm.conftest import ODD

PATH = token_counts.default_tokenizer()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_and_ids_of_mixed_strings(library):
    parts = ["'s", "'", "'ll", "'re", " ", "  ", "\n", "\t", "a", "S", "s", "é", "1", "٣", "!", "'ve", " 's", "st", "d",
             "<|endoftext|>", " ", "漢", "🙂", "　", "'LL", "\x1c", "\x85", "՘", "aaaa"]
    rng = random.Random(7)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(4000)]
    texts += ["a" * 5000, "the" * 3000, "", " ", "1" * 2999]
    want = [ids_of(library, t) for t in texts]
    encoder = byte_bpe.Encoder(PATH)
    assert encoder.count(pa.array(texts)).tolist() == [len(x) for x in want]
    ids = np.concatenate([ids for _, ids, _ in encoder.encode(pa.array(texts))])
    assert ids.tolist() == [i for x in want for i in x]


def test_every_code_point_has_the_class_of_the_library(library):
    every = [c for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["x".join(map(chr, every[i : i + 500])) for i in range(0, len(every), 500)]
    texts += ["1".join(map(chr, every[i : i + 500])) for i in range(0, 20_000, 500)]
    assert byte_bpe.Encoder(PATH).count(pa.array(texts)).tolist() == [len(ids_of(library, t)) for t in texts]


def test_forgetting_known_pretokens_changes_nothing(library, monkeypatch, texts):
    monkeypatch.setattr(byte_bpe, "KNOWN_PRETOKENS", 10)
    some = list(texts.values())[:40]
    encoder = byte_bpe.Encoder(PATH)
    for text in some:
        assert encoder.count(pa.array([text])).tolist() == [len(ids_of(library, text))]


def test_counts_of_documents(documents, texts, library):
    got = token_counts.count_tokens(documents, PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(ids_of(library, texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)


def test_counts_of_odd_rows(odd, empty, library):
    got = token_counts.count_tokens(odd, PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = [(i, len((t or "").encode()), len(ids_of(library, t))) for i, t, *_ in ODD]
    assert sorted(((r[0], r[1], r[2]) for r in got), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(empty, PATH).count() == 0


def check_packing(rows, docs, library, size=2048):
    """Whole documents in order, every sequence without gap or overlap."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    wanted = defaultdict(list)
    for doc_id, text, *_ in docs:
        ids = np.array([*ids_of(library, text), 0], "<u4")
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
        wanted[doc_id] += [
            (k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
        ]
    found = {
        i: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in part) for i, part in by_doc.items()
    }
    assert found == {i: sorted(part) for i, part in wanted.items()}
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(by_sequence)


def test_packing_of_documents(documents, texts, library):
    rows = packing.pack(documents, PATH).collect()
    used = check_packing(rows, list(texts.items()), library)
    bound = packing.lower_bound(np.array([r["length"] for r in rows]), 2048)
    assert bound <= used <= bound + max(r["bound_gap"] for r in rows)


def test_packing_of_odd_rows(odd, empty, library):
    check_packing(packing.pack(odd, PATH).collect(), ODD, library)
    assert packing.pack(empty, PATH).count() == 0


def test_groups_with_gaps_exchange_documents(documents, texts, library, monkeypatch):
    whole = check_packing(packing.pack(documents, PATH).collect(), list(texts.items()), library)
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    monkeypatch.setattr(packing, "ROUNDS", 1)
    alone = check_packing(packing.pack(documents, PATH).collect(), list(texts.items()), library)
    monkeypatch.setattr(packing, "ROUNDS", 6)
    rounds = check_packing(packing.pack(documents, PATH).collect(), list(texts.items()), library)
    assert whole <= rounds <= alone


def fewest_bins(lengths, size):
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, size - lengths[i]])

    place(0, [])
    return best


def test_lower_bounds_never_exceed_the_optimum():
    rng = random.Random(3)
    met = 0
    for _ in range(150):
        size = rng.choice([10, 30, 64])
        lengths = sorted((rng.randint(1, size) for _ in range(rng.randint(1, 9))), reverse=True)
        bound, best = packing.lower_bound(np.array(lengths), size), fewest_bins(lengths, size)
        assert bound <= best
        assert len(packing.best_fit(np.array(lengths), size)[2]) >= best
        met += bound == best
    assert met > 120


def test_sequences_hold_the_ids(documents, library, texts):
    some = documents.limit(30)
    placed = packing.pack(some, PATH)
    rows = placed.collect()
    filled = {r["sequence_id"]: r["ids"] for r in packing.sequences(some, placed, PATH).collect()}
    assert sum(map(len, filled.values())) == sum(r["length"] for r in rows)
    for r in rows:
        part = np.array(filled[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]], "<u4")
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
