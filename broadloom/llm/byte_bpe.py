"""Byte-level BPE over ragged numpy arrays.

A batch of texts is cut into pre-tokens by array operations on code-point classes. The distinct
pre-tokens of the batch are then merged rank-synchronously: they lie in one ragged symbol array,
and every round replaces, in each of them at once, all occurrences of its own lowest-rank
pair. A pair with a merged symbol always ranks after the merge that made it, so this gives
the same symbols as merging one pair after another.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from broadloom.llm.textarrays import chunks, range_hashes

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
KNOWN_PRETOKENS = 400_000

# Code points that are letters or numbers in newer Unicode tables only, not in
# those of the tokenizers library (Unicode 16).
UNASSIGNED = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The class of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for found in regex.finditer(pattern, every):
            low, high = (ord(every[i]) for i in (found.start(), found.end() - 1))
            kinds[low : high + 1] = kind
    for low, high in UNASSIGNED:
        kinds[low : high + 1] = OTHER
    return kinds


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each pre-token, and first pre-token of each text (one more than texts).

    The same cuts as the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    kind = _kinds()[points]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offsets)] = True
    first[n] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first[:n]
    white = kind == SPACE
    led = np.zeros(n, bool)  # by a space, which then belongs to the pre-token
    led[1:] = points[:-1] == 0x20
    led &= ~first[:n]
    start = change & (white | ~led)
    # The last white-space character before other text stands alone or leads that text.
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:]
    start |= last & ~first[1:]

    apostrophe = np.flatnonzero((points == 0x27) & start & change)
    padded = np.concatenate([points, np.zeros(3, np.uint32)])
    bound = np.concatenate([first, np.ones(3, bool)])
    one, two = padded[apostrophe + 1], padded[apostrophe + 2]
    short = np.isin(one, [ord(c) for c in "stmd"]) & ~bound[apostrophe + 1]
    long = np.zeros(len(apostrophe), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    long &= ~bound[apostrophe + 1] & ~bound[apostrophe + 2]
    for hit, size in ((apostrophe[short], 1), (apostrophe[long], 2)):
        start[hit + 1] = False
        rest = hit + 1 + size
        rest = rest[(rest < n) & ~first[np.minimum(rest, n)]]
        start[rest[kind[rest] == LETTER]] = True
    starts = at[start] if n else np.zeros(0, np.int64)
    return starts, np.searchsorted(starts, offsets)


class Encoder:
    """Token ids of texts as the tokenizer file gives them; ``path`` must be byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        letters = {b: chr(b) for b in shown}
        letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.width = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self._index(left * self.width + right)
        self.merged = np.array([vocab[a + b] for a, b in pairs] + [-1], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.splitter = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        # Pre-tokens met before in this worker: hash, and where their ids lie.
        self._reset()

    def _reset(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.seen_first = np.zeros(0, np.int64)
        self.seen_size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _index(self, keys: np.ndarray) -> None:
        """A hash table from pairs to ranks: open addressing with linear probing."""
        self.bits = max(len(keys) * 5, 2).bit_length()
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.zeros(1 << self.bits, np.int64)
        open_keys, at = np.arange(len(keys)), self._slot(keys)
        while len(open_keys):
            free = np.flatnonzero(self.slots[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            placed = free[one]
            self.slots[at[placed]] = keys[open_keys[placed]]
            self.ranks[at[placed]] = open_keys[placed]
            left = np.ones(len(open_keys), bool)
            left[placed] = False
            open_keys, at = open_keys[left], (at[left] + 1) & (len(self.slots) - 1)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        spread = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each symbol; the highest value where there is none."""
        none = len(self.merged) - 1
        rank = np.full(len(symbols), none, np.int64)
        at = np.flatnonzero(~last[:-1])
        pair = symbols[at] * self.width + symbols[at + 1]
        slot = self._slot(pair)
        while len(at):
            found = self.slots[slot]
            hit = found == pair
            rank[at[hit]] = self.ranks[slot[hit]]
            more = ~hit & (found >= 0)
            at, pair, slot = at[more], pair[more], (slot[more] + 1) & (len(self.slots) - 1)
        return rank

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge ragged sequences to the end; their symbols and sizes in the same order."""
        none = len(self.merged) - 1
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        which = np.arange(len(sizes))
        while len(which):
            ends = np.cumsum(sizes)
            last = np.zeros(len(symbols), bool)
            last[ends - 1] = True
            rank = self._ranks(symbols, last)
            lowest = np.minimum.reduceat(rank, ends - sizes)
            going = lowest < none
            own = np.repeat(going, sizes)
            if not going.all():
                out.append((which[~going], symbols[~own], sizes[~going]))
                symbols, rank = symbols[own], rank[own]
                which, sizes, lowest = which[going], sizes[going], lowest[going]
                if not len(which):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            if len(hit) > 1:  # "aaa": of overlapping pairs the first, the third, ...
                new = np.ones(len(hit), bool)
                new[1:] = hit[1:] != hit[:-1] + 1
                place = np.arange(len(hit))
                hit = hit[(place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            owner = np.repeat(np.arange(len(which)), sizes)
            sizes = sizes - np.bincount(owner[hit], minlength=len(which))
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols = symbols[keep]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.concatenate([x[0] for x in out])
        flat, sizes = np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out])
        order = np.argsort(which)
        return flat[ragged(np.cumsum(sizes)[order] - sizes[order], sizes[order])], sizes[order]

    def _lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """For each pre-token, the place and number of its ids in ``self.ids``."""
        hashes = range_hashes(data, starts, ends)
        distinct, example, index = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.seen) > KNOWN_PRETOKENS:
            self._reset()
        slot = np.minimum(np.searchsorted(self.seen, distinct), max(len(self.seen) - 1, 0))
        known = self.seen[slot] == distinct if len(self.seen) else np.zeros(len(distinct), bool)
        if not known.all():
            at = example[~known]
            sizes = ends[at] - starts[at]
            flat, sizes = self.merge(self.of_byte[data[ragged(starts[at], sizes)]], sizes)
            first = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, flat.astype(np.int32)])
            seen = np.concatenate([self.seen, distinct[~known]])
            order = np.argsort(seen, kind="stable")
            self.seen = seen[order]
            self.seen_first = np.concatenate([self.seen_first, first])[order]
            self.seen_size = np.concatenate([self.seen_size, sizes])[order]
            slot = np.searchsorted(self.seen, distinct)
        slot = slot[index]
        return self.seen_first[slot], self.seen_size[slot]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray):
        """Texts cut at special strings: offsets of the pieces, text of each, specials after it."""
        text = data.tobytes()
        if not any(s.encode() in text for s in self.special):
            return data, offsets, np.arange(len(offsets) - 1), None
        parts, owner, after = [], [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            whole, end = text[a:b].decode(), 0
            for found in self.splitter.finditer(whole):
                parts.append(whole[end : found.start()].encode())
                owner.append(i)
                after.append(self.special[found.group()])
                end = found.end()
            parts.append(whole[end:].encode())
            owner.append(i)
            after.append(-1)
        cuts = np.cumsum([0, *map(len, parts)])
        return np.frombuffer(b"".join(parts), np.uint8), cuts, np.array(owner), np.array(after)

    def count(self, column: pa.Array) -> np.ndarray:
        """Number of tokens of each text; null counts as empty."""
        out = np.zeros(len(column), np.int64)
        for row, n, data, offsets in chunks(column):
            data, cuts, owner, after = self._pieces(data, offsets)
            starts, first = pretokens(data, cuts)
            _, sizes = self._lookup(data, starts, np.append(starts[1:], len(data)))
            total = np.concatenate([[0], np.cumsum(sizes)])
            per_piece = total[first[1:]] - total[first[:-1]]
            if after is not None:
                per_piece = per_piece + (after >= 0)
            out[row : row + n] = np.bincount(owner, per_piece, n).astype(np.int64)
        return out

    def encode(self, column: pa.Array):
        """Per chunk of texts: first row, ids of all its texts in order, and their counts."""
        for row, n, data, offsets in chunks(column):
            data, cuts, owner, after = self._pieces(data, offsets)
            starts, first = pretokens(data, cuts)
            at, sizes = self._lookup(data, starts, np.append(starts[1:], len(data)))
            ids = self.ids[ragged(at, sizes)]
            total = np.concatenate([[0], np.cumsum(sizes)])
            per_piece = total[first[1:]] - total[first[:-1]]
            if after is not None:
                special = np.flatnonzero(after >= 0)
                ids = np.insert(ids, total[first[1:]][special], after[special])
                per_piece = per_piece + (after >= 0)
            yield row, ids, np.bincount(owner, per_piece, n).astype(np.int64)


def ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] of them), first[1], ..."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(first - (ends - sizes), sizes)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and tokenizer file."""
    return Encoder(path)
