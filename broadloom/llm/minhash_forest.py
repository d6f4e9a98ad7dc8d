"""Near-duplicate documents with an LSH forest over MinHash signatures.

1. One pass sketches each text: its set of word shingles as a 64-bit name of the set (``node``),
   the set's size and a signature of ``PERMUTATIONS`` minima. Equal sets are one node from here on.
2. Every tree is one order of signature positions. All nodes of all trees are sorted by (tree,
   signature in that order) with a range partitioning, so even a region that holds a third of
   all rows is spread over tasks. Neighbours with a long common prefix are candidates. The
   depth adapts per region: a node meets the nodes of the shallowest prefix, from
   ``MIN_DEPTH`` on, that at most ``width`` nodes share.
3. Candidates whose signatures agree well enough are confirmed on their full sets, which are
   made again from the texts of the candidates alone.
4. Confirmed links give components. Where a prefix of ``MIN_DEPTH`` was deepened, or ran into the
   edge of a block or partition, and its nodes do not lie in one component yet, the step is repeated
   with ``REGION_WIDTH`` in place of ``WIDTH``, by signature inside the task.
5. What is still cut then is numbered by (tree, prefix of ``MIN_DEPTH``) and counted. Large
   regions are dealt to tiles of about ``REGION_TILE`` nodes, and every pair of tiles that can
   hold two components is compared in a group of its own, wherever its rows were sorted to; nothing of a
   region is left out.

Pairs of steps 4 and 5 may be as many as the strangers of a crowd times the crowd. They leave a task packed by
pairs of node buckets. The full sets of a bucket pair meet once, are compared there, and only a
spanning forest of the confirmed links goes on, which gives the same components.

Links, components and sketches stay in tables; only counts reach the driver.

Defined results: words are runs of characters other than ASCII white space, A-Z lower-cased. A text
with fewer words than a shingle has one shingle of all of them; a null or empty text or one
without words has none and is linked with nothing. Repeated rows and equal texts belong to one
component. Null ids take part; a component's id is its smallest id that is not null. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.llm.byte_bpe import ragged
from broadloom.llm.components import components, merge
from broadloom.llm.rows import join_counted, only, prepare, text_tag, without
from broadloom.llm.textarrays import SPACED, chunks, grouped, mix, shingle_sets, words
from broadloom.session import materialize, small_side

SHINGLE = 5
PERCENT = 85
PERMUTATIONS = 256
TREES = 24
DEPTH = 16
MIN_DEPTH = 4
WIDTH = 8
REGION_WIDTH = 4096
#: Candidates need this share of equal signature positions: four standard deviations of
#: the estimate below the threshold.
SLACK = 4.0
BLOCK_ROWS = 200_000
REGION_BLOCK_ROWS = 50_000
#: Nodes of a region that are compared with those of another tile at a time.
REGION_TILE = 2048
#: Bytes of full sets in a bucket of nodes; two buckets meet in a task.
BUCKET_BYTES = 16 << 20

_SEED = np.random.Generator(np.random.PCG64(20240917))
_FACTORS = _SEED.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_ORDERS = np.stack([_SEED.permutation(PERMUTATIONS)[:DEPTH] for _ in range(TREES)])

_SKETCH = "doc_id long, tag long, n_shingles long, node long, signature binary"


def _names(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name per set of hashes, whatever the order of its elements."""
    ends = np.cumsum(sizes)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    return mix((sums[ends] - sums[ends - sizes]) + sizes.astype(np.uint64)).view(np.int64)


def _signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """16 bits of each of the minima; a row of zeros for an empty set."""
    out = np.zeros((len(sizes), PERMUTATIONS), np.uint16)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for k, factor in enumerate(_FACTORS):
            out[full, k] = mix(np.minimum.reduceat(hashes * factor, starts)).astype(np.uint16)
    return out


def _sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    own = list(shingle_sets(words(data, offsets, SPACED), shingle))
    return np.concatenate(own), np.array([len(x) for x in own], np.int64)


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    rows, size = values.shape[0], values.shape[1] * values.itemsize
    fixed = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(size), rows, [None, pa.py_buffer(np.ascontiguousarray(values).tobytes())]
    )
    return fixed.cast(pa.binary())


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, kind).reshape(-1, width)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    prepare(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, data, offsets in chunks(batch.column(1)):
                hashes, sizes = _sets(data, offsets, shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n),
                        batch.column(2).slice(row, n),
                        pa.array(sizes),
                        pa.array(_names(hashes, sizes)),
                        _fixed(_signatures(hashes, sizes)),
                    ],
                    names=["doc_id", "tag", "n_shingles", "node", "signature"],
                )

    own = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["text"].cast("string").alias("text"),
        text_tag(docs).alias("tag"),
    )
    return own.mapInArrow(sketch, _SKETCH)


def _least_equal(percent: int) -> float:
    """Signature positions that must agree."""
    spread = (percent / 100 * (1 - percent / 100) / PERMUTATIONS) ** 0.5
    return (percent / 100 - SLACK * spread) * PERMUTATIONS


def _tree_rows(nodes: DataFrame, more: str) -> DataFrame:
    """One row per node and tree, keyed by the signature in the order of the tree."""
    extra = more.split(", ") if more else []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 4096):
                part = batch.slice(first, 4096)
                signature = _matrix(part.column(1), PERMUTATIONS, np.uint16)
                for tree, order in enumerate(_ORDERS):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(part), tree, np.int32)),
                            _fixed(signature[:, order].astype(">u2")),
                            part.column(0),
                            *part.columns[2:],
                        ],
                        names=["tree", "key", "node", *(x.split()[0] for x in extra)],
                    )

    own = nodes.select("node", "signature", *(x.split()[0] for x in extra))
    return own.mapInArrow(rows, ", ".join(["tree int, key binary, node long", *extra]))


class _Runs:
    """Rows sorted by (tree, key): common prefixes and the depth that each row's region needs."""

    def __init__(self, tree: np.ndarray, keys: np.ndarray, width: int):
        equal = (keys[1:] == keys[:-1]) & (tree[1:] == tree[:-1])[:, None]
        #: Length of the prefix that a row shares with the next one.
        self.common = np.cumprod(equal, 1, dtype=np.uint8).sum(1, dtype=np.int64)
        self.depth = np.full(len(keys), DEPTH + 1)
        for d in range(DEPTH, MIN_DEPTH - 1, -1):
            run = self.at(d)
            self.depth[np.bincount(run)[run] <= width] = d

    def at(self, depth: int) -> np.ndarray:
        """Number of the run of rows with equal prefixes of this depth."""
        return np.concatenate([[0], np.cumsum(self.common < depth)])

    def cut(self, roots: np.ndarray) -> np.ndarray:
        """Rows of runs that had to be deepened and hold several roots."""
        run = self.at(MIN_DEPTH)
        first = np.flatnonzero(np.concatenate([[True], self.common < MIN_DEPTH]))
        mixed = np.minimum.reduceat(roots, first) < np.maximum.reduceat(roots, first)
        # What stands at either end may go on in another block or partition, so it counts as cut.
        edge = (run == 0) | (run == run[-1])
        return (mixed[run] & (self.depth > MIN_DEPTH)) | edge


def _neighbours(tree: np.ndarray, keys: np.ndarray, nodes: np.ndarray, width: int) -> np.ndarray:
    """Pairs of neighbours; a node paired with itself lies in a region that was cut."""
    runs = _Runs(tree, keys, width)
    n, depth, shared = len(nodes), np.minimum(runs.depth, DEPTH), runs.common
    left, right = [], []
    for gap in range(1, min(width, n)):
        if gap > 1:
            shared = np.minimum(shared[:-1], runs.common[gap - 1 :])
        at = np.flatnonzero(shared >= depth[: n - gap])
        if not len(at):
            break
        left.append(nodes[at])
        right.append(nodes[at + gap])
    cut = np.unique(nodes[runs.cut(nodes)])
    return _ordered(np.concatenate([*left, cut]), np.concatenate([*right, cut]))


def _ordered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
    return np.unique(pairs, axis=0) if len(pairs) else pairs.astype(np.int64)


def _strangers(
    tree: np.ndarray, keys: np.ndarray, nodes: np.ndarray, roots: np.ndarray, sizes: np.ndarray,
    signatures: np.ndarray, width: int, percent: int,
) -> np.ndarray:
    """Pairs of different roots in the same region that agree well enough."""
    runs = _Runs(tree, keys, width)
    least = _least_equal(percent)
    depth = np.minimum(runs.depth, DEPTH)
    # Rows of a run need the same depth; a run begins where the prefix of that depth ends.
    first = np.flatnonzero(np.concatenate([[True], runs.common < depth[1:]]))
    left, right = [], []
    for low, high in zip(first.tolist(), [*first[1:].tolist(), len(nodes)], strict=True):
        own, counts = np.unique(roots[low:high], return_counts=True)
        if len(own) < 2:
            continue
        # Everyone outside the largest component meets those after them and the largest one.
        largest = roots[low:high] == own[counts.argmax()]
        order = np.concatenate([np.flatnonzero(~largest), np.flatnonzero(largest)]) + low
        for k, i in enumerate(order[: int((~largest).sum())].tolist()):
            others = order[k + 1 :]
            smaller = np.minimum(sizes[others], sizes[i])
            others = others[
                (roots[others] != roots[i]) & (100 * smaller >= percent * np.maximum(sizes[others], sizes[i]))
            ]
            same = signatures[others] == signatures[i]
            near = same.sum(1) >= least
            others, same = others[near], same[near]
            # Not if an earlier tree has them side by side as well: it compared them, or they count as cut.
            if depth[i] == MIN_DEPTH:
                early = _ORDERS[: tree[i], :MIN_DEPTH]
                others = others[~same[:, early].all(2).any(1)]
            left.append(np.full(len(others), nodes[i]))
            right.append(nodes[others])
    cut = np.unique(nodes[runs.cut(roots)])
    return _ordered(np.concatenate([*left, cut]), np.concatenate([*right, cut]))


def _scanned(sorted_rows: DataFrame, scan, schema: str, block_rows: int, overlap: int) -> DataFrame:
    """Run ``scan`` over blocks of sorted rows that overlap."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for first in range(0, len(batch), block_rows):
                kept.append(batch.slice(first, block_rows))
                rows += len(kept[-1])
                if rows >= block_rows + overlap:
                    table = pa.Table.from_batches(kept)
                    yield scan(table)
                    kept = table.slice(rows - overlap).combine_chunks().to_batches()
                    rows = overlap
        if kept:
            yield scan(pa.Table.from_batches(kept))

    return sorted_rows.mapInArrow(blocks, schema)


_PLAIN = "a long, b long"


def _plain(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])


_PACKED = "one int, two int, a array<long>, b array<long>"


def _packed(pairs: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Pairs as one row per pair of node buckets; a node paired with itself goes to bucket -1."""
    bucket = (mix(pairs.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    # Both nodes of a pair change places where that brings the smaller bucket to the front.
    swap = bucket[:, 0] > bucket[:, 1]
    pairs, bucket = np.where(swap[:, None], pairs[:, ::-1], pairs), np.sort(bucket, 1)
    bucket[pairs[:, 0] == pairs[:, 1]] = -1
    order = np.lexsort((bucket[:, 1], bucket[:, 0]))
    pairs, bucket = pairs[order], bucket[order]
    first = np.flatnonzero(np.diff(bucket, axis=0, prepend=-2).any(1))
    ends = pa.array(np.append(first, len(pairs)).astype(np.int32))
    sides = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(pairs[:, k]))) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[first, 0]), pa.array(bucket[first, 1]), *sides], names=["one", "two", "a", "b"]
    )


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(name).to_numpy() for name in names]


def _candidates(nodes: DataFrame, width: int) -> DataFrame:
    """(a, b) neighbours in any tree, and (a, a) for nodes of regions that were cut."""

    def scan(table: pa.Table) -> pa.RecordBatch:
        tree, node = _columns(table, "tree", "node")
        return _plain(_neighbours(tree, _matrix(table.column("key"), DEPTH, ">u2"), node, width))

    rows = _tree_rows(nodes, "").repartitionByRange("tree", "key").sortWithinPartitions("tree", "key", "node")
    return _scanned(rows, scan, _PLAIN, BLOCK_ROWS, width).distinct()


def _region_candidates(region: DataFrame, rows: int, width: int, percent: int, buckets: int) -> DataFrame:
    """Packed pairs of different components in regions that were cut, alike by their signatures."""

    def scan(table: pa.Table) -> pa.RecordBatch:
        tree, node, root, size = _columns(table, "tree", "node", "root", "n_shingles")
        keys, signatures = _matrix(table.column("key"), DEPTH, ">u2"), _matrix(
            table.column("signature"), PERMUTATIONS, np.uint16
        )
        return _packed(_strangers(tree, keys, node, root, size, signatures, width, percent), buckets)

    wide = _tree_rows(region, "root long, n_shingles long, signature binary")
    # Few large ranges, so that few regions are divided between tasks.
    ranges = 1 + rows * TREES // REGION_BLOCK_ROWS
    wide = wide.repartitionByRange(ranges, "tree", "key").sortWithinPartitions("tree", "key", "node")
    return _scanned(wide, scan, _PACKED, REGION_BLOCK_ROWS, min(width, REGION_BLOCK_ROWS // 2))


def _tiles(region: DataFrame) -> DataFrame:
    """The nodes of regions of several components, once per pair of tiles that they are compared in.

    Within a region the nodes outside its largest component meet each other and the largest one, which
    need not meet itself. ``one`` and ``two`` number the tiles of a pair, ``tile`` the node's own.
    """
    places = _tree_rows(region, "root long").select(
        "tree", F.substring("key", 1, 2 * MIN_DEPTH).alias("prefix"), "node", "root"
    )
    places = materialize(places, "places")
    by_root = places.groupBy("tree", "prefix", "root").agg(F.count("*").alias("rows"))
    regions = by_root.groupBy("tree", "prefix").agg(
        F.sum("rows").alias("rows"), F.max(F.struct("rows", "root")).alias("largest"), F.count("*").alias("roots")
    )
    regions = regions.filter("roots > 1").select(
        F.struct("tree", "prefix").alias("place"),
        "rows",
        F.col("largest.root").alias("largest"),
        F.ceil((F.col("rows") - F.col("largest.rows")) / REGION_TILE).alias("others"),
        F.ceil(F.col("largest.rows") / REGION_TILE).alias("own"),
    )
    regions = materialize(regions, "regions")
    keyed = places.select(F.struct("tree", "prefix").alias("place"), "node", "root")
    total = regions.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    dealt = join_counted(keyed, regions, "place", "rows", total)
    inside = F.col("root") == F.col("largest")
    dealt = dealt.withColumn(
        "tile",
        F.when(inside, F.col("others") + F.pmod(F.xxhash64("node"), "own")).otherwise(
            F.pmod(F.xxhash64("node"), "others")
        ),
    )
    last = F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("own")) - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return dealt.select(
        "place.tree", "place.prefix", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"),
        "tile", "node",
    )


def _between(
    tree: int, same_tile: bool, nodes: tuple, roots: tuple, sizes: tuple, signatures: tuple, percent: int
) -> np.ndarray:
    """Pairs of different roots between two tiles, or within one, that agree well enough."""
    least = _least_equal(percent)
    early = _ORDERS[:tree, :MIN_DEPTH]
    left, right = [], []
    for i in range(len(nodes[0])):
        low = i + 1 if same_tile else 0
        smaller, larger = np.minimum(sizes[1][low:], sizes[0][i]), np.maximum(sizes[1][low:], sizes[0][i])
        others = np.flatnonzero((roots[1][low:] != roots[0][i]) & (100 * smaller >= percent * larger)) + low
        same = signatures[1][others] == signatures[0][i]
        near = same.sum(1) >= least
        others, same = others[near], same[near]
        # An earlier tree that has both under one prefix has them in a pair of tiles as well.
        others = others[~same[:, early].all(2).any(1)]
        left.append(np.full(len(others), nodes[0][i]))
        right.append(nodes[1][others])
    nothing = np.zeros(0, np.int64)
    return _ordered(np.concatenate([nothing, *left]), np.concatenate([nothing, *right]))


def _region_pairs(region: DataFrame, percent: int, buckets: int = 0) -> DataFrame:
    """Pairs of different components under one prefix of any tree, alike by their signatures.

    Packed by ``buckets`` of nodes, or distinct rows (a, b) if there are none.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, *by_pair):
            yield found(tuple(group[0].column(name)[0].as_py() for name in by_pair), pa.Table.from_batches(group))

    def found(group: tuple, table: pa.Table) -> pa.RecordBatch:
        tree, _, one, two = group
        tile, node, root, size = _columns(table, "tile", "node", "root", "n_shingles")
        signatures = _matrix(table.column("signature"), PERMUTATIONS, np.uint16)
        sides = [tile == one, tile == two]
        parts = [tuple(x[side] for side in sides) for x in (node, root, size, signatures)]
        pairs = _between(tree, one == two, *parts, percent)
        return _packed(pairs, buckets) if buckets else _plain(pairs)

    by_pair = ("tree", "prefix", "one", "two")
    tiles = _tiles(region).join(region.select("node", "root", "n_shingles", "signature"), "node")
    tiles = tiles.select(*by_pair, "tile", "node", "root", "n_shingles", "signature")
    dealt = tiles.repartition(*(F.col(c) for c in by_pair)).sortWithinPartitions(*by_pair)
    return dealt.mapInArrow(compare, _PACKED) if buckets else dealt.mapInArrow(compare, _PLAIN).distinct()


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes allow the similarity and whose signatures agree well enough."""
    least = _least_equal(percent)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 4096):
                part = batch.slice(first, 4096)
                one, two = (_matrix(part.column(i), PERMUTATIONS, np.uint16) for i in (2, 3))
                yield part.select(["a", "b"]).filter(pa.array((one == two).sum(1) >= least))

    one = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    two = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    joined = pairs.join(one, "a").join(two, "b")
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return joined.filter(fits).select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")


def _full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """node and hashes of the listed nodes, made again from one text of each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                hashes, sizes = _sets(data, offsets, shingle)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_names(hashes, sizes)), own], names=["node", "hashes"]
                )

    texts = only(docs, nodes.join(wanted, "node").select("doc_id", "tag"))
    return materialize(
        texts.select(texts["text"].cast("string").alias("text"))
        .mapInArrow(sets, "node long, hashes array<long>")
        .dropDuplicates(["node"]),
        "sets",
    )


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    of = _full_sets(wanted, nodes, docs, shingle)
    one = of.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    two = of.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    joined = pairs.join(one, "a").join(two, "b")
    return joined.filter(100 * both >= percent * (F.size("ha") + F.size("hb") - both)).select("a", "b")


def _linked(a: np.ndarray, b: np.ndarray, node: np.ndarray, hashes: list[np.ndarray], percent: int) -> np.ndarray:
    """A spanning forest of the pairs whose full sets have 100 * intersection >= percent * union."""
    order = np.argsort(node)
    a, b = (order[np.searchsorted(node, x, sorter=order)] for x in (a, b))
    sizes = np.array([len(h) for h in hashes])
    first = np.append(0, np.cumsum(sizes))
    _, symbols = np.unique(np.concatenate(hashes), return_inverse=True)
    symbols = symbols.reshape(-1)
    inside = np.zeros(int(symbols.max()) + 1, bool)
    root = list(range(len(node)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    kept = []
    bounds = np.flatnonzero(np.diff(a, prepend=-1))
    for low, others in zip(bounds.tolist(), np.split(b, bounds)[1:], strict=True):
        i = int(a[low])
        inside[symbols[first[i] : first[i + 1]]] = True
        for start in range(0, len(others), 1024):
            part = others[start : start + 1024]
            at = ragged(first[part], sizes[part])
            both = np.add.reduceat(inside[symbols[at]].astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
            alike = 100 * both >= percent * (sizes[i] + sizes[part] - both)
            for j in part[alike].tolist():
                one, two = find(i), find(j)
                if one != two:
                    root[one] = two
                    kept.append((node[i], node[j]))
        inside[symbols[first[i] : first[i + 1]]] = False
    return np.array(kept, np.int64).reshape(-1, 2)


def _confirmed_together(packed: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links among packed pairs: a spanning forest for each pair of buckets, whose sets meet once."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "one", "two"):
            node, hashes, pairs = [], [], []
            for batch in group:
                for row, own in enumerate(batch.column(2).is_valid().to_pylist()):
                    if own:
                        node.append(batch.column(2)[row].as_py())
                        hashes.append(batch.column(3)[row].values.to_numpy())
                    else:
                        pairs.append(np.stack([batch.column(k)[row].values.to_numpy() for k in (4, 5)], 1))
            distinct = np.unique(np.concatenate(pairs), axis=0)
            yield _plain(_linked(distinct[:, 0], distinct[:, 1], np.array(node), hashes, percent))

    both = F.explode(F.array_distinct(F.concat("a", "b"))).alias("node")
    members = materialize(packed.select("one", "two", both).distinct(), "members")
    of = _full_sets(members.select("node").distinct(), nodes, docs, shingle)
    nothing = [F.lit(None).cast("array<bigint>").alias(x) for x in ("a", "b")]
    sides = members.join(of, "node").select("one", "two", "node", "hashes", *nothing)
    asked = packed.select(
        "one", "two", F.lit(None).cast("long").alias("node"), F.lit(None).cast("array<bigint>").alias("hashes"), "a", "b"
    )
    dealt = sides.unionByName(asked).repartition("one", "two").sortWithinPartitions("one", "two")
    return dealt.mapInArrow(confirm, _PLAIN).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the row's tag for every document."""
    sketched = materialize(sketches(docs, shingle), "sketches")
    nodes = materialize(
        sketched.filter("n_shingles > 0")
        .groupBy("node")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("first"),
            F.max("signature").alias("signature"),
            F.max("n_shingles").alias("n_shingles"),
            F.count("*").alias("rows"),
        )
        .select("node", "first.doc_id", "first.tag", "signature", "n_shingles", "rows"),
        "nodes",
    )
    found = materialize(_candidates(nodes, WIDTH), "candidates")
    alike = materialize(_alike(found.filter("a <> b"), nodes, percent), "alike")
    links = materialize(_confirmed(alike, nodes, docs, shingle, percent), "links")
    roots = materialize(components(links), "components")
    cut = found.filter("a = b").select(F.col("a").alias("node"))
    for whole in (False, True):
        cut = materialize(cut, "cut")
        n = cut.count()
        if not n:
            break
        region = nodes.join(small_side(cut, n), "node", "left_semi").join(roots, "node", "left")
        region = region.withColumn("root", F.coalesce("root", "node"))
        buckets = 1 + (region.agg(F.sum("n_shingles")).first()[0] or 0) * 8 // BUCKET_BYTES
        if whole:
            pairs = _region_pairs(region, percent, buckets)
        else:
            pairs = _region_candidates(region, n, REGION_WIDTH, percent, buckets)
        found = materialize(pairs, "candidates")
        cut = found.filter("one < 0").select(F.explode("a").alias("node")).distinct()
        new = _confirmed_together(found.filter("one >= 0"), nodes, docs, shingle, percent)
        roots = merge(roots, materialize(new, "links"))
    members = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = members.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("first")
    )
    named = members.select("node", "root", "rows").join(smallest, "root")
    named = materialize(named.select("node", "rows", F.col("first.doc_id").alias("component_id"), F.col("first.tag").alias("first_tag")), "named")
    linked = sketched.filter("n_shingles > 0").drop("signature")
    joined = join_counted(linked, named, "node", "rows", linked.count())
    alone = sketched.filter("n_shingles = 0").select(
        "*", F.col("doc_id").alias("component_id"), F.col("tag").alias("first_tag")
    )
    return joined.select(*_OUT).unionByName(alone.select(*_OUT)).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "tag",
        (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("tag") == F.col("first_tag"))).alias("first"),
    )


_OUT = ("doc_id", "n_shingles", "component_id", "tag", "first_tag")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns; of rows with its id and text all."""
    found = near_duplicates(docs, shingle, percent)
    return without(docs, found.filter(~F.col("first")).select("doc_id", "tag"))
