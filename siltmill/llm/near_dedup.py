"""MinHash near-duplicates by an LSH forest.

A document is its set of word triples. Each of the forest's trees orders all documents by a label of
several min-hashes, and sorting does the rest: documents that share a long prefix of a label stand
side by side. A region of a tree is a run of one common prefix, of the least depth at which it holds no more
documents than may be compared pair by pair; so depth adapts to each region, and no task holds a large one.
Pairs are compared by a sketch of further min-hashes; in one that holds more than
a leaf may, runs that agree on the whole label come first, and a document that is surely near a leader
isn't compared with the others that are, as the leader joins them.
Where a passage that very many documents share fills regions, deeper prefixes alone would part near documents.
So the documents of full regions also meet by min-hashes of their rare shingles, in regions that are small as
these shingles are rare, and those of the same common shingles meet the shortest of them.
As all this may still part near documents, an exact join of the documents of full regions follows, which finds
whatever links their groups: by the rarest shingles of each set where a pair shares a rare one, else by the
overlaps of all distinct sets of common shingles. So a full region loses no link.
The sketch only drops what is clearly not near. Every other pair is verified by the Jaccard similarity
of the two sets themselves; near pairs make edges, and the groups are the connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmill.llm.text import Codes, mix, pieces, ragged, words
from siltmill.operators.graph import connected_components
from siltmill.session import discard, written

#: Documents are near from this Jaccard similarity of their word triples.
THRESHOLD = 0.4
SHINGLE = 3
TREES = 16
#: Min-hashes in a tree's label: the depth at most. Regions start at the least depth.
DEPTH = 8
LEAST_DEPTH = 2
#: Regions of so few documents are compared many at a time, pair by pair; this changes no result.
LEAF = 24
#: Documents in a region whose pairs are all compared. A fuller region is cut by further min-hashes, and its
#: documents also meet by shingles that no more than so many of them share.
FULL = 512
#: Orders of such documents by one min-hash of their rare shingles.
RARE = 32
#: Rows that are compared with one at once; this stays within the cache and changes no result.
HELD = 4096
#: Min-hashes in the sketch, of 4 bits each.
SKETCH = 256
#: A pair is left to verification where its sketches say at most so much less than the threshold: three
#: standard errors.
SLACK = 0.1
#: A pair whose sketches say so much more than the threshold (six standard errors) is surely near.
SURE = 0.2
#: Documents of a region's order whose sets are verified together.
BLOCK = 512
#: Distinct sets of common shingles, and shingles of them, on each side of a tile; and sets in its strips. These
#: change no result.
TILE = 4096
TILE_SHINGLES = 1 << 22
STRIP = 512
#: Shingles that are looked up at once.
LOOKED_UP = 1 << 21
_K = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.RandomState(20240501)
_A = (_rng.randint(0, 1 << 31, TREES * DEPTH + SKETCH + RARE).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.randint(0, 1 << 32, TREES * DEPTH + SKETCH + RARE, dtype=np.uint64).astype(np.uint32)
_RARE = slice(TREES * DEPTH + SKETCH, None)
#: For a byte that is the xor of two bytes: how many of its halves are zero.
_SAME = np.array([(b >> 4 == 0) + (b & 15 == 0) for b in range(256)], np.uint8)


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """32-bit hashes of each text's word triples, with repeats. Words are in lower case; a text of fewer
    words is one shingle, and one without words or null has none."""
    codes, parts = Codes(), []
    for text in texts:
        parts.append(codes.of(words(text.lower())) if text else np.empty(0, np.int64))
    table = mix(np.fromiter((crc32(w.encode()) << 16 ^ len(w) for w in codes), np.uint64, len(codes)))
    out = []
    for part in parts:
        h = table[part]
        m = max(min(SHINGLE, len(h)), 1)
        acc = h[: len(h) - m + 1].copy() if len(h) else h
        for k in range(1, m):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - m + 1 + k]
        out.append((mix(acc) >> np.uint64(32)).astype(np.uint32))
    return out


def minima(shingle: np.ndarray, which: slice = slice(TREES * DEPTH + SKETCH)) -> np.ndarray:
    """The least value of each permutation."""
    a, b = _A[which], _B[which][:, None]
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingle), 256):  # stays within the cache
        x = np.multiply.outer(a, shingle[at : at + 256])
        x += b
        np.minimum(least, x.min(1), out=least)
    return least


def _sketch(least: np.ndarray) -> bytes:
    low = (mix(least[TREES * DEPTH :].astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
    return (low[::2] << 4 | low[1::2]).tobytes()


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, same, label, sketch): same is a 128-bit hash that equal signatures share; a text without words has nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            same, label, sketch = [], [], []
            for s in shingles(b.column(1).to_pylist()):
                if not len(s):
                    same.append(None), label.append(None), sketch.append(None)
                    continue
                least = minima(s)
                raw = least.tobytes()
                same.append(xxhash.xxh3_128_digest(raw))
                label.append(raw[: TREES * DEPTH * 4])
                sketch.append(_sketch(least))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array(label, pa.binary()), pa.array(sketch, pa.binary())], ["id", "same", "label", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, same binary, label binary, sketch binary")


def _shares(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The similarity of each sketch with one: the share of equal halves, less what chance gives. Sketches are 64-bit words."""
    out = np.empty(len(sketches))
    for at in range(0, len(sketches), HELD):
        x = sketches[at : at + HELD] ^ one
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        x &= np.uint64(0x1111111111111111)
        out[at : at + HELD] = 1 - np.bitwise_count(x).sum(1, dtype=np.int64) / SKETCH
    return (out - 1 / 16) / (15 / 16)


class _Region:
    """Edges of regions, as (place, place) pairs of rows sorted by their labels, from a threshold on; from sure on
    a pair's other neighbours are told apart only once."""

    def __init__(self, labels: np.ndarray, sketches: np.ndarray, threshold: float, sure: float):
        self.labels, self.sketches, self.threshold, self.sure = labels, sketches, threshold, sure
        self.words = sketches.view(np.uint64)
        self.root = np.arange(len(sketches))
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.n = 0

    def add(self, left, right) -> None:
        self.left.append(left)
        self.right.append(right)
        self.n += len(left)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """The edges since the last call."""
        none = np.empty(0, np.int64)
        out = np.concatenate([none, *self.left]), np.concatenate([none, *self.right])
        self.left, self.right, self.n = [], [], 0
        return out

    def compare(self, leaves: list[tuple[int, int]]) -> None:
        """All pairs of each leaf, many leaves at a time."""
        by_size: dict[int, list[int]] = {}
        for a, b in leaves:
            by_size.setdefault(b - a, []).append(a)
        for size, starts in by_size.items():
            i, j = np.triu_indices(size, 1)
            for at in range(0, len(starts), max(1, 8192 // len(i))):
                first = np.array(starts[at : at + max(1, 8192 // len(i))])[:, None]
                left, right = (first + i).ravel(), (first + j).ravel()
                same = _SAME[self.sketches[left] ^ self.sketches[right]].sum(1, dtype=np.int64)
                ok = (same / SKETCH - 1 / 16) / (15 / 16) >= self.threshold
                self.add(left[ok], right[ok])

    def meet(self, one: int, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
        """One row against others; which of them are surely near."""
        share = _shares(words, self.words[one])
        other = rows[share >= self.threshold]
        self.add(np.full(len(other), one), other)
        return share >= self.sure

    def lead(self, rows: np.ndarray, leaders: list[int]) -> Iterator[None]:
        """Every leader against all rows that have none yet; who is surely near none becomes the next leader."""
        words = self.words[rows]
        while len(rows):
            one = int(rows[0])
            leaders.append(one)
            rows, words = rows[1:], words[1:]
            sure = self.meet(one, rows, words)
            if sure.any():
                self.root[rows[sure]] = one
                rows, words = rows[~sure], words[~sure]
            yield

    def whole(self, a: int, b: int) -> Iterator[None]:
        """All pairs of a region, save those that leaders join. Yields now and then, for edges to be taken."""
        label = self.labels[a:b]
        cuts = [a, *(np.flatnonzero((label[1:] != label[:-1]).any(1)) + a + 1).tolist(), b]
        firsts: list[int] = []
        for x, y in zip(cuts, cuts[1:]):
            yield from self.lead(np.arange(x, y), firsts)
        leaders: list[int] = []
        yield from self.lead(np.array(firsts), leaders)
        root = self.root
        root[a:b] = root[root[a:b]]
        # leaders have met each other; what is left are their followers, against all of other leaders
        rows = np.arange(a, b)
        follows = root[rows] != rows
        order = rows[np.lexsort((follows, root[rows]))]
        follows = order[root[order] != order]
        rank = np.searchsorted(root[follows], root[order], "right")  # of the first follower of a later leader
        end = np.searchsorted(root[order], root[order], "right")
        plan = zip(order.tolist(), (root[order] != order).tolist(), rank.tolist(), end.tolist())
        for one, follower, after, later in plan:
            others = order[later:] if follower else follows[after:]
            others = others[root[others] != root[one]]
            if len(others):
                sure = self.meet(one, others, self.words[others])
                for r in np.unique(root[others[sure]]).tolist():
                    root[a:b][root[a:b] == r] = root[one]
                yield


def _tails(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(1).to_pylist()), ">u4").reshape(table.num_rows, -1)


def _prefix_keys(labels: np.ndarray, tree: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """A key for each row's region: that of the first depth min-hashes of labels[i] in its tree."""
    key = tree.astype(np.uint64) + np.uint64(1)
    for k in range(int(depth.max()) if len(depth) else 0):
        key = np.where(k < depth, mix(key * _K + labels[:, k].astype(np.uint64)), key)
    return key.view(np.int64)


def _labels(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), TREES, DEPTH)


def prefix_regions(signed: DataFrame, low: int, high: int, trees: bool = False) -> DataFrame:
    """(id, tree, depth, key) of all regions of depth low to high that a row of signed (id, label) is in; trees:
    only those of the trees that its column of this name lists."""
    kind = signed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            labels = _labels(b.column(1))
            if trees:
                tree = b.column(2).flatten().to_numpy()
                row = np.repeat(np.arange(b.num_rows), np.array(b.column(2).value_lengths()))
            else:
                row, tree = np.repeat(np.arange(b.num_rows), TREES), np.tile(np.arange(TREES), b.num_rows)
            depth = np.tile(np.arange(low, high + 1), len(row))
            row, tree = np.repeat(row, high + 1 - low), np.repeat(tree, high + 1 - low)
            key = _prefix_keys(labels[row, tree], tree, depth)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(tree.astype(np.int32)), pa.array(depth.astype(np.int32)), pa.array(key)], ["id", "tree", "depth", "key"])

    return signed.select("id", "label", *["trees"] * trees).mapInArrow(run, f"id {kind}, tree int, depth int, key long")


def full_regions(signed: DataFrame, full: int = FULL) -> DataFrame | None:
    """(id, label, sketch, deeper) of the documents in regions of more than full rows, written; None where there are none.

    deeper lists (tree, depth, parts) for the trees where a document's region is that full: the least depth
    where it isn't any more. Where even rows of one whole label are more, they go by parts. What is counted
    are keys, so no region is gathered anywhere."""
    first = prefix_regions(signed, LEAST_DEPTH, LEAST_DEPTH)
    keys = written(first.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > full).select("key"))
    if keys.isEmpty():
        discard(keys)
        return None
    held = written(first.join(keys, "key").select("id", "tree"))
    mine = written(held.groupBy("id").agg(F.collect_set("tree").alias("trees")))  # its size is known where it is joined
    those = written(signed.join(mine, "id"))
    below = written(prefix_regions(those, LEAST_DEPTH + 1, DEPTH, trees=True))
    fuller = written(below.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > full))
    deep = below.join(fuller, "key").groupBy("id", "tree").agg(F.max("depth").alias("depth"), F.max(F.when(F.col("depth") == DEPTH, F.col("n"))).alias("n"))
    found = held.join(deep, ["id", "tree"], "left").select(
        "id",
        F.struct(
            "tree",
            F.least(F.coalesce(F.col("depth"), F.lit(LEAST_DEPTH)) + 1, F.lit(DEPTH)).cast("int").alias("depth"),
            F.coalesce(F.ceil(F.col("n") / full), F.lit(1)).cast("int").alias("parts"),
        ).alias("d"),
    )
    deeper = written(those.select("id", "label", "sketch").join(found.groupBy("id").agg(F.collect_list("d").alias("deeper")), "id"))
    for t in (keys, held, mine, those, below, fuller):
        discard(t)
    return deeper


def tree_rows(signed: DataFrame) -> DataFrame:
    """(region, tail, id, sketch, cut): where each row of signed (id, label, sketch) stands in each tree. Regions have
    the least depth, save those that a column deeper names, see full_regions(); cut is the full region that such a
    one was cut from."""
    kind, deep = signed.schema["id"].dataType.simpleString(), "deeper" in signed.columns

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            labels = _labels(b.column(1))
            depth, parts = np.full((n, TREES), LEAST_DEPTH), np.ones((n, TREES), np.int64)
            if deep:
                lists = b.column(4)
                row = np.repeat(np.arange(n), np.array(lists.value_lengths().fill_null(0)))
                tree, d, p = (x.to_numpy() for x in lists.flatten().flatten())
                depth[row, tree], parts[row, tree] = d, p
            sketch, hashed = b.column(2), b.column(3).to_numpy().view(np.uint64)
            for t in range(TREES):
                key = _prefix_keys(labels[:, t], np.full(n, t), depth[:, t]).view(np.uint64)
                cut = pa.array(_prefix_keys(labels[:, t], np.full(n, t), np.full(n, LEAST_DEPTH)), mask=depth[:, t] == LEAST_DEPTH)
                part = hashed % parts[:, t].astype(np.uint64)
                key = np.where(parts[:, t] > 1, mix(key * _K + part), key)
                tails = np.ascontiguousarray(labels[:, t, LEAST_DEPTH:]).astype(">u4").tobytes()
                width = 4 * (DEPTH - LEAST_DEPTH)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array([tails[i : i + width] for i in range(0, len(tails), width)], pa.binary()), b.column(0), sketch, cut], ["region", "tail", "id", "sketch", "cut"]
                )

    rows = signed.select("id", "label", "sketch", F.xxhash64("id").alias("hashed"), *["deeper"] * deep)
    return rows.mapInArrow(grow, f"region long, tail binary, id {kind}, sketch binary, cut long")


def leader_rows(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(region, tail, id, sketch): for each part of a full region the one document (id, size) of the fewest shingles
    in all of it, which is nearest to documents that share nothing else. rows: those of tree_rows()."""
    cut = rows.where(F.col("cut").isNotNull())
    first = cut.join(sizes, "id").groupBy("cut").agg(F.min_by(F.struct("id", "sketch"), F.struct("size", "id")).alias("f"))
    tail = F.lit(bytes(4 * (DEPTH - LEAST_DEPTH)))
    return cut.select("cut", "region").distinct().join(first, "cut").select("region", tail.alias("tail"), "f.id", "f.sketch")


def rare_rows(docs: DataFrame, ids: DataFrame, full: int = FULL) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(rows as of tree_rows(), pairs, tables behind both): where else documents (id, text) of full regions meet.

    A shingle that more than full of them hold is common. By min-hashes of the other ones each document has
    RARE more regions, none of more than full rows. Documents of the very same common shingles are paired with
    the one of fewest shingles among them, which is near each that another of them is near by these alone.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            sets = [np.unique(s) for s in shingles(b.column(1).to_pylist())]
            some = np.flatnonzero([len(s) > 0 for s in sets])
            ends = np.cumsum([0] + [len(sets[i]) for i in some])
            data = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint32), *(sets[i] for i in some)]).view(np.int32)))
            sketch = pa.array([_sketch(minima(sets[i])) for i in some], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), sketch, data], ["id", "sketch", "data"])

    texts = docs.where(F.col("text").isNotNull()).join(ids, "id", "left_semi").distinct()
    sets = written(texts.select("id", "text").mapInArrow(make, f"id {kind}, sketch binary, data array<int>"))
    each = sets.select("id", F.explode("data").alias("s"))
    common = written(each.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > full).select("s"))
    mine = written(each.join(common, "s").groupBy("id").agg(F.sort_array(F.collect_set("s")).alias("common")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = bytes(4 * (DEPTH - LEAST_DEPTH))
        for b in batches:
            keys, row = [np.empty(0, np.int64)], []
            for i in range(b.num_rows):
                rare = np.setdiff1d(b.column(2)[i].values.to_numpy(), b.column(3)[i].values.to_numpy() if b.column(3)[i].is_valid else [], assume_unique=True).view(np.uint32)
                if len(rare):
                    least = minima(rare, _RARE).astype(np.uint64)
                    keys.append(mix(mix(np.arange(TREES + 1, TREES + RARE + 1, dtype=np.uint64) * _K) + least).view(np.int64))
                    row += [i] * RARE
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array([tail] * len(row), pa.binary()), b.column(0).take(at), b.column(1).take(at)], ["region", "tail", "id", "sketch"])

    rows = sets.join(mine, "id", "left").select("id", "sketch", F.array_sort("data").alias("data"), "common").mapInArrow(spread, f"region long, tail binary, id {kind}, sketch binary")
    alike = mine.select("id", F.sha2(F.to_json("common"), 256).alias("alike")).join(sets.select("id", F.size("data").alias("size")), "id")
    first = alike.groupBy("alike").agg(F.min_by("id", F.struct("size", "id")).alias("first"), F.ceil(F.count("*") / BLOCK).alias("parts"))
    met = alike.join(first, "alike").where(F.col("id") != F.col("first"))
    unit = F.xxhash64("alike", F.pmod(F.xxhash64("id"), F.col("parts")))
    return rows, met.select(F.least("id", "first").alias("left"), F.greatest("id", "first").alias("right"), unit.alias("unit")).distinct(), [sets, common, mine]


def tree_edges(signed: DataFrame, threshold: float = THRESHOLD - SLACK, sure: float = THRESHOLD + SURE, rows: DataFrame | None = None) -> DataFrame:
    """(left, right, unit): pairs that some tree brings together and whose sketches reach threshold, once each,
    left being the lesser. Of documents that pairs from sure on join already, not all pairs are given. Pairs of one unit come from one part of a region, so they share documents.
    signed: id, label, sketch; rows: those of tree_rows(), made of signed where none are given."""
    kind = signed.schema["id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            regions = b.column(0).to_numpy()
            whole = int(np.searchsorted(regions, regions[-1], "left"))
            if whole or regions[0] != last:  # a region is held whole; only the last one may go on
                if whole:
                    held.append(b.slice(0, whole))
                if held:
                    yield from edges(pa.Table.from_batches(held))
                held, last = [], regions[-1]
            held.append(b.slice(whole))
        if held:
            yield from edges(pa.Table.from_batches(held))

    def edges(table: pa.Table) -> Iterator[pa.RecordBatch]:
        regions = table.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(regions)) + 1, [len(regions)]])
        size = np.diff(cuts)
        keep = np.repeat(size > 1, size)
        table = table.filter(pa.array(keep))
        if not table.num_rows:
            return
        regions = regions[keep]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(regions)) + 1, [len(regions)]]).tolist()
        labels = np.zeros((len(regions), DEPTH), np.uint32)
        labels[:, LEAST_DEPTH:] = _tails(table)
        sketches = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(len(regions), -1)
        found = _Region(labels, sketches, threshold, sure)
        block = (np.arange(len(regions)) - np.repeat(cuts[:-1], np.diff(cuts))).astype(np.uint64) // np.uint64(BLOCK)
        ids = table.column(2).combine_chunks()

        def taken() -> pa.RecordBatch:
            left, right = found.taken()
            low, high = np.minimum(block[left], block[right]), np.maximum(block[left], block[right])
            unit = mix((mix(regions.view(np.uint64)[left] + _K * low) + high) * _K).view(np.int64)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(left)), ids.take(pa.array(right)), pa.array(unit)], ["left", "right", "unit"])

        found.compare([(a, b) for a, b in zip(cuts, cuts[1:]) if b - a <= LEAF])
        yield taken()
        for a, b in zip(cuts, cuts[1:]):
            if b - a > LEAF:
                for _ in found.whole(a, b):
                    if found.n > 1 << 20:
                        yield taken()
        yield taken()

    sorted_ = (tree_rows(signed).drop("cut") if rows is None else rows).repartition("region").sortWithinPartitions("region", "tail")
    found = sorted_.mapInArrow(search, f"left {kind}, right {kind}, unit long").where(F.col("left") != F.col("right"))
    return found.groupBy(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).agg(F.min("unit").alias("unit"))


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of sets[left[i]] and sets[right[i]], for each i; sets without repeats, none empty."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.cumsum(size) - size
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    here = np.zeros(int(codes.max()) + 1, bool)
    order = np.argsort(left, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(left[order])) + 1, [len(order)]]).tolist()
    out = np.empty(len(left))
    for a, b in zip(cuts, cuts[1:]):
        one = int(left[order[a]])
        own = codes[start[one] : start[one] + size[one]]
        here[own] = True
        while a < b:
            ends = np.cumsum(size[right[order[a:b]]])
            to = a + max(1, int(np.searchsorted(ends, LOOKED_UP, "right")))
            rows = order[a:to]
            others = right[rows]
            both = np.add.reduceat(here[codes[ragged(start[others], size[others])]], np.cumsum(size[others]) - size[others], dtype=np.int64)
            out[rows] = both / (size[one] + size[others] - both)
            a = to
        here[own] = False
    return out


def verified(pairs: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(left, right): those of pairs (left, right, unit) whose sets of word triples have the threshold's Jaccard similarity.

    A document's set goes once to each unit that has a pair of it. Where rows repeat an id, a pair counts
    that some of its texts make.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            sets = [np.unique(s) for s in shingles(b.column(1).to_pylist())]
            some = np.flatnonzero([len(s) > 0 for s in sets])
            data = pa.array([sets[i].tobytes() for i in some], pa.binary())
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), data], ["id", "units", "data"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(_wanted(pairs).hint("merge"), "id")
    sets = texts.select("id", "text", "units").mapInArrow(make, f"id {kind}, units array<long>, data binary")
    return _verified(pairs, sets, threshold)


def _wanted(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("left", "right")).alias("id"), "unit").groupBy("id").agg(F.collect_set("unit").alias("units"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """verified() for sets (id, units, data)."""
    kind = pairs.schema["left"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            held = table if held is None else pa.concat_tables([held, table])
            units = held.column(0).to_numpy()
            if units[0] != units[-1]:  # the last unit may go on
                whole = int(np.searchsorted(units, units[-1], "left"))
                yield from near(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield from near(held)

    def near(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        units = table.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(units)) + 1, [len(units)]]).tolist()
        first, second, data = (table.column(i).combine_chunks() for i in (1, 2, 3))
        is_pair = second.is_valid().to_numpy(zero_copy_only=False)
        for a, b in zip(cuts, cuts[1:]):
            n = int(np.count_nonzero(~is_pair[a:b]))  # the sets stand first
            ids, left, right = first.slice(a, n), first.slice(a + n, b - a - n), second.slice(a + n, b - a - n)
            sets = [np.frombuffer(x, np.uint32) for x in data.slice(a, n).to_pylist()]
            row = np.arange(len(left))
            if pc.count_distinct(ids).as_py() == n:
                i, j = (pc.index_in(x, value_set=ids).to_numpy() for x in (left, right))
            else:
                places: dict = {}
                for k, x in enumerate(ids.to_pylist()):
                    places.setdefault(x, []).append(k)
                met = [(k, x, y) for k, (p, q) in enumerate(zip(left.to_pylist(), right.to_pylist())) for x in places[p] for y in places[q]]
                row, i, j = np.array(met, np.int64).T
            ok = pa.array(np.unique(row[overlaps(sets, i, j) >= threshold]))
            yield pa.RecordBatch.from_arrays([left.take(ok), right.take(ok)], ["left", "right"])

    each = sets.select(F.explode("units").alias("unit"), "id", F.lit(None).cast(kind).alias("other"), "data")
    both = each.unionAll(pairs.select("unit", "left", "right", F.lit(None).cast("binary")))
    together = both.repartition("unit").sortWithinPartitions("unit", F.col("other").asc_nulls_first())
    return together.mapInArrow(compare, f"left {kind}, right {kind}")


def class_links(sets: list[np.ndarray], size: np.ndarray, root: np.ndarray, later: np.ndarray | None, threshold: float) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """(edges, limit, by, both) of documents by sets of common shingles alone, sets[i] being those of one of size[i] shingles.

    Compared are all pairs, or where later is given, those of one row that is later and one that isn't. edges: as
    many near pairs as join all that are near and of different roots. A document of the shingles of sets[i] is near
    by[i], of which it has both[i], up to a size of limit[i]; near no other one if not this one.
    """
    count = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.cumsum(count) - count
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(np.minimum.reduceat(codes, start), kind="stable")  # sets of one passage stand together
    place = np.full(int(codes.max()) + 1, -1)
    root, edges = root.copy(), []
    limit, by, both = np.full(len(sets), -np.inf), np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)

    def strips(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = [rows[at : at + STRIP] for at in range(0, len(rows), STRIP)]
        return [(p, np.unique(codes[ragged(start[p], count[p])])) for p in parts]

    def dense(rows: np.ndarray, width: int) -> np.ndarray:
        at = place[codes[ragged(start[rows], count[rows])]]
        row = np.repeat(np.arange(len(rows)), count[rows])[at >= 0]
        out = np.zeros((len(rows), width), np.float32)
        out[row, at[at >= 0]] = 1
        return out

    def bound(rows: np.ndarray, others: np.ndarray, shared: np.ndarray) -> None:
        most = shared * ((1 + threshold) / threshold) - size[others]
        best = most.argmax(1)
        each = np.arange(len(rows))
        better = most[each, best] > limit[rows]
        rows, each, best = rows[better], each[better], best[better]
        limit[rows], by[rows], both[rows] = most[each, best], others[best], shared[each, best]

    mine = strips(order if later is None else order[~later[order]])
    theirs = mine if later is None else strips(order[later[order]])
    for k, (x, own) in enumerate(mine):
        for y, other in theirs[k:] if later is None else theirs:
            met = np.intersect1d(own, other, assume_unique=True)
            if not len(met):
                continue
            shared = np.zeros((len(x), len(y)), np.float32)  # exact for sets of up to 2 ** 24
            for at in range(0, len(met), HELD):
                some = met[at : at + HELD]
                place[some] = np.arange(len(some))
                shared += dense(x, len(some)) @ dense(y, len(some)).T
                place[some] = -1
            shared = shared.astype(np.float64)
            if x is y:
                np.fill_diagonal(shared, 0)
            bound(x, y, shared)
            if x is not y:
                bound(y, x, shared.T)
            near = shared / (size[x][:, None] + size[y] - shared) >= threshold
            near &= root[x][:, None] != root[y]
            for r in np.flatnonzero(near.any(1)).tolist():
                to = y[near[r]]
                for u, first in zip(*(v.tolist() for v in np.unique(root[to], return_index=True))):
                    if u != root[x[r]]:
                        edges.append((int(x[r]), int(to[first])))
                        root[root == u] = root[x[r]]
    return edges, limit, by, both


def rest(sets: DataFrame, joined: DataFrame, threshold: float = THRESHOLD, full: int = FULL) -> tuple[DataFrame, list[DataFrame]]:
    """(links, tables behind them): near pairs (left, right) that join all groups (id, component) of joined which any two
    near documents of sets (id, data) link, an id that joined lacks being its own group. Exact.

    A shingle that more than full sets hold is common. Of a pair that shares a rare one, the rarest shared one is
    among the first of both sets by rarity, as many as a near pair can't all miss; so such pairs meet by these, and
    no shingle brings more than full together. What other pairs share are common shingles only: a document near
    another by these alone is near the shortest one of that one's common shingles, so the shortest of each
    distinct set are compared with each other, all pairs by tiles, and the others with one that reaches furthest.
    """
    kind = sets.schema["id"].dataType.simpleString()
    n_known, width = F.size("held"), F.col("size") - F.ceil(F.col("size") * threshold - 1e-6) + 1
    counts = written(sets.select(F.explode("data").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    each = sets.select(F.monotonically_increasing_id().alias("row"), "id", F.size("data").alias("size"), "data").select("row", "id", "size", F.explode("data").alias("s"))
    held = each.join(counts, "s").groupBy("row", "id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("held"))
    known = written(held.join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("comp"), "size", "held"))
    tables = [counts, known]

    # shingles of one set only come first by rarity, but bring none together
    firsts = known.withColumn("own", F.col("size") - n_known).withColumn("width", (width - F.col("own")).cast("int")).where(F.col("width") > 0)
    posts = firsts.select("id", "comp", "size", (F.col("size") - F.col("own")).alias("after"), F.posexplode(F.slice("held", F.lit(1), F.col("width"))).alias("pos", "t")).where(F.col("t.n") <= full)
    posts = posts.select(F.col("t.s").alias("s"), "id", "comp", "size", (F.col("after") - F.col("pos")).alias("after"))
    a, b = (posts.select("s", *[F.col(c).alias(c + side) for c in posts.columns[1:]]) for side in "ab")
    may = F.least("aftera", "afterb") >= (F.col("sizea") + F.col("sizeb")) * (threshold / (1 + threshold)) - 1e-6
    met = a.join(b, "s").where((F.col("compa") < F.col("compb")) & may)
    pairs = written(met.groupBy(F.least("ida", "idb").alias("left"), F.greatest("ida", "idb").alias("right")).agg(F.min(F.xxhash64("s")).alias("unit")))
    tables.append(pairs)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = pa.array([x.values.to_numpy().tobytes() for x in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), data], ["id", "units", "data"])

    chosen = sets.join(_wanted(pairs), "id").select("id", "units", "data").mapInArrow(pack, f"id {kind}, units array<long>, data binary")
    links = _verified(pairs, chosen, threshold)

    common = known.select("id", "comp", "size", F.sort_array(F.transform(F.filter("held", lambda t: t["n"] > full), lambda t: t["s"])).alias("common"))
    common = common.where((F.size("common") > 0) & (F.size("common") >= F.col("size") * threshold - 1e-6)).withColumn("key", F.sha2(F.to_json("common"), 256))
    classes = written(common.groupBy("key").agg(F.min_by(F.struct("id", "size", "comp"), F.struct("size", "id")).alias("f"), F.first("common").alias("common"), (F.count("*") > 1).alias("more")))
    tables.append(classes)
    # within a set of common shingles, the others meet the shortest
    reach = classes.where("more").select("key", F.col("f.id").alias("by"), F.size("common").alias("both"), F.col("f.size").alias("by_size"))
    total = classes.agg(F.count("*").alias("n"), F.sum(F.size("common")).alias("s")).first()
    if total.n > 1:
        parts = math.ceil(max(total.n / TILE, total.s / TILE_SHINGLES))
        block = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("long")
        spread = classes.select(block.alias("block"), "key", "f.id", "f.size", "f.comp", "more", "common", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("other"))
        spread = spread.withColumn("tile", F.least("block", "other") * parts + F.greatest("block", "other")).drop("other")
        found = written(_tiled(spread, threshold, parts))
        tables.append(found)
        links = links.unionAll(found.where(F.col("key").isNull()).select("left", "right"))
        furthest = found.where(F.col("key").isNotNull()).groupBy("key").agg(F.max_by(F.struct(F.col("right").alias("by"), "both", "by_size"), "limit").alias("r"))
        reach = reach.unionAll(furthest.select("key", "r.by", "r.both", "r.by_size"))
    reached = common.join(reach, "key").where((F.col("id") != F.col("by")) & (F.col("both") / (F.col("size") + F.col("by_size") - F.col("both")) >= threshold))
    return links.unionAll(reached.select("id", "by")), tables


def _tiled(spread: DataFrame, threshold: float, parts: int) -> DataFrame:
    """class_links() of each tile: edges as (left, right), and for each key with more than one document its (right, limit, both, by_size)."""
    kind = spread.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            tiles = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)]
            for x, y in zip(cuts, cuts[1:]):
                if x < y:
                    if held and tiles[x] != last:
                        yield from solve(pa.Table.from_batches(held))
                        held = []
                    held.append(b.slice(x, y - x))
                    last = tiles[x]
        if held:
            yield from solve(pa.Table.from_batches(held))

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        tile = table.column(0)[0].as_py()
        ids, key = table.column(3).combine_chunks(), table.column(2).combine_chunks()
        block, size, more = (table.column(i).to_numpy() for i in (1, 4, 6))
        root = table.column(5).combine_chunks().dictionary_encode().indices.to_numpy()
        sets = [x.values.to_numpy() for x in table.column(7).combine_chunks()]
        low, high = divmod(tile, parts)
        later = None if low == high else block == high
        if later is not None and (later.all() or not later.any()):
            return
        edges, limit, by, both = class_links(sets, size.astype(np.int64), root, later, threshold)
        left, right = np.array(edges, np.int64).reshape(-1, 2).T
        rows = np.flatnonzero(more & (limit >= size - 1e-6))
        n, m = len(left), len(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([ids.take(pa.array(left)), pa.nulls(m, ids.type)]),
                pa.concat_arrays([ids.take(pa.array(right)), ids.take(pa.array(by[rows]))]),
                pa.concat_arrays([pa.nulls(n, key.type), key.take(pa.array(rows))]),
                pa.array(np.concatenate([np.zeros(n), limit[rows]])),
                pa.array(np.concatenate([np.zeros(n, np.int64), both[rows]])),
                pa.array(np.concatenate([np.zeros(n, np.int64), size[by[rows]]]).astype(np.int64)),
            ],
            ["left", "right", "key", "limit", "both", "by_size"],
        )

    together = spread.select("tile", "block", "key", "id", "size", "comp", "more", "common").repartition("tile").sortWithinPartitions("tile")
    return together.mapInArrow(run, f"left {kind}, right {kind}, key string, limit double, both long, by_size long")


def groups(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", full: int = FULL) -> DataFrame:
    """(id, group_id, keep) for each distinct id: the least id of its group, and whether it is this one.

    An id names one document: rows that repeat it count once, and it is near whatever one of them is
    near. A document without words (null, empty) is near no other and stays. Rows whose id is null are
    left out, as no group could name them. Documents of equal signatures (copies, or texts that differ
    in case and white space) meet by their hash and only one enters the forest, however many they are.
    All other edges are verified by the sets. Documents of equal similarity to several are joined to all.
    A text of any length counts with all of its words.
    No step holds more than about full documents of one passage at once, however many share it, but for the shortest
    of each distinct set of common shingles, which meet by tiles; none of the pairs of a full region is left out.
    An empty table gives an empty one; other columns are left out whatever their names.
    """
    signed = written(signatures(docs.where(F.col(id_col).isNotNull()), id_col, text_col))
    some = signed.where(F.col("same").isNotNull())
    firsts = written(some.groupBy("same").agg(F.min("id").alias("first"), F.min_by(F.struct("label", "sketch"), "id").alias("s")))
    entered = firsts.select(F.col("first").alias("id"), "s.label", "s.sketch")
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    deeper = full_regions(entered, full)
    if deeper is None:
        pairs, tables = tree_edges(entered, threshold - SLACK, threshold + SURE), []
    else:
        rows, alike, tables = rare_rows(named, written(deeper.select("id")), full)
        cut = written(tree_rows(deeper))
        tables.append(cut)
        leaders = leader_rows(cut, tables[0].select("id", F.size("data").alias("size")))
        others = tree_rows(entered.join(deeper.select("id"), "id", "left_anti"))
        rows = others.unionAll(cut).drop("cut").unionAll(rows).unionAll(leaders)
        pairs = tree_edges(entered, threshold - SLACK, threshold + SURE, rows).unionAll(alike)
    forest = written(pairs)
    near = verified(forest, named, threshold, "id", "text")
    stars = some.select("same", "id").join(firsts.select("same", "first"), "same").where(F.col("id") != F.col("first"))
    joined = connected_components(near.unionAll(stars.select(F.col("first").alias("left"), F.col("id").alias("right"))))
    discard(firsts), discard(forest)  # the edges are written by now
    named = signed.select("id").distinct().join(joined, "id", "left").withColumn("group_id", F.coalesce("component", "id"))
    if deeper is not None:
        links, more = rest(tables[0].select("id", "data"), joined, threshold, full)
        for side in ("left", "right"):
            of = joined.select(F.col("id").alias(side), F.col("component").alias("of"))
            links = links.join(of, side, "left").withColumn(side, F.coalesce("of", side)).drop("of")
        whole = connected_components(links)
        named = named.join(whole.select(F.col("id").alias("group_id"), F.col("component").alias("whole")), "group_id", "left").withColumn("group_id", F.coalesce("whole", "group_id"))
        for t in (deeper, *tables, *more):
            discard(t)
    return named.select(F.col("id").alias(id_col), "group_id", (F.col("id") == F.col("group_id")).alias("keep"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each group the row of the least id, with the columns of docs.

    Rows whose id is null stay, as do texts that are null or without words; of rows that repeat an id and a
    text one stays. Texts of any length are compared whole. An empty table gives an empty one, and columns of
    any names are carried.
    """
    kept = groups(docs, threshold, id_col, text_col).where("keep").select(F.col(id_col).alias("kept_"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = docs.join(kept, docs[id_col] == kept["kept_"], "left_semi").dropDuplicates([id_col, text_col])
    return once.unionAll(docs.where(F.col(id_col).isNull())).select(*columns)
